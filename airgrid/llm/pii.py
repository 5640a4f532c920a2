"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns find candidate spans of four kinds in every whole text; texts without an '@' or a digit skip them.
Five labelers vote 1, 0 or nothing on a candidate: the strict pattern, the checks of its value (checksum, range,
number of digits), a gazetteer of words in the context, the characters on both sides, and the usual layout of the kind. Spark counts how often each pattern
of votes occurs (at most 4 x 3^5 rows, whatever the corpus); expectation-maximisation over these counts estimates
the labelers' reliabilities, and its posteriors train a logistic span classifier, which decides on every candidate.
Strict matches always stay; a candidate that the classifier adds must not overlap a strict match or an earlier added span.

Defined results: a null text is empty and has no spans; a null doc_id is returned as such; repeated rows are returned
each; an empty table gives no rows (and default reliabilities); other columns are ignored by ``find_spans`` and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Each strict pattern in a form that Java matches without stack growth and without trying every start of a run.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++"
              r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"),
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
GAZETTEER = {
    "email": "mail|e-mail|email|contact|write to|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse|dirección|addr",
    "card": "card|visa|mastercard|credit|carte|karte|tarjeta|iban",
    "phone": "phone|tel|call|mobile|fax|téléphone|telefon|teléfono|cell",
}
AGAINST = "isbn|page|version|order|invoice|serial|issn|doi"
CONTEXT = 24
#: Share of real values that pass the checks of their kind; all others are misprints. Not estimated, since the other
#: labelers vote alike on real and invented numbers.
CHECKS_HOLD = 0.998
LABELERS = ("pattern", "checks", "gazetteer", "sides", "layout")


def _found(text: Column, pattern: str, useful: Column) -> Column:
    """Matches as (start, end, value), code points, end exclusive."""
    none = F.array().cast("array<string>")
    values = F.when(useful, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(useful, F.split(text, pattern, -1)).otherwise(none)
    pairs = F.filter(F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap"))), lambda x: x["value"].isNotNull())
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["end"] + x["gap"]
        stop = begin + F.length(x["value"])
        return F.struct(stop.alias("end"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    chars = F.split(F.reverse(digits), "")
    terms = F.transform(chars, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(t, F.lit(0))) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


_LAYOUT = {
    "email": r"[A-Za-z]{2,6}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
}


def _voted(text: Column, kind: str, spans: Column, strict: bool) -> Column:
    """Spans with kind, whether they are base spans, and the votes."""

    def one(x: Column) -> Column:
        sound = _passes(kind, x["value"])
        base = sound if strict else F.lit(False)
        before = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
        after = F.substring(text, x["end"] + 1, F.lit(1))
        near = F.lower(before)
        words = F.when(near.rlike(rf"(?:^|[^\p{{L}}])(?:{GAZETTEER[kind]})[^\p{{L}}]"), 1).when(near.rlike(rf"(?:^|[^\p{{L}}])(?:{AGAINST})[^\p{{L}}]"), 0).otherwise(-1)
        sides = F.when(F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}]") | after.rlike(r"[\p{L}\p{N}]"), 0).otherwise(1)
        layout = F.when(x["value"].rlike(_LAYOUT[kind]), 1).otherwise(0)
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), base.alias("base"),
                        F.lit(int(strict)).alias("pattern"), F.when(sound, 1).otherwise(0).alias("checks"), words.alias("gazetteer"), sides.alias("sides"), layout.alias("layout"))

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: all candidates with votes, by start, then kind; base spans first among equals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("__text", text)
    text = F.col("__text")
    docs = docs.withColumn("__digit", text.rlike("[0-9]"))
    at, digit = F.contains(text, F.lit("@")), F.col("__digit")
    tests = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    docs = docs.withColumns({f"__s_{k}": _found(text, STRICT[k], tests[k]) for k in KINDS}
                            | {"__l_email": _found(text, LOOSE["email"], text.rlike(r"[(\[]at[)\]]")), "__l_phone": _found(text, LOOSE["phone"], digit)})
    every = F.concat(*(_voted(text, k, F.col(f"__s_{k}"), True) for k in KINDS), *(_voted(text, k, F.col(f"__l_{k}"), False) for k in LOOSE))
    docs = docs.withColumn("__every", every)
    base = F.filter("__every", lambda x: x["base"])
    # what isn't a base span is a candidate in the usual layout and apart from base spans
    docs = docs.withColumn("__base", base)
    other = F.filter("__every", lambda x: ~x["base"] & (x["layout"] == 1) & ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return docs.withColumn("spans", F.array_sort(F.concat("__base", other))).drop("__every", "__base", "__text", "__digit", *(f"__s_{k}" for k in KINDS), *(f"__l_{k}" for k in LOOSE))


def vote_counts(spans: DataFrame) -> list:
    """Rows of (kind, votes, n); their number is bounded by the number of possible votes."""
    return (spans.select(F.explode("spans").alias("s")).groupBy(*(F.col(f"s.{c}").alias(c) for c in ("kind", *LABELERS)))
            .agg(F.count("*").alias("n")).collect())


def estimate(rows: list, rounds: int = 50, belief: float = 0.5) -> dict:
    """Reliabilities (chance of a vote for each truth) by expectation-maximisation; each row gets its posterior.
    What is believed at the start counts as ``belief`` times the votes, so that labelers that nearly always
    agree don't outvote the checks of the strict pattern."""
    start = {"pattern": (0.3, 0.9), "checks": (0.1, CHECKS_HOLD), "gazetteer": (0.2, 0.8), "sides": (0.5, 0.9), "layout": (0.3, 0.9)}
    hits, prior = {x: list(start[x]) for x in LABELERS}, 0.5  # chance of vote 1 if the span is no personal data, if it is
    post = [0.5] * len(rows)
    for _ in range(rounds):
        for i, r in enumerate(rows):
            odds = math.log(prior / (1 - prior))
            for x in LABELERS:
                if r[x] >= 0:
                    no, yes = hits[x] if r[x] else [1 - h for h in hits[x]]
                    odds += math.log(yes / no)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(r["n"] for r in rows)
        if not total:
            break
        prior = (sum(r["n"] * p for r, p in zip(rows, post, strict=True)) + 0.5 * belief * total) / (total + belief * total)
        for x in LABELERS:
            for truth in (0, 1):
                w = [r["n"] * (p if truth else 1 - p) if r[x] >= 0 else 0.0 for r, p in zip(rows, post, strict=True)]
                held = 1 + belief * sum(r["n"] for r in rows if r[x] >= 0)
                value = (sum(a for a, r in zip(w, rows, strict=True) if r[x] == 1) + start[x][truth] * held) / (sum(w) + held)
                hits[x][truth] = CHECKS_HOLD if x == "checks" and truth else min(0.99, max(0.01, value))
    return {"hits": hits, "prior": prior, "posteriors": post}


def _features(r) -> list[float]:
    votes = [v for x in LABELERS for v in (float(r[x] == 1), float(r[x] == 0))]
    return [1.0, *votes, *(float(r["kind"] == k) for k in range(len(KINDS)))]


def train(rows: list, posteriors: list[float], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic span classifier on the soft labels, weighted by log counts so that one frequent pattern isn't all there is."""
    weights = [0.0] * len(_features({"kind": 0} | dict.fromkeys(LABELERS, 0)))
    data = [(_features(r), p, math.log1p(r["n"])) for r, p in zip(rows, posteriors, strict=True)]
    total = sum(n for _, _, n in data) or 1.0
    for _ in range(steps):
        g = [decay * w for w in weights]
        for x, p, n in data:
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for i, v in enumerate(x):
                g[i] += d * v
        weights = [w - rate * v for w, v in zip(weights, g, strict=True)]
    return weights


def fit(spans: DataFrame) -> list[float]:
    """Weights of the span classifier from the votes of all candidates."""
    rows = [r.asDict() for r in vote_counts(spans)]
    rows.sort(key=lambda r: (r["kind"], *(r[x] for x in LABELERS)))
    return train(rows, estimate(rows)["posteriors"])


def _score(x: Column, weights: list[float]) -> Column:
    z = F.lit(weights[0])
    for i, name in enumerate(LABELERS):
        z = z + F.when(x[name] == 1, F.lit(weights[1 + 2 * i])).when(x[name] == 0, F.lit(weights[2 + 2 * i])).otherwise(F.lit(0.0))
    for k in range(len(KINDS)):
        z = z + F.when(x["kind"] == k, F.lit(weights[1 + 2 * len(LABELERS) + k])).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def chosen(spans: DataFrame, weights: list[float], least: float = 0.5) -> DataFrame:
    """``spans`` with ``base`` and ``final`` arrays of (start, kind, end), by start and kind."""
    kind = "array<struct<start:int,kind:int,end:int>>"
    plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    df = spans.withColumn("base", plain(F.filter("spans", lambda x: x["base"])))
    df = df.withColumn("__new", plain(F.filter("spans", lambda x: ~x["base"] & (_score(x, weights) >= least))))
    free = F.filter("__new", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    first = F.aggregate(free, F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])), acc)
                        .otherwise(F.concat(acc, F.array(x))))
    return df.withColumn("final", F.array_sort(F.concat("base", first))).drop("__new", "spans")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256 and spans (all, written kind:start:end)."""
    found = materialize(candidates(docs.select("doc_id", "text")).drop("text"))
    df = chosen(found, fit(found))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == KINDS.index(name))).cast("bigint").alias(f"n_{name}") for name in KINDS]
    return df.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("final")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets and n_chars, if there is one, brought up to date;
    spans that overlap are replaced together by the first one's kind."""
    held = {f"__c{i}": c for i, c in enumerate(docs.columns) if c != "text"}  # so that no column clashes
    found = candidates(docs.select("text", *(F.col(c).alias(k) for k, c in held.items())))
    df = chosen(found, fit(found))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col("text"), acc["end"] + 1, x["start"] - acc["end"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(acc["end"], x["end"]).alias("end"), F.when(x["start"] >= acc["end"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("final", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["end"] + 1, F.length("text"))))
    out = df.withColumn("text", F.when(F.size("final") > 0, whole).otherwise(F.col("text")))
    out = out.select("text", F.size("final").alias("__n"), *held).withColumnsRenamed(held)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
