"""2x2 table measures as column expressions over columns a, b, c, d.

a/b: exposed with / without the outcome; c/d: unexposed with / without.
"""

from __future__ import annotations

import math

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from airgrid.spec import Z_95


def contingency(exposed: Column, outcome: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates a, b, c, d; ``weight`` counts pre-aggregated rows."""
    one = F.lit(1).cast("bigint") if weight is None else weight
    cells = {"a": exposed & outcome, "b": exposed & ~outcome, "c": ~exposed & outcome, "d": ~exposed & ~outcome}
    return [F.coalesce(F.sum(F.when(test, one)), F.lit(0)).cast("bigint").alias(name) for name, test in cells.items()]


def _cols() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(name).cast("double") for name in "abcd")


def risk_columns() -> dict[str, Column]:
    """Both risks, relative risk with Wald log CI, Haldane-Anscombe odds ratio with CI.

    An undefined relative risk (a = 0 or c = 0) is +inf with null limits.
    """
    a, b, c, d = _cols()
    usable = (a > 0) & (c > 0)
    rr = F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d))
    rr_half = F.lit(Z_95) * F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    h = [x + F.lit(0.5) for x in (a, b, c, d)]
    odds = (h[0] * h[3]) / (h[1] * h[2])
    or_half = F.lit(Z_95) * F.sqrt(sum((1 / x for x in h[1:]), 1 / h[0]))
    return {
        "risk_exposed": F.try_divide(a, a + b),
        "risk_unexposed": F.try_divide(c, c + d),
        "rr": F.when(usable, rr).otherwise(F.lit(float("inf"))),
        "rr_lo": F.when(usable, F.exp(F.log(rr) - rr_half)),
        "rr_hi": F.when(usable, F.exp(F.log(rr) + rr_half)),
        "odds_ratio": odds,
        "or_lo": F.exp(F.log(odds) - or_half),
        "or_hi": F.exp(F.log(odds) + or_half),
    }


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: asymptotic series from 16 on, shifted up by 16 factors below."""
    def series(x: Column) -> Column:
        r = F.lit(1.0) / (x * x)
        return (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * F.lit(1 / 1680)))) / x

    def value(x: Column) -> Column:
        product = x
        for i in range(1, 16):
            product = product * (x + i)
        return F.when(x >= 16, series(x)).otherwise(series(x + 16) - F.log(product))

    return let(z.cast("double"), value)


def _log_factorial(n: Column) -> Column:
    """Of whole numbers: a table below 16, the series of ``log_gamma`` from there on."""
    def value(m: Column) -> Column:
        x = m.cast("double")
        r = F.lit(1.0) / (x * x)
        series = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * F.lit(1 / 1260))) / x
        return F.when(m >= 16, series).otherwise(F.get(F.lit([math.lgamma(i + 1) for i in range(16)]), m.cast("int")))

    return let(n, value)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _log_p(f: Column, x: Column) -> Column:
    """Log probability of x in the first cell of a table with the margins of f, up to the constant of the margins."""
    return let(x, lambda v: _log_choose(f["k"], v) + _log_choose(f["t"] - f["k"], f["n"] - v) - f["constant"])


def _tail_p(f: Column, far: Column, step: int) -> Column:
    """Probability of the tables between ``far`` and the likeliest one that are within the limit."""
    k, n, t = (f[x].cast("double") for x in "knt")

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["good"] + s["bad"]) / 2).cast("bigint")
        moved = let(mid, lambda m: F.when(_log_p(f, m) <= f["limit"], F.struct(m.alias("good"), s["bad"].alias("bad"))).otherwise(
            F.struct(s["good"].alias("good"), m.alias("bad"))))
        return F.when(F.abs(s["bad"] - s["good"]) > 1, moved).otherwise(s)

    def outwards(s: Column, _: Column) -> Column:
        x = s["x"]
        ratio = (x * (t - k - n + x) / ((k - x + 1) * (n - x + 1)) if step < 0 else (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1)))
        return let(s["term"] * ratio, lambda term: F.struct((x + step).alias("x"), term.alias("term"), (s["acc"] + term).alias("acc")))

    def summed(inner: Column) -> Column:
        count = F.least(F.abs(far - inner), F.ceil(f["spread"] * 10).cast("bigint") + 50)
        steps = F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
        start = F.struct(inner.cast("double").alias("x"), F.lit(1.0).alias("term"), F.lit(1.0).alias("acc"))
        return F.exp(_log_p(f, inner)) * F.aggregate(steps, start, outwards, lambda s: s["acc"])

    inner = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(far.alias("good"), f["mode"].alias("bad")), halved, lambda s: s["good"])
    return F.when(_log_p(f, far) > f["limit"], F.lit(0.0)).otherwise(let(inner, summed))


_BUILT: dict[tuple, Column] = {}


def fisher_p(a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> Column:
    """Exact two-sided p of the 2x2 table in four columns. Building the expression takes seconds, so it is kept for each JVM."""
    key = (id(SparkContext._jvm), a, b, c, d)
    if key not in _BUILT:
        _BUILT[key] = _fisher_p(a, b, c, d)
    return _BUILT[key]


def _fisher_p(a: str, b: str, c: str, d: str) -> Column:
    """Exact two-sided p of a 2x2 table: total probability of tables no likelier than the given one.

    The likeliest table separates the two tails. In each a bisection finds the innermost table that counts, and the terms are
    summed outwards by the ratio of neighbours, as far as they can still matter (ten standard deviations).
    """
    a, b, c, d = (F.col(x).cast("bigint") for x in (a, b, c, d))
    zero = F.lit(0).cast("bigint")

    def with_ends(f: Column) -> Column:
        k, n, t = f["k"], f["n"], f["t"]
        kd, nd, td = (x.cast("double") for x in (k, n, t))
        spread = F.sqrt(kd / td * nd / td * (td - kd) * (td - nd) / F.greatest(td - 1, F.lit(1.0)))
        return F.struct(k.alias("k"), n.alias("n"), t.alias("t"), f["a"].alias("a"), F.greatest(zero, k + n - t).alias("low"), F.least(k, n).alias("high"),
                        _log_choose(t, n).alias("constant"), spread.alias("spread"), F.floor((kd + 1) * (nd + 1) / (td + 2)).cast("bigint").alias("middle"))

    def with_limit(f: Column) -> Column:
        mode = F.least(f["high"], F.greatest(f["low"], f["middle"]))
        return F.struct(*[f[x].alias(x) for x in ("k", "n", "t", "low", "high", "constant", "spread")], mode.alias("mode"), (_log_p(f, f["a"]) + F.lit(1e-7)).alias("limit"))

    def p(f: Column) -> Column:
        both = F.least(F.lit(1.0), _tail_p(f, f["low"], -1) + _tail_p(f, f["high"], 1))
        return F.when((f["low"] == f["high"]) | (_log_p(f, f["mode"]) <= f["limit"]), F.lit(1.0)).otherwise(both)

    facts = F.struct((a + c).alias("k"), (a + b).alias("n"), (a + b + c + d).alias("t"), a.alias("a"))
    return F.when((a + b + c + d) > 0, let(let(let(facts, with_ends), with_limit), p))


def finite(value: Column) -> Column:
    """Null instead of NaN or infinity, for tabular output."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta of 0 <= x <= 1 by its continued fraction, from the side where that settles fast."""
    tiny = F.lit(1e-300)
    some = lambda v: F.when(v == 0, tiny).otherwise(v)

    def fraction(p: Column, q: Column, y: Column) -> Column:
        def term(s: Column, top: Column) -> Column:
            return let(F.struct((F.lit(1.0) / some(top * s["d"] + 1)).alias("d"), some(top / s["c"] + 1).alias("c")),
                       lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h")))

        def step(s: Column, m: Column) -> Column:
            m = m.cast("double")
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return let(term(s, even), lambda n: term(n, odd))

        first = F.lit(1.0) / some(F.lit(1.0) - (p + q) * y / (p + 1))
        start = let(first, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))
        value = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["h"])
        return F.exp(p * F.log(y) + q * F.log1p(-y) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p * value

    swap = x > (a + 1) / (a + b + 2)
    inner = F.when(swap, F.lit(1.0) - fraction(b, a, 1 - x)).otherwise(fraction(a, b, x))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def pearson_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of a correlation coefficient r of n pairs; null without a coefficient or with fewer than 3 pairs."""
    r, n = (F.col(x) if isinstance(x, str) else x for x in (r, n))
    p = incomplete_beta((n.cast("double") - 2) / 2, F.lit(0.5), F.greatest(F.lit(0.0), 1 - r * r))
    return F.when(r.isNotNull() & ~F.isnan(r) & (n > 2), p)
