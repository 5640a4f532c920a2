"""Toxicity: a convolutional text classifier, trained and applied by Spark tasks with numpy.

Words, their first five and their last five bytes are hashed into three embedding tables; filters of
widths 1, 2 and 3 run over the word sequence, the maximum of each filter over the whole text feeds a
logistic output.
The model is fitted on the whole texts of all labelled documents that aren't held out: Spark tasks train on their own rows, and their
states are averaged after each round. It is broadcast (6 MB whatever the corpus); every whole text is scored in Arrow batches.
Language only selects the threshold of ``rejected``, never the score.

Defined results: a null or empty text is scored like a text without words; a null label is not
learned from, repeated label rows of a document count once (the larger label); repeated
documents are each scored; without labels the score is 0.5 x the prior of the default model,
that is 0; more columns are ignored. A null language uses the threshold for all languages.
"""

from __future__ import annotations

import copy
import math
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from airgrid.llm.common import fold, slices, utf8_texts
from airgrid.session import materialize

WIDTHS = (1, 2, 3)
BUCKETS, TABLES, AFFIX = 1 << 16, 3, 5
FOLDS, HELD_OUT = 4, 2
LARGEST = 16
#: Rows that a task of the training has at least, tasks up to which their number grows with the rows, and the unit of the integers that states are summed in.
TASK_ROWS, EVEN_TASKS, FIXED = 6000, 16, float(1 << 32)
#: Kinds from here on hold the whole parts of the state, those below the fractions.
WHOLE = TABLES + 1
#: Bytes of text scored at once; scoring takes about 60 bytes of temporary arrays for each.
SCORE_BYTES = 1 << 20
#: Bytes that separate words: all ASCII but letters; a-z stay, A-Z are lowered.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def hashed_words(text: bytes) -> np.ndarray:
    """Buckets (words, 3) of the lower-cased words of a whole text, of their starts and of their ends."""
    words = text.translate(_LETTERS).split()
    out = np.empty((len(words), TABLES), np.uint32)
    for k, part in enumerate((words, [w[:AFFIX] for w in words], [w[-AFFIX:] for w in words])):
        out[:, k] = np.fromiter(map(zlib.crc32, part), np.uint32, len(words))
    return (out & np.uint32(BUCKETS - 1)).astype(np.uint16)


@dataclass
class ToxicityModel:
    tables: list[np.ndarray]               # three of (buckets, part of the embedding)
    filters: list[np.ndarray]              # by width: (width, embedding, filters)
    offsets: list[np.ndarray]              # by width: (filters,)
    output: np.ndarray
    bias: float
    threshold: float
    by_language: dict[str, float]

    def vectors(self, hashes: np.ndarray, pads: np.ndarray) -> np.ndarray:
        x = np.concatenate([t[hashes[:, k]] for k, t in enumerate(self.tables)], axis=1)
        x[pads.ravel()] = 0
        return x

    def pooled(self, x: np.ndarray, starts: np.ndarray, pads: np.ndarray) -> np.ndarray:
        """Maxima of all filters over each text; windows may reach into the zero rows after a text, not beyond."""
        out = []
        for width, filters, offset in zip(WIDTHS, self.filters, self.offsets, strict=True):
            y = x @ filters[0]
            for k in range(1, width):
                y[:-k] += x[k:] @ filters[k]
            y[pads[:, :width - 1]] = -np.inf
            out.append(np.maximum(np.maximum.reduceat(y, starts, axis=0) + offset, 0))
        return np.concatenate(out, axis=1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        hashes, starts, pads = joined(texts)
        logits = self.pooled(self.vectors(hashes, pads), starts, pads) @ self.output + self.bias
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All word hashes in one array, each text followed by zero rows that part it from the next;
    the first position of each text; the positions of the zero rows, last first, one row per text. A text without words
    has one window of each width."""
    gap = max(WIDTHS)
    lengths = np.array([len(t) + gap for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    hashes = np.zeros((int(lengths.sum()), TABLES), np.uint16)
    for start, t in zip(starts, texts, strict=True):
        hashes[start:start + len(t)] = t
    pads = (starts + lengths)[:, None] - 1 - np.arange(gap)[None, :]
    return hashes, starts, pads


def _start_model(found: np.ndarray, n: int, ones: int, width: int, filters: int, rng) -> ToxicityModel:
    """Embeddings start small, with the smoothed log odds of a bucket's documents in the first place."""
    tables = []
    for k in range(TABLES):
        known = found[:, k].sum(0)
        odds = np.log((found[1, k] + 0.5) / (found[0, k] + 0.5)) - np.log((ones + 1) / (n - ones + 1))
        table = rng.normal(0, 0.01, (BUCKETS, width))
        table[:, 0] = np.where(known > 0, odds * (known / (known + 4)) / 2, 0)
        tables.append(table.astype(np.float32))
    size = TABLES * width
    return ToxicityModel(tables, [rng.normal(0, 0.3, (w, size, filters)).astype(np.float32) for w in WIDTHS],
                         [np.zeros(filters, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, len(WIDTHS) * filters).astype(np.float32),
                         0.0, 0.5, {})


class Training:
    """A model with the state of its optimizers: Adam for the dense parameters, Adagrad for the embedding rows."""

    def __init__(self, model: ToxicityModel, share: float):
        self.model, self.step = model, 0.0
        bias = np.array([np.log((share + 1e-3) / (1 - share + 1e-3))], np.float32)
        self.dense = [*model.filters, *model.offsets, model.output, bias]
        self.first, self.second = [np.zeros_like(p) for p in self.dense], [np.zeros_like(p) for p in self.dense]
        self.seen = [np.zeros((BUCKETS, 1), np.float32) for _ in model.tables]

    def update(self, texts: list[np.ndarray], labels: np.ndarray, rate: float = 0.01, decay: float = 1e-3) -> None:
        """One step on the mean logistic loss of the texts; the maxima pass gradients to one window each."""
        m, dense = self.model, self.dense
        width, bias = m.tables[0].shape[1], dense[-1]
        hashes, starts, pads = joined(texts)
        x = m.vectors(hashes, pads)
        ends = np.append(starts[1:], len(hashes))
        best, kept = [], []
        for span, w, b in zip(WIDTHS, m.filters, m.offsets, strict=True):
            y = x @ w[0]
            for k in range(1, span):
                y[:-k] += x[k:] @ w[k]
            where = np.stack([s + y[s:e - span + 1].argmax(0) for s, e in zip(starts, ends, strict=True)])
            best.append(where)
            kept.append(np.take_along_axis(y, where, 0) + b)
        pool = np.concatenate(kept, 1)
        act = np.maximum(pool, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ m.output + bias[0], -30, 30)))
        d = (p - labels) / len(texts)
        d_pool = d[:, None] * m.output[None, :] * (pool > 0)
        grads: list[np.ndarray] = []
        d_x = np.zeros_like(x)
        n = m.filters[0].shape[2]
        for j, (span, w) in enumerate(zip(WIDTHS, m.filters, strict=True)):
            dp = d_pool[:, j * n:(j + 1) * n]
            g = np.zeros_like(w)
            for k in range(span):
                rows = best[j] + k
                g[k] = np.einsum("df,dfe->ef", dp, x[rows])
                np.add.at(d_x, rows.ravel(), (dp[:, :, None] * w[k].T[None]).reshape(-1, w.shape[1]))
            grads.append(g)
        grads += [d_pool[:, j * n:(j + 1) * n].sum(0) for j in range(len(WIDTHS))]
        grads += [act.T @ d, np.array([d.sum()])]
        self.step += 1
        for i, (value, g) in enumerate(zip(dense, grads, strict=True)):
            g = g + decay * value
            self.first[i] += 0.1 * (g - self.first[i])
            self.second[i] += 0.001 * (g * g - self.second[i])
            value -= rate * (self.first[i] / (1 - 0.9 ** self.step)) / (np.sqrt(self.second[i] / (1 - 0.999 ** self.step)) + 1e-8)
        d_x[pads.ravel()] = 0
        hit = np.flatnonzero(np.abs(d_x).sum(1))
        for k, table in enumerate(m.tables):
            rows = hashes[hit, k]
            g = d_x[hit, k * width:(k + 1) * width]
            np.add.at(self.seen[k], rows, (g * g).mean(1, keepdims=True))
            np.add.at(table, rows, -rate * g / (np.sqrt(self.seen[k][rows]) + 1e-4))

    def _small(self) -> list[np.ndarray]:
        return [*self.dense, *self.first, *self.second]

    def parts(self, before: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, row, values): changes of the touched embedding rows with their Adagrad sums, and the dense state in rows of the same length."""
        kinds, rows, values = [], [], []
        for k, (table, seen) in enumerate(zip(self.model.tables, self.seen, strict=True)):
            change = np.concatenate([table - before.model.tables[k], seen - before.seen[k]], 1)
            hit = np.flatnonzero(np.abs(change).sum(1))
            kinds.append(np.full(len(hit), k))
            rows.append(hit)
            values.append(change[hit])
        small = [np.sqrt(v) if i >= 2 * len(self.dense) else v for i, v in enumerate(self._small())]  # roots, as squares get very small
        flat = np.concatenate([*(v.ravel() for v in small), [self.step]])
        flat = np.append(flat, np.zeros(-len(flat) % values[0].shape[1])).reshape(-1, values[0].shape[1])
        kinds.append(np.full(len(flat), TABLES))
        rows.append(np.arange(len(flat)))
        values.append(flat)
        return np.concatenate(kinds), np.concatenate(rows), np.concatenate(values).astype(np.float64)

    def take(self, kinds: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        """Apply the means of ``parts`` of several tasks."""
        for k, (table, seen) in enumerate(zip(self.model.tables, self.seen, strict=True)):
            at = rows[kinds == k]
            table[at] += values[kinds == k, :-1].astype(np.float32)
            seen[at] += values[kinds == k, -1:].astype(np.float32)
        own = kinds == TABLES
        flat, at = values[own][np.argsort(rows[own])].ravel(), 0
        for i, v in enumerate(self._small()):
            part = flat[at:at + v.size].reshape(v.shape)
            v[...] = part * part if i >= 2 * len(self.dense) else part
            at += v.size
        self.step = float(flat[at])


def _stored_words(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint16).reshape(-1, TABLES) for w in part.column("words").to_pylist()]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def bucket_counts(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Labelled documents by (label, table, bucket) that hold the bucket, how many documents there are, and how many of label 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, TABLES, BUCKETS), np.int64)
        for part in slices(batches, "words"):
            for t, y in zip(_stored_words(part), part.column("label").to_pylist(), strict=True):
                for k in range(TABLES):
                    found[y, k, np.unique(t[:, k])] += 1
        kind, bucket = np.nonzero(found.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket), *(pa.array(found[y, kind, bucket]) for y in (0, 1))], names=["kind", "bucket", "n0", "n1"])

    sums = rows.select("words", "label").mapInArrow(run, "kind long, bucket long, n0 long, n1 long").groupBy("kind", "bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most TABLES x BUCKETS rows
    out = np.zeros((2, TABLES, BUCKETS))
    for y in (0, 1):
        out[y, _numbers(sums, "kind"), _numbers(sums, "bucket")] = _numbers(sums, f"n{y}")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    return out, n, ones


def split(kinds: np.ndarray, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, place, integers) in units of 1 / ``FIXED``: fractions between -1/2 and 1/2, and whole numbers in rows of their own, of kinds from ``WHOLE``
    on, where any isn't 0. Times the rows of a task, sums of both fit 64 bits up to ``FIXED`` rows, however many steps and however large a weight."""
    whole = np.rint(values)
    large = np.flatnonzero(whole.any(1))
    return (np.concatenate([kinds, kinds[large] + WHOLE]), np.concatenate([places, places[large]]),
            np.concatenate([np.rint((values - whole) * FIXED), whole[large]]).astype(np.int64))


def united(kinds: np.ndarray, places: np.ndarray, sums: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns of ``split`` after they are summed, as (kind, place, float sums in units of 1 / ``FIXED``, n); n is that of all tasks that sent
    fractions. Column by column, as the driver holds little."""
    key = (kinds << 32) + places  # places are below BUCKETS or few
    order = np.argsort(key)
    kinds, places, key, n = kinds[order], places[order], key[order], n[order]
    few = int(np.searchsorted(kinds, WHOLE))
    at = np.searchsorted(key[:few], key[few:] - (WHOLE << 32))
    out = np.empty((few, len(sums)))
    for j, column in enumerate(sums):
        column = column[order].astype(np.float64)
        column[at] += column[few:] * FIXED
        out[:, j] = column[:few]
    return kinds[:few], places[:few], out, n[:few]


def training_tasks(n: int) -> int:
    """Tasks of a round over ``n`` rows. Each sends a state of the same size, so beyond ``EVEN_TASKS`` their number grows with the root of the rows only."""
    tasks = n // TASK_ROWS
    return max(1, min(tasks, math.isqrt(EVEN_TASKS * tasks)))


def train(rows: DataFrame, width: int = 6, filters: int = 8, epochs: int = 6, batch: int = 32, seed: int = 7) -> ToxicityModel:
    """Fit on all rows (words, label 0 or 1) of a stored table.

    In each of ``epochs`` rounds every task goes on from the same state over its own rows, and the states are averaged, weighted by rows: an
    embedding row over the tasks that touched it, the dense parameters over all. Sums are of integers, so that their order doesn't matter.
    The driver holds one model (6 MB), whatever the number of rows and tasks.
    """
    rng = np.random.default_rng(seed)
    found, n, ones = bucket_counts(rows)
    if ones in (0, n):
        model = _start_model(np.zeros((2, TABLES, BUCKETS)), 0, 0, width, filters, rng)
        model.output[:] = 0
        model.bias = 40.0 if ones else -40.0
        return model
    state = Training(_start_model(found, n, ones, width, filters, rng), ones / n)
    spread = rows.select("words", "label").coalesce(training_tasks(n))
    names = [f"v{j}" for j in range(width + 1)]
    for _ in range(epochs):
        shared = rows.sparkSession.sparkContext.broadcast((state, rng))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (own, order), done = copy.deepcopy(shared.value), 0
            for part in slices(batches, "words"):
                texts, y = _stored_words(part), part.column("label").to_numpy().astype(np.float32)
                mixed = order.permutation(len(texts))
                for at in range(0, len(mixed), batch):
                    own.update([texts[i] for i in mixed[at:at + batch]], y[mixed[at:at + batch]])
                done += len(texts)
            if done:
                kinds, places, values = own.parts(shared.value[0])
                kinds, places, fixed = split(kinds, places, values)
                fixed *= done
                yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(places.astype(np.int64)), pa.array(np.full(len(kinds), done, np.int64)),
                                                  *(pa.array(fixed[:, j].copy()) for j in range(fixed.shape[1]))], names=["kind", "place", "n", *names])

        sums = spread.mapInArrow(run, ", ".join(f"{c} long" for c in ("kind", "place", "n", *names))).groupBy("kind", "place").agg(
            *[F.sum(c).alias(c) for c in ("n", *names)]).toArrow()  # at most TABLES x BUCKETS rows and the dense state
        kinds, places, means, total = united(_numbers(sums, "kind"), _numbers(sums, "place"), [_numbers(sums, c) for c in names], _numbers(sums, "n"))
        means /= total[:, None]
        means /= FIXED
        state.take(kinds, places, means)
        del sums, means
        shared.unpersist()
        rng.permutation(min(n, TASK_ROWS))  # the next round draws anew
    state.model.bias = float(state.dense[-1][0])
    return state.model


def best_threshold(steps: np.ndarray, caught: np.ndarray, flagged: np.ndarray, ones: int, default: float) -> float:
    """The step with the best F1 by its counts (label 1 at or above it, all at or above it); the one nearest to the default among equals."""
    if ones < 5:
        return default
    f1 = [2 * c / max(1, a + ones) for c, a in zip(caught, flagged, strict=True)]
    best = max(f1)
    return float(min((t for t, f in zip(steps, f1, strict=True) if f >= best - 1e-12), key=lambda t: abs(t - default)))


def thresholds(scored: DataFrame, default: float, low: float = 0.1, high: float = 0.6) -> tuple[float, dict[str, float]]:
    """Threshold for all rows (score, label, lang) and those by language, from counts at each step of 0.02 inside [low, high]."""
    steps = np.round(np.arange(low, high + 1e-9, 0.02), 4)
    above = [(F.col("score") >= float(t)).cast("int") for t in steps]
    sums = scored.groupBy("lang").agg(F.sum("label").alias("ones"), *[F.sum(a).alias(f"a{j}") for j, a in enumerate(above)],
                                      *[F.sum(a * F.col("label")).alias(f"c{j}") for j, a in enumerate(above)]).collect()  # a row per language
    counts = {r["lang"]: (np.array([r[f"c{j}"] for j in range(len(steps))]), np.array([r[f"a{j}"] for j in range(len(steps))]), r["ones"]) for r in sums}
    if not counts:
        return default, {}
    whole = best_threshold(steps, *(sum(c[j] for c in counts.values()) for j in range(3)), default)
    return whole, {k: best_threshold(steps, *c, whole) for k, c in sorted((k, c) for k, c in counts.items() if k)}


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """All rows to learn from, stored once: hashed words of the whole text, label 0 or 1, and the ``extra`` columns.
    Labels grow with the texts, so they are never broadcast; the join takes the same form at every size."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(learn)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    return with_words(docs.select("doc_id", "text", *extra).filter(learn).join(known.hint("merge"), "doc_id"))


def with_words(rows: DataFrame) -> DataFrame:
    """The rows stored with ``words``, the hashed words of the text (null: none), in place of the text; training reads them in every round.
    They lie in the order of a hash of doc_id, so that neighbours in the given table don't meet in a step."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SCORE_BYTES):
            words = [hashed_words(t).tobytes() for t in utf8_texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(words, pa.binary())], names=[*keep, "words"])

    return materialize(rows.select(*keep, "text").mapInArrow(run, StructType([*(rows.schema[c] for c in keep), StructField("words", BinaryType())]))
                       .sortWithinPartitions(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "words"))


def score_words(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """Label, language and score of stored rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "words", SCORE_BYTES):
            s = shared.value.scores(_stored_words(part))
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("lang"), pa.array(s, pa.float64())], names=["label", "lang", "score"])

    return rows.select("label", "lang", "words").mapInArrow(run, "label int, lang string, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample_rows: int, sample_bytes: int,
                    extra: tuple[str, ...] = ()) -> list:
    """At most ``sample_rows`` labelled documents and ``sample_bytes`` of their text, in the order of a hash of the id; texts over
    1 / ``LARGEST`` of these bytes aren't learned from. Only these rows reach the driver. Warns of rows that the bytes leave out; if
    they leave none, it is as without labels."""
    rows = (labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(learn)
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    order = F.xxhash64("doc_id", F.lit("sample"))
    rows = rows.orderBy(order, "doc_id").limit(2 * sample_rows)
    # at most 2 x sample_rows ids and labels are broadcast
    found = (docs.select("doc_id", "text", *extra).join(F.broadcast(rows), "doc_id")
             .withColumn("text", F.coalesce("text", F.lit("")))
             .withColumn("text", F.when(F.octet_length("text") <= sample_bytes // LARGEST, F.col("text")))
             .orderBy(F.col("text").isNull(), order, "doc_id", "text").limit(sample_rows))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy(F.lit(0)).orderBy(F.col("text").isNull(), order, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("upto", upto).withColumn("text", F.when(F.col("upto") <= sample_bytes, F.col("text"))).drop("upto").collect()
    kept = [r for r in rows if r["text"] is not None]
    if len(kept) < len(rows):
        warnings.warn(f"{len(rows) - len(kept)} of {len(rows)} labelled texts are left out of the sample for {label} by its {sample_bytes} bytes", stacklevel=2)
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, sample_bytes: int | None = None, default: float = 0.3,
        seed: int = 7) -> ToxicityModel:
    """Train on all labelled rows that aren't held out; a fifth of them is kept apart to calibrate thresholds by language, then
    the model is trained on all of them. ``sample_rows`` or ``sample_bytes`` learn from a sample instead."""
    learn = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    if sample_rows or sample_bytes:
        kept = labelled_sample(docs, labels, "toxic", learn, sample_rows or 12000, sample_bytes or 48 << 20, ("lang",))
        rows = with_words(docs.sparkSession.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["label"]) for r in kept], "doc_id long, text string, lang string, label int"))
    else:
        rows = labelled(docs, labels, "toxic", learn, ("lang",))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 4
    part = train(rows.filter(~apart), seed=seed)
    threshold, by_language = thresholds(score_words(rows.filter(apart), part), default)
    model = train(rows, seed=seed)
    model.threshold, model.by_language = threshold, by_language
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and the score, in column ``name``, of every whole text; a kept text is sent to the task once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "text", SCORE_BYTES):
            s = m.scores([hashed_words(t) for t in utf8_texts(part.column("text"))])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, name])

    schema = StructType([*fields, StructField(name, DoubleType())])
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def limit_of(model: ToxicityModel, lang: Column) -> Column:
    """The threshold of a row's language."""
    out = F.lit(float(model.threshold))
    for k, v in model.by_language.items():
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut), threshold of the language, rejected (score >= threshold)."""
    model = fit(docs, labels, **options)
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    scored = score(docs, model, ("doc_id", "lang"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"),
                         limit_of(model, F.col("lang")).alias("threshold"),
                         (F.col("score") >= limit_of(model, F.col("lang"))).alias("rejected"))


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    model = fit(docs, labels, **options)
    scored = score(docs, model, tuple(docs.columns), "__toxic")
    limit = limit_of(model, F.col("lang")) if "lang" in docs.columns else F.lit(float(model.threshold))
    return scored.filter(F.col("__toxic") < limit).select(*docs.columns)
