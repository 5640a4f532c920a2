"""Quality classifier: attention-based multiple-instance learning over passages, trained in numpy and applied by Spark.

A text is a bag of passages of ``PASSAGE`` bytes, all of them; only the bag has a label. A passage is described by the frequencies of
pairs of byte classes and by how far it repeats itself at short distances, and encoded by a tanh layer. Gated attention weighs
the encoded passages, and the weighted sum gives the document's score by a logistic output. The model is
fitted on the driver from a bounded sample of labelled documents (``sample_rows`` rows, ``sample_bytes`` of text, in the order of a hash of
doc_id) and broadcast (100 KB whatever the corpus).

Defined results: null and empty texts are scored as one empty passage; a null label isn't learned from, repeated label rows of a document
count once (the larger label); repeated documents are each scored; without labels all scores are 0.5 and with one class only they are that
class's; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import fold, slices, utf8_texts
from airgrid.llm.toxicity import labelled_sample

PASSAGE = 512
FOLDS, HELD_OUT = 3, 1
LAGS = range(2, 17)


def _classes() -> np.ndarray:
    """Class of each byte: single marks on their own, the rest by kind."""
    groups = [b" ", b"\n", b"\t\r\v\f", b"0123456789", bytes(range(65, 91)), b"aeiouy", b"bcdfghjklmnpqrstvwxz", *(bytes([c]) for c in b"#*$%&|<>!?.,"), b"=_/\\@", b"\"'`()[]{}"]
    out = np.full(256, len(groups), np.uint8)
    out[128:] = len(groups) + 1
    for k, g in enumerate(groups):
        out[list(g)] = k
    return out


CLASS = _classes()
N_CLASS = int(CLASS.max()) + 1
FEATURES = N_CLASS * N_CLASS + len(LAGS) + 1


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and each text's first passage."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    out = np.zeros((total, FEATURES), np.float32)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return out, first
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(data))
    passage = np.repeat(first, sizes) + (at - np.repeat(starts, sizes)) // PASSAGE
    del at
    kinds = CLASS[data].astype(np.int64)
    inside = passage[:-1] == passage[1:]
    pair = (passage[:-1] * (N_CLASS * N_CLASS) + kinds[:-1] * N_CLASS + kinds[1:])[inside]
    out[:, :N_CLASS * N_CLASS] = np.bincount(pair, minlength=total * N_CLASS * N_CLASS).reshape(total, -1)
    length = np.bincount(passage, minlength=total).astype(np.float32)
    out[:, :N_CLASS * N_CLASS] *= 20 / np.maximum(length, 1)[:, None]
    for k, lag in enumerate(LAGS):
        if len(data) > lag:
            same = (data[:-lag] == data[lag:]) & (passage[:-lag] == passage[lag:])
            out[:, N_CLASS * N_CLASS + k] = np.bincount(passage[:-lag][same], minlength=total)[:total] * 2 / np.maximum(length, 1)
    out[:, -1] = length / PASSAGE
    return out, first


def all_passages(texts: list[bytes], most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Like ``passages``, as half floats; worked out for about ``most_bytes`` of text at a time, as temporary arrays have several words a byte."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    first = np.cumsum(counts) - counts
    out = np.empty((int(counts.sum()), FEATURES), np.float16)
    start, held = 0, 0
    for i, text in enumerate([*texts, None]):
        if text is None or (held and held + len(text) > most_bytes):
            part = passages(texts[start:i])[0] if i > start else out[:0]
            at = first[start] if i > start else 0
            out[at:at + len(part)] = part
            start, held = i, 0
        held += len(text or b"")
    return out, first


@dataclass
class QualityModel:
    encode: np.ndarray   # (features, hidden)
    offset: np.ndarray
    value: np.ndarray    # gated attention: tanh branch
    gate: np.ndarray     # sigmoid branch
    weigh: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.encode, self.offset, self.value, self.gate, self.weigh, self.output, self.bias]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        h = np.tanh(x @ self.encode + self.offset)
        t, g = np.tanh(h @ self.value), 1 / (1 + np.exp(-np.clip(h @ self.gate, -30, 30)))
        e = (t * g) @ self.weigh
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        p = 1 / (1 + np.exp(-np.clip((z @ self.output + self.bias[0]).astype(np.float64), -40, 40)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "sizes": sizes}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*passages(texts))["p"] if texts else np.zeros(0)


def start_model(hidden: int, attention: int, rng) -> QualityModel:
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return QualityModel(small(FEATURES, hidden), np.zeros(hidden, np.float32), small(hidden, attention), small(hidden, attention), small(attention), small(hidden), np.zeros(1, np.float32))


def train(texts: list[bytes], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 12, batch: int = 64, rate: float = 0.003, decay: float = 1e-4, seed: int = 11) -> QualityModel:
    """Adam on the mean logistic loss of documents."""
    rng = np.random.default_rng(seed)
    m = start_model(hidden, attention, rng)
    labels = np.asarray(labels, np.float64)
    if not len(texts) or labels.min() == labels.max():
        m.output[:] = 0
        m.bias[0] = 0 if not len(texts) else 40 if labels.max() else -40
        return m
    rows, first = all_passages(texts)
    ends = np.append(first[1:], len(rows))
    m.bias[0] = np.log(labels.mean() / (1 - labels.mean()))
    params = m.parts()
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            x = np.concatenate([rows[first[i]:ends[i]] for i in part]).astype(np.float32)
            sizes = ends[part] - first[part]
            f = m.forward(x, np.cumsum(sizes) - sizes)
            d = ((f["p"] - labels[part]) / len(part)).astype(np.float32)
            d_z = d[:, None] * m.output[None, :]
            each = np.repeat(d_z, sizes, axis=0)
            d_a = (each * f["h"]).sum(1)
            centre = np.add.reduceat(d_a * f["a"], np.cumsum(sizes) - sizes)
            d_e = f["a"] * (d_a - np.repeat(centre, sizes))
            d_t = d_e[:, None] * m.weigh * f["g"] * (1 - f["t"] ** 2)
            d_g = d_e[:, None] * m.weigh * f["t"] * f["g"] * (1 - f["g"])
            d_h = (f["a"][:, None] * each + d_t @ m.value.T + d_g @ m.gate.T) * (1 - f["h"] ** 2)
            grads = [x.T @ d_h, d_h.sum(0), f["h"].T @ d_t, f["h"].T @ d_g, (f["t"] * f["g"]).T @ d_e, f["z"].T @ d, np.array([d.sum()])]
            step += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g + decay * p
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.001 * (g * g - square[i])
                p -= rate * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 5000, sample_bytes: int = 20 << 20, seed: int = 11) -> QualityModel:
    rows = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD_OUT, sample_rows, sample_bytes)
    texts, known = [r["text"].encode() for r in rows], np.array([r["label"] for r in rows])
    del rows
    return train(texts, known, seed=seed)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            s = shared.value.scores(utf8_texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
