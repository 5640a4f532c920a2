"""Quality rules with cross-document line frequency.

One pass over whole texts gives each document's counts and its distinct lines: a 64-bit hash of the normalised line (lower-cased, digits
made 0, white space collapsed) and its words. Spark counts a line's documents per host; lines in more than ``most`` documents of a host
are removed, whatever the size of the host. A document is rejected when it fails the base rules (fewer than 50 words, or over half
of its words in repeated three-word windows), has more than ``symbols`` symbols a word, more than ``repeats`` of its lines
are repeats, or is depleted: less than ``left`` of its words, or fewer than ``LEAST`` words (the base minimum again), are left after the removal.

Lines are counted by (host, hash), combined before the shuffle. The removed lines grow with the corpus, so lines meet them in a shuffle;
only those with more than a ``HOT`` x partitions-th of all removed rows, of which there are fewer than that, are broadcast. So neither a
host with a third of all documents nor a line that most documents have meets one task.

Defined results: null and empty texts have no words and fail; null hosts are one host; repeated rows are a document each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import slices, utf8_texts
from airgrid.llm.minhash import mixed
from airgrid.session import materialize

SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
WINDOW = 3
HOT = 4
LEAST = 50


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice in the text."""
    if len(words) <= WINDOW:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WINDOW + 1
    windows = mixed(mixed(h[:n] + np.uint64(1)) + h[1:n + 1]) * np.uint64(3) + h[2:]
    order = np.argsort(mixed(windows))
    run = windows[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(WINDOW):
        covered[k:k + n] |= twice
    return int(covered.sum())


def measures(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, and hashes and words of the distinct lines."""
    words = text.split()
    points = len(text) - sum(map(text.count, SPACES)) - int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    normal = {}
    for line in lines:
        parts = line.translate(_NORMAL).split()
        key = xxhash.xxh3_64_intdigest(b" ".join(parts))
        normal[key] = normal.get(key, 0) + len(parts)
    return len(words), points, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), list(normal), list(normal.values())


def described(docs: DataFrame) -> DataFrame:
    """doc_id, host, the measures, and lines: (hash, words) of the distinct normalised lines."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    schema = "doc_id bigint, host string, " + ", ".join(f"{n} bigint" for n in names) + ", hashes array<bigint>, words array<bigint>"

    def lists(values: list[list[int]], kind) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        flat = np.fromiter((x for v in values for x in v), kind, int(offsets[-1])).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [measures(t) for t in utf8_texts(part.column("text"))]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *columns, lists([r[6] for r in rows], np.uint64), lists([r[7] for r in rows], np.int64)],
                                             names=["doc_id", "host", *names, "hashes", "words"])

    host = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), host.alias("host"), "text").mapInArrow(run, schema)


def frequent_lines(found: DataFrame, most: int) -> DataFrame:
    """host, hash, n (documents of the host that have the line) of the lines above the limit."""
    lines = found.select("host", F.explode("hashes").alias("hash"))
    return lines.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") > most)


def removed_words(found: DataFrame, bad: DataFrame) -> DataFrame:
    """row, n_removed_words of the documents that lose lines."""
    lines = found.select("row", "host", F.explode(F.arrays_zip("hashes", "words")).alias("l")).select("row", "host", F.col("l.hashes").alias("hash"), F.col("l.words").alias("words"))
    parts = HOT * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = (bad.agg(F.sum("n")).first()[0] or 0) // parts
    named = bad.select(F.col("host").alias("of"), F.col("hash").alias("key"), "n")
    same = F.col("host").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("key"))
    marked = lines.join(F.broadcast(named.filter(F.col("n") > limit)), same, "left")  # fewer than ``parts`` rows are broadcast
    near = marked.filter(F.col("key").isNotNull()).select("row", "words")
    far = marked.filter(F.col("key").isNull()).select(*lines.columns).join(named.filter(F.col("n") <= limit).hint("merge"), same).select("row", "words")
    return near.unionByName(far).groupBy("row").agg(F.sum("words").alias("n_removed_words"))


def apply_rules(docs: DataFrame, most: int = 6, symbols: float = 0.5, repeats: float = 0.5, left: float = 0.4) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words."""
    found = materialize(described(docs).withColumn("row", F.monotonically_increasing_id()))
    removed = removed_words(found, materialize(frequent_lines(found, most)))
    df = found.join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    n = F.col("n_words")
    kept_words = n - F.col("n_removed_words")
    base_failed = (n < LEAST) | (F.col("n_repeat_words") * 100 > n * 50)
    sound = (F.col("n_symbols") <= n * symbols) & (F.col("n_dup_lines") <= F.col("n_lines") * repeats) & (kept_words >= n * left) & (kept_words >= LEAST)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & sound).alias("kept"), "n_removed_words")
