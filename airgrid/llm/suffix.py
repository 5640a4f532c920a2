"""Removal of repeated 200-byte strings by per-shard suffix arrays.

1. Anchors. Each window of ``WINDOW`` bytes has one anchor, its leftmost ``GRAM``-byte string of least hash, so that equal windows have equal anchors.
   Neighbouring windows with the same anchor form a context; every window is in exactly one. A context whose anchor occurs once in the corpus
   holds no repeat. Equal contexts are folded into one with their number; all their windows are repeats if there are two or more.
2. Shards. Contexts that differ but share an anchor meet in a shard, one copy each. A shard's suffix array is built by
   Larsson-Sadakane refinement: sort by 8 bytes, then refine only the groups that are still equal by the rank ``h`` places on,
   doubling ``h`` until it covers a window. Kasai's rule gives the common prefix with the suffix in front, many contexts abreast.
   A window with a common prefix of ``WINDOW`` bytes with a neighbour is a repeat.
3. Merging. An anchor with more than ``RUN`` contexts is dealt over several shards; every two of them are merged by binary search of the
   windows of one in the suffix array of the other. Results are windows, so no shard returns pairs.
4. The repeated windows of each text are joined to the text, and the bytes that they cover are removed.

Only 64-bit hashes decide which contexts are equal or share an anchor; different texts with equal (anchor, context) hashes, 128 bits together, are
not expected at any size. Hashes and windows are those of the input, never of what is left.

Defined results: null texts are empty; texts under ``WINDOW`` bytes lose nothing; repeated rows, also of the same id, repeat each other and so lose
their windows; a null id is returned as such; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import slices, utf8_texts
from airgrid.llm.minhash import mixed
from airgrid.session import materialize

WINDOW, GRAM = 200, 48
SPAN = WINDOW - GRAM + 1  # anchor positions in a window
RUN = 6000
SHARD_BYTES = 2 << 20


# --- anchors and contexts -------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, big-endian; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 48 bytes from each position on."""
    h = mixed(_words(data))

    def join(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        out = a * np.uint64(0x9E3779B97F4A7C15)
        out[:-by] += b[by:]
        return mixed(out)

    h16 = join(h, h, 8)
    return join(join(h16, h16, 16), h16, 32)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` neighbours."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text number, anchor hash, context hash, first window and number of windows of all contexts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = b"".join(texts)
    none = tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(joined) < WINDOW:
        return none
    hashes = gram_hashes(np.frombuffer(joined, np.uint8))
    place = np.arange(len(joined), dtype=np.uint64)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | place
    at = (_sliding_least(keys, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:len(joined) - WINDOW + 1]
    of = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
    good = np.arange(len(at)) + WINDOW <= (starts + sizes)[of]
    change = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (good[1:] != good[:-1]))))
    ends = np.append(change[1:], len(at))
    keep = good[change]
    first, last = change[keep], ends[keep]
    if not len(first):
        return none
    anchor_at = at[first]
    content = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b + WINDOW - 1]) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    content = mixed(content + (anchor_at - first).astype(np.uint64))
    return of[first], hashes[anchor_at], content, first - starts[of[first]], last - first


# --- suffix arrays --------------------------------------------------------

def suffix_array(data: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by ``depth`` bytes at least, and whether each one in this order is the first of a group of suffixes
    that are equal so far."""
    n = len(data)
    words = _words(data)
    order = np.argsort(words)
    head = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0  # the end comes first
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group + 1
    h = 8
    while h < depth:
        alone = head & np.append(head[1:], True)
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        suffixes = order[active]
        key = (rank[suffixes].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(suffixes + h, n)].astype(np.uint64)
        by = np.argsort(key)
        suffixes, key = suffixes[by], key[by]
        order[active] = suffixes
        head[active] = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[suffixes] = group[active] + 1
        h *= 2
    return order, head


def common_prefixes(words: np.ndarray, order: np.ndarray, head: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix, up to WINDOW, of each suffix and the one in front of it in ``order``, by Kasai's rule: going on by one position
    loses one byte at most. All contexts go on abreast. Suffixes that aren't the first of their group share WINDOW bytes and more with
    the one in front; as groups are unordered inside, the rule only leads from one first suffix to the next.
    ``words``: the 8 bytes from each position on."""
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    leads = np.empty(n, bool)
    leads[order] = head
    out = np.full(n, WINDOW, np.int64)
    lane, at, h = np.arange(len(first)), first.copy(), np.zeros(len(first), np.int64)
    led = np.zeros(len(first), bool)
    step = 0
    while len(lane):
        here = leads[at]
        other = np.where(here, before[at], -1)
        h = np.where((other >= 0) & led, np.maximum(h - 1, 0), 0)
        going = np.flatnonzero((other >= 0) & (h < WINDOW))
        while len(going):
            a, b = at[going] + h[going], other[going] + h[going]
            inside = (a < n) & (b < n)
            going, a, b = going[inside], a[inside], b[inside]
            differ = words[a] ^ words[b]
            equal = differ == 0
            same = np.full(len(going), 8)
            rest = differ[~equal]
            # leading zero bytes of the difference
            lead = np.zeros(len(rest), np.int64)
            open_ = np.ones(len(rest), bool)
            for k in range(7):
                open_ &= (rest >> np.uint64(56 - 8 * k)) & np.uint64(255) == 0
                lead += open_
            same[~equal] = lead
            h[going] += same
            going = going[equal & (h[going] < WINDOW)]
        out[at[here]] = np.minimum(h, WINDOW)[here]
        step += 1
        more = sizes[lane] > step
        lane, h, led = lane[more], h[more], here[more]
        at = first[lane] + step
    return out


def _repeats_inside(texts: list[bytes]) -> list[np.ndarray]:
    """For each context, which of its windows also start in another one."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    first, windows = np.cumsum(sizes) - sizes, sizes - WINDOW + 1
    order, head = suffix_array(data)
    valid = np.zeros(len(data), bool)
    valid[np.repeat(first, windows) + (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))] = True
    prefix = common_prefixes(_words(data), order, head, first, sizes)
    group = np.cumsum(prefix[order] < WINDOW)  # of suffixes with equal windows
    inside = valid[order]
    order, group = order[inside], group[inside]
    same = group[1:] == group[:-1]
    hit = np.zeros(len(data), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[a:a + w] for a, w in zip(first, windows, strict=True)]


def _below(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether window a is below window b, and whether they are equal; ``words`` as in ``common_prefixes``."""
    less, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    going = np.arange(len(a))
    for k in range(0, WINDOW, 8):
        x, y = words[a[going] + k], words[b[going] + k]
        apart = x != y
        less[going[apart]] = x[apart] < y[apart]
        same[going[apart]] = False
        going = going[~apart]
        if not len(going):
            break
    return less, same


def _repeats_between(left: list[bytes], right: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows of the left contexts that start in the right ones, and the other way round, by binary search in the right suffix array."""
    both = left + right
    data = np.frombuffer(b"".join(both), np.uint8)
    words = _words(data)
    sizes = np.array([len(t) for t in both])
    first, windows = np.cumsum(sizes) - sizes, sizes - WINDOW + 1
    cut = int(sizes[:len(left)].sum())
    valid = np.zeros(len(data), bool)
    valid[np.repeat(first, windows) + (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))] = True
    order, _ = suffix_array(data[cut:])
    order = order[valid[cut:][order]] + cut
    asked = np.flatnonzero(valid[:cut])
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(order), np.int64)
    while True:  # lower bound of each asked window
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        less, _ = _below(words, order[middle], asked[open_])
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    hit = np.zeros(len(data), bool)
    there = np.flatnonzero(low < len(order))
    _, same = _below(words, order[low[there]], asked[there])
    there = there[same]
    hit[asked[there]] = True
    # the equal windows on the right: all places from the lower bound on that stay equal to it
    starts = np.unique(low[there])
    while len(starts):
        hit[order[starts]] = True
        starts = starts[starts + 1 < len(order)]
        _, same = _below(words, order[starts], order[starts + 1])
        starts = starts[same] + 1
    parts = [hit[a:a + w] for a, w in zip(first, windows, strict=True)]
    return parts[:len(left)], parts[len(left):]


def _runs(hit: np.ndarray) -> list[int]:
    """Flat list of first and end of the runs of true windows."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), 1).ravel().tolist()


# --- the Spark job --------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key for equal rows (id, hash of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumns({"k1": F.coalesce("doc_id", F.lit(-(1 << 62))), "k2": F.xxhash64("text")})


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            of, anchor, content, first, windows = contexts(utf8_texts(part.column("text")))
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([part.column("k1").take(of), part.column("k2").take(of), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                                              pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32))], names=["k1", "k2", "anchor", "context", "first", "windows"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, anchor bigint, context bigint, first int, windows int")


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, context, bytes of the wanted contexts (k1, k2, anchor, context, first, windows)."""
    per = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "windows", "anchor", "context")).alias("w"))  # bounded by the text
    rows = docs.join(per.hint("merge"), ["k1", "k2"]).select("text", F.col("w.first").alias("first"), F.col("w.windows").alias("windows"), F.col("w.anchor").alias("anchor"), F.col("w.context").alias("context"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            out: list[list] = [[], [], []]
            for text, first, windows, anchor, context in zip(utf8_texts(part.column("text")), *(part.column(c).to_pylist() for c in ("first", "windows", "anchor", "context")), strict=True):
                out[0] += anchor
                out[1] += context
                out[2] += [text[a:a + n + WINDOW - 1] for a, n in zip(first, windows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["anchor", "context", "bytes"])

    return rows.mapInArrow(run, "anchor bigint, context bigint, bytes binary").dropDuplicates(["anchor", "context"])


def _shard_repeats(found: DataFrame, run_size: int, shard_bytes: int) -> DataFrame:
    """anchor, context, runs: the windows of each context that also start in another context of its anchor."""
    sizes = found.groupBy("anchor").agg(F.ceil(F.count("*") / run_size).cast("int").alias("n"))
    rows = found.join(sizes, "anchor").withColumn("own", F.pmod(F.xxhash64("context", F.lit("run")), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "context", "bytes")
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "own")

    def emit(groups: list[tuple], hits: list[np.ndarray]) -> pa.RecordBatch:
        kept = [(a, c, _runs(h)) for (a, c), h in zip(groups, hits, strict=True) if h.any()]
        columns = [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple] = []  # contexts of whole groups with one run, searched together
        texts: list[bytes] = []
        held = 0
        key, pair = None, ([], [])

        def search() -> pa.RecordBatch:
            return emit(names, _repeats_inside(texts))

        def merge() -> pa.RecordBatch:
            (left, right) = pair
            a, b = _repeats_between([x[2] for x in left], [x[2] for x in right])
            return emit([x[:2] for x in left + right], a + b)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "i", "j", "own", "context", "bytes")), strict=True):
                if row[:3] != key:
                    if pair[0] and pair[1]:
                        yield merge()
                    key, pair = row[:3], ([], [])
                    if held > shard_bytes:
                        yield search()
                        names, texts, held = [], [], 0
                anchor, i, j, own, context, content = row
                if i == j:
                    names.append((anchor, context))
                    texts.append(content)
                    held += len(content)
                else:
                    pair[int(own == j)].append((anchor, context, content))
        if pair[0] and pair[1]:
            yield merge()
        if texts:
            yield search()

    return rows.mapInArrow(run, "anchor bigint, context bigint, runs array<int>")


def remove_repeats(docs: DataFrame, run_size: int = RUN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    cut = _cut(docs, run_size, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            rows = []
            for text, spans in zip(utf8_texts(part.column("text")), part.column("spans").to_pylist(), strict=True):
                kept, removed = kept_bytes(text, spans or [])
                rows.append((len(text), len(text) - len(kept), removed, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def kept_bytes(text: bytes, spans: list[int]) -> tuple[bytes, int]:
    """What is left without the spans (first, end, first, end, ...), and the number of maximal removed runs."""
    kept, at, removed = [], 0, 0
    for first, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if removed and first <= at:
            at = max(at, end)
            continue
        kept.append(text[at:first])
        at, removed = end, removed + 1
    kept.append(text[at:])
    return b"".join(kept), removed


def _cut(docs: DataFrame, run_size: int, shard_bytes: int) -> DataFrame:
    """doc_id, text and spans: byte ranges of the text that repeats cover, as a flat list."""
    keyed = _keyed(docs)
    every = materialize(_scan(keyed))
    anchors = every.select("anchor").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    again = materialize(every.join(anchors, "anchor", "left_semi"))
    place = F.struct("k1", "k2", "first", "windows")
    folded = materialize(again.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    several = folded.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor")
    wanted = folded.join(several, "anchor", "left_semi").select("at.k1", "at.k2", "anchor", "context", "at.first", "at.windows")
    found = materialize(_fetched(keyed, wanted))
    runs = _shard_repeats(found, run_size, shard_bytes)
    whole = folded.filter("n > 1").select("anchor", "context", F.array(F.lit(0), F.col("at.windows")).alias("runs"))
    repeats = whole.unionByName(runs).groupBy("anchor", "context").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # at most one list a shard
    per = again.join(repeats, ["anchor", "context"]).select("k1", "k2", spans_at(F.col("first"), F.col("runs")).alias("spans"))
    # rows with equal id and text have the same keys: a set holds their spans once, so it is bounded by the text
    per = per.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return keyed.join(per.hint("merge"), ["k1", "k2"], "left")


def spans_at(first: Column, runs: Column) -> Column:
    """Byte ranges of the windows: starts stay, ends reach WINDOW - 1 bytes further."""
    return F.transform(runs, lambda x, i: F.when(i % 2 == 0, x + first).otherwise(x + first + (WINDOW - 1)))
