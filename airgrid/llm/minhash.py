"""Near duplicates by b-bit MinHash.

Every whole text becomes the set of its distinct word shingles (64-bit hashes). ``ROWS x BANDS``
minima are taken of each set; bands of ``ROWS`` full minima give the candidate buckets, and the low
``BITS`` bits of all minima are packed into longs. For candidates, equal slots are counted with bit
operations, the count is corrected for chance collisions, and pairs whose estimate is five standard
errors below the threshold are dropped. All others are confirmed on the full sets.

No group is squared: texts with equal sets are folded into one node first, each text is
then tried against two of the first members of its buckets (the likeliest and the one of least id), and only members of a bucket that
are still in different components are compared with each other. At a similarity of exactly 0.8 a
link is overlooked with a probability of 5e-8 by the bands and about 1e-6 by the estimate.

Defined results: null, empty and white-space texts have an empty set and are linked with nothing; a null
doc_id gets a null component and stays; repeated rows of a doc_id are returned each and are one node; other columns are
ignored by ``near_duplicates`` and returned by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import slices, utf8_texts
from airgrid.llm.links import components
from airgrid.session import materialize

ROWS, BANDS, BITS = 4, 32, 4
SLOTS = ROWS * BANDS
PACKED = SLOTS * BITS // 64
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = np.random.default_rng(20).integers(1, 2 ** 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the ``shingle``-word shingles; fewer words give one shingle, none an empty set."""
    words = text.translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(h))
    out = h[:len(h) - size + 1].copy()
    for k in range(1, size):
        out = mixed(out + _MIX) + h[k:len(h) - size + 1 + k]
    return np.unique(mixed(out + np.uint64(size)))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (texts, PACKED) and band hashes (texts, BANDS) of non-empty sets."""
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    minima = np.empty((len(sets), SLOTS), np.uint64)
    product = np.empty_like(values)
    for k in range(SLOTS):
        np.multiply(values, _FACTORS[k], out=product)
        minima[:, k] = np.minimum.reduceat(product, starts)
    low = mixed(minima) & np.uint64((1 << BITS) - 1)
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    packed = np.bitwise_or.reduce(low.reshape(len(sets), PACKED, -1) << shifts, axis=2)
    bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
    for k in range(ROWS):
        bands = mixed(bands + _MIX) ^ minima.reshape(len(sets), BANDS, ROWS)[:, :, k]
    return packed, mixed(bands)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, and for texts with words set_hi, set_lo (identity of the set), packed and bands."""
    schema = "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, packed array<bigint>, bands array<bigint>"

    def arrays(rows: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
        filled = np.zeros(n, bool)
        filled[of] = True
        offsets = np.concatenate(([0], np.cumsum(np.where(filled, rows.shape[1], 0)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.view(np.int64).ravel()), mask=pa.array(~filled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            sets = [shingle_set(t, shingle) for t in utf8_texts(part.column("text"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            of = np.flatnonzero(sizes)
            packed, bands = signatures([sets[i] for i in of]) if len(of) else (np.zeros((0, PACKED), np.uint64), np.zeros((0, BANDS), np.uint64))
            keys = np.zeros((len(sets), 2), np.uint64)
            for i in of:
                whole = xxhash.xxh3_128_intdigest(sets[i].tobytes())
                keys[i] = whole >> 64, whole & (2 ** 64 - 1)
            hi, lo = (pa.array(keys[:, j].view(np.int64), mask=sizes == 0) for j in (0, 1)) if len(sets) else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), hi, lo, arrays(packed, of, len(sets)), arrays(bands, of, len(sets))],
                                             names=["doc_id", "n_shingles", "set_hi", "set_lo", "packed", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def equal_slots(a: Column, b: Column) -> Column:
    """Number of equal slots of two packed signatures."""
    differ = F.lit(0)
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones = ones - (1 << 64) if ones >> 63 else ones
    for i in range(PACKED):
        x = a[i].bitwiseXOR(b[i])
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return F.lit(SLOTS) - differ


def estimated(a: Column, b: Column) -> Column:
    """Similarity estimate of two packed signatures, corrected for slots that are equal by chance."""
    chance = 1 / (1 << BITS)
    return (equal_slots(a, b) / SLOTS - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Five standard errors below the similarity threshold."""
    chance = 1 / (1 << BITS)
    p = percent / 100 + (1 - percent / 100) * chance
    return (p - 5 * (p * (1 - p) / SLOTS) ** 0.5 - chance) / (1 - chance)


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 x intersection >= percent x union of the full shingle sets."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # merge joins at every size: a broadcast of ids would only suit small corpora
    texts = texts.join(wanted.hint("merge"), "id", "left_semi")
    both = (pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None  # rows of one text often follow each other
        for part in slices(batches, "text_a", 4 << 20):
            keep = np.zeros(part.num_rows, bool)
            for i, (ta, tb) in enumerate(zip(utf8_texts(part.column("text_a")), utf8_texts(part.column("text_b")), strict=True)):
                if ta != last:
                    last, of_last = ta, shingle_set(ta, shingle)
                other = shingle_set(tb, shingle)
                common = len(np.intersect1d(of_last, other, assume_unique=True))
                keep[i] = common > 0 and 100 * common >= percent * (len(of_last) + len(other) - common)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def across_components(members: DataFrame, packed: DataFrame, docs: DataFrame, shingle: int, percent: int, tile: int = 256) -> DataFrame:
    """Links between members (key, doc_id, component) of a bucket in different components.

    The commonest component of a bucket names a unit; a unit's documents are those of all its buckets. Only its documents of
    other components are compared, with all of the unit, in tiles of ``tile`` x ``tile``; a tile returns links, not pairs.
    Any two members of a bucket meet in the unit of that bucket.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("unit"), F.count("*").alias("parts")).filter("parts > 1").select("key", "unit")
    units = materialize(members.join(main, "key").select("unit", "doc_id", "component").distinct())
    sizes = units.groupBy("unit").agg(F.ceil(F.count("*") / tile).alias("all"), F.ceil(F.count(F.when(F.col("component") != F.col("unit"), 1)) / tile).alias("others"))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(units.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").join(packed.hint("merge"), "doc_id")
    rows = units.join(sizes, "unit").join(texts.hint("merge"), "doc_id")
    spot = F.xxhash64("doc_id", F.lit("tile"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    left = rows.filter("component <> unit").select("unit", F.pmod(spot, F.col("others")).alias("i"), upto(F.col("all")).alias("j"), F.lit(0).alias("side"), "doc_id", "component", "packed", "text")
    right = rows.select("unit", upto(F.col("others")).alias("i"), F.pmod(spot, F.col("all")).alias("j"), F.lit(1).alias("side"), "doc_id", "component", "packed", "text")
    tiles = left.unionByName(right).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "side")
    least = int(np.ceil(SLOTS * (least_estimate(percent) * (1 - 0.5 ** BITS) + 0.5 ** BITS) - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("unit", "i", "j", "side", "doc_id", "component", "packed")), utf8_texts(batch.column("text")), strict=True)
            for row in rows:
                if row[:3] != key:
                    yield from _tile_links(held, shingle, percent, least)
                    key, held = row[:3], []
                held.append(row[3:])
        yield from _tile_links(held, shingle, percent, least)

    return tiles.mapInArrow(run, "a bigint, b bigint")


def _tile_links(rows: list[tuple], shingle: int, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Links of the left rows (side 0) with the right ones (side 1), at most one for a left row and a component."""
    left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    if not left or not right:
        return
    signs = np.array([r[3] for r in right], np.int64).view(np.uint64)
    ids, parts = np.array([r[1] for r in right]), np.array([r[2] for r in right])
    sets: dict[int, np.ndarray] = {}
    ones = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    found: list[tuple[int, int]] = []
    for _, doc, component, sign, text in left:
        x = signs ^ np.array(sign, np.int64).view(np.uint64)[None, :]
        for step in (1, 2):
            x |= x >> np.uint64(step)
        likely = np.flatnonzero((SLOTS - np.bitwise_count(x & ones).sum(1, dtype=np.int64) >= least) & (parts != component))
        if not len(likely):
            continue
        for k in likely:
            if k not in sets:
                sets[k] = shingle_set(right[k][4], shingle)
        own, others = shingle_set(text, shingle), [sets[k] for k in likely]
        lengths = np.array([len(o) for o in others])
        flat = np.concatenate(others)
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
        linked = likely[100 * common >= percent * (len(own) + lengths - common)]
        found += {parts[k]: (doc, int(ids[k])) for k in linked}.values()
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with their component under ``links``."""
    found = components(links).withColumnRenamed("id", "doc_id")
    return nodes.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row per row of ``docs``."""
    sketch = materialize(sketches(docs, shingle))
    nodes = materialize(sketch.filter("set_hi is not null and doc_id is not null").groupBy("set_hi", "set_lo")
                        .agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("packed", "bands"), "doc_id").alias("s"))
                        .select("set_hi", "set_lo", "doc_id", "s.packed", "s.bands"))
    packed = nodes.select("doc_id", "packed")
    members = nodes.select(F.explode("bands").alias("key"), "doc_id")
    groups = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
    members = materialize(members.join(groups, "key"))  # buckets with at least two texts

    # each text against the likeliest and the first of its buckets' first members
    stars = members.filter("lead <> doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = (stars.join(packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa")), "a")
             .join(packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb")), "b")
             .select("a", "b", estimated(F.col("pa"), F.col("pb")).alias("s")).filter(F.col("s") >= least_estimate(percent)))
    stars = stars.groupBy("b").agg(F.max_by("a", F.struct("s", -F.col("a"))).alias("best"), F.min("a").alias("first"))
    stars = materialize(stars.select("b", F.explode(F.array_distinct(F.array("best", "first"))).alias("a")))
    links = confirmed(stars, docs, shingle, percent)
    at = materialize(labelled(nodes.select("doc_id"), links))
    # then all members of a bucket whose components still differ; what they link is components
    more = materialize(across_components(members.join(at, "doc_id"), packed, docs, shingle, percent))
    if not more.isEmpty():
        side = lambda c: at.select(F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"))
        merged = components(more.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        at = at.join(merged.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("doc_id", F.coalesce("whole", "component").alias("component"))
    at = nodes.select("set_hi", "set_lo", "doc_id").join(at, "doc_id").select("set_hi", "set_lo", F.col("component").alias("of_set"))
    out = sketch.select("doc_id", "n_shingles", "set_hi", "set_lo").join(at, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, with all their columns."""
    dropped = near_duplicates(docs, shingle, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
