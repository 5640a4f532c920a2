"""Jaccard join of word shingles with a token-group matrix.

Every whole text is the set of its distinct shingles (64-bit hashes); equal sets are one node. One global order of the shingles, those
in many documents last, gives each set a prefix that any similar set's prefix must meet. Then

1. similar documents are partitioned into groups: each document goes to the document with which most of its prefix is
   shared, and large groups are dealt into parts of bounded size, each with that leading document;
2. a group is opened on itself, and its links give first components;
3. the matrix says which group has which prefix shingle; a document queries the groups that share MEET of them, have fitting sizes and hold
   a larger component than its own (of two components the smaller one asks, so each pair of components is looked at from one side);
4. a query is bounded by its overlap with the token union of the group. Only a group that could hold a set with enough common
   shingles is opened, and its members are counted exactly.

No pair is lost: the prefix and the union are bounds of the true overlap, and groups that are one component with the query need not be asked.
The order is a hash order with frequent shingles moved to the end. Which are frequent is counted in two passes over all documents and kept
as bits of a table of at most ``most_bits``; a shingle that is wrongly taken as frequent moves for all sets alike, so the order
stays the same for all. If more shingles are frequent than the table holds, the bar rises.

Defined results: null, empty and white-space texts have an empty set and are linked with nothing; a null doc_id gets a null component;
repeated rows of an id are returned each, and link all texts of that id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import slices, utf8_texts
from airgrid.llm.links import components
from airgrid.llm.minhash import shingle_set
from airgrid.session import materialize

RARE = 32
#: Prefixes are so long that similar sets have this many of their prefix shingles in common.
MEET = 4


def least_common(n, percent: int):
    """Common shingles that a set of n needs with any set of that similarity."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """How many shingles of an ordered set of n must be looked at to meet any set of that similarity MEET times (or, in small sets, wholly)."""
    return min(n, n - least_common(n, percent) + MEET)


def is_frequent(tokens: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.zeros(len(tokens), bool)
    at = tokens & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def ordered(tokens: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    late = is_frequent(tokens, bits)
    return np.concatenate((tokens[~late], tokens[late]))


def emitted(docs: DataFrame, shingle: int, percent: int, bits) -> DataFrame:
    """One row per shingle to be counted: each set's prefix; in the second pass what follows it in sets with frequent ones, as far as
    their share there lets expect that the place of those is taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value if bits else None
        for part in slices(batches, "text", 2 << 20):
            out = [np.zeros(0, np.uint64)]
            for text in utf8_texts(part.column("text")):
                tokens = shingle_set(text, shingle)
                size = prefix_length(len(tokens), percent)
                if table is None:
                    out.append(tokens[:size])
                elif size and (late := is_frequent(tokens[:size], table).sum()):
                    rest = tokens[size:int(1.5 * size * size / max(size - late, 0.5)) + 8]
                    out.append(rest[~is_frequent(rest, table)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["token"])

    return docs.select("text").mapInArrow(run, "token bigint")


def table_of_bits(tokens: DataFrame, most_bits: int) -> np.ndarray | None:
    """A bit per hashed token, for those in more than RARE rows, or a higher bar if the table would be over a sixteenth full."""
    counts = materialize(tokens.groupBy("token").count().filter(F.col("count") > RARE))
    bar = RARE
    while (n := counts.filter(F.col("count") > bar).count()) > most_bits // 16:
        bar *= 2
    if not n:
        return None
    size = 1 << max(12, (16 * n - 1).bit_length())
    at = F.col("token").bitwiseAND(F.lit(size - 1))
    words = (counts.filter(F.col("count") > bar).groupBy(F.shiftright(at, 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def joined(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    """Both tables in one; the smaller one is repeated, as its index is the low bits of the larger one's."""
    if a is None or b is None:
        return a if b is None else b
    size = max(len(a), len(b))
    return np.tile(a, size // len(a)) | np.tile(b, size // len(b))


def sets(docs: DataFrame, shingle: int, percent: int, bits) -> DataFrame:
    """doc_id, n, hi, lo (identity of the set, null if empty) and prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value if bits else None
        for part in slices(batches, "text", 2 << 20):
            found = [shingle_set(t, shingle) for t in utf8_texts(part.column("text"))]
            size = np.array([len(s) for s in found], np.int64)
            keys = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) if len(s) else (0, 0) for s in found]
            keys = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            prefixes = [ordered(s, table)[:prefix_length(len(s), percent)] for s in found]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), *(pa.array(keys[:, i], mask=size == 0) for i in (0, 1)),
                                              pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "n", "hi", "lo", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, hi bigint, lo bigint, prefix array<bigint>")


def counted(members: list[np.ndarray], percent: int):
    """A function that gives, for a set, which members are similar; it looks at none if the overlap with their union is too small."""
    sizes = np.array([len(m) for m in members], np.int64)
    tokens = np.concatenate(members)
    order = np.argsort(tokens, kind="stable")
    union, first, n_of = np.unique(tokens[order], return_index=True, return_counts=True)
    owner = np.repeat(np.arange(len(members)), sizes)[order]

    def similar(query: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(union, query), len(union) - 1)
        at = at[union[at] == query]
        if 100 * len(at) < percent * len(query):
            return np.zeros(len(members), bool)
        n = n_of[at]
        rows = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[rows], minlength=len(members))
        return (common > 0) & (100 * common >= percent * (len(query) + sizes - common))

    return similar


def opened(members: list[tuple], queries: list[tuple], shingle: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links (a, b) of queries (id, component, text) with members in other components, one for each pair of components that is linked."""
    label = np.array([m[1] for m in members], np.int64)
    ids = [m[0] for m in members]
    similar = counted([shingle_set(m[2], shingle) for m in members], percent)
    known: dict[int, int] = {}  # components of queries that aren't among the members'
    for doc, component, text in queries:
        own = component
        while own in known:
            own = known[own]
        if (label == own).all():
            continue
        found = similar(shingle_set(text, shingle)) & (label != own)
        for i in np.flatnonzero(found):
            if label[i] != own:
                yield doc, ids[i]
                old, own = own, int(label[i])
                known[old] = own
                label[label == old] = own


def linked(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that opening each group gives; rows: grp, part, side (0 member, 1 query, 2 both), doc_id, component, text."""
    dealt = rows.repartition("grp", "part").sortWithinPartitions("grp", "part", "side", "doc_id")
    names = ("side", "doc_id", "component")

    def links(held: list[tuple]) -> pa.RecordBatch:
        members, queries = [h[1:] for h in held if h[0] != 1], [h[1:] for h in held if h[0] != 0]
        pairs = list(opened(members, queries, shingle, percent)) if members else []
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "part", *names)]
            for grp, part, *row, text in zip(*columns, utf8_texts(batch.column("text")), strict=True):
                if (grp, part) != key:
                    yield links(held)
                    key, held = (grp, part), []
                held.append((*row, text))
        yield links(held)

    return dealt.select("grp", "part", *names, "text").mapInArrow(run, "a bigint, b bigint")


def groups(tokens: DataFrame, sizes: DataFrame, most: int, most_tokens: int) -> DataFrame:
    """grp, part, doc_id, n: every node with a shared prefix shingle in one part of one group, and the leading document in each part."""
    lead = tokens.groupBy("token").agg(F.min("doc_id").alias("grp"))
    votes = tokens.join(lead, "token").filter("grp <> doc_id").groupBy("doc_id", "grp").agg(F.count("*").alias("votes")).filter(F.col("votes") >= MEET)
    best = votes.groupBy("doc_id").agg(F.max_by("grp", F.struct("votes", -F.col("grp"))).alias("grp"))
    homes = tokens.select("doc_id").distinct().join(best, "doc_id", "left").join(sizes, "doc_id")
    homes = materialize(homes.select("doc_id", F.coalesce("grp", "doc_id").alias("grp"), "n"))
    parts = homes.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / most_tokens)).alias("parts"))
    leaders = parts.select("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("grp").alias("doc_id"))
    dealt = homes.filter("grp <> doc_id").join(parts, "grp").select("grp", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id", "n")
    return dealt.unionByName(leaders.join(sizes, "doc_id"))


def with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the texts of their documents; merge joins at every size, as the ids grow with the corpus."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    return rows.join(texts.hint("merge"), "doc_id")


def relabelled(at: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, component after the links (a, b) have joined components."""
    side = lambda c: at.select(F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"))
    merged = components(links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("whole"))
    return at.join(merged, "component", "left").select("doc_id", F.coalesce("whole", "component").alias("component"))


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, most: int = 256, most_tokens: int = 1 << 19, most_bits: int = 1 << 30) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    spark = docs.sparkSession
    first = table_of_bits(emitted(docs, shingle, percent, None), most_bits)
    bits = spark.sparkContext.broadcast(first) if first is not None else None
    if bits:
        bits = spark.sparkContext.broadcast(joined(first, table_of_bits(emitted(docs, shingle, percent, bits), most_bits)))
    every = materialize(sets(docs, shingle, percent, bits))

    # one node for each set, and texts that share an id start as one component
    nodes = (every.filter("hi is not null and doc_id is not null").groupBy("hi", "lo")
             .agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "prefix"), "doc_id").alias("s")))
    nodes = materialize(nodes.select("hi", "lo", "doc_id", "s.n", "s.prefix"))
    tokens = nodes.select("doc_id", F.explode("prefix").alias("token"))
    several_texts = every.filter("hi is not null and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    repeated = not several_texts.isEmpty()
    tokens = tokens.distinct() if repeated else tokens
    shared = tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    tokens = materialize(tokens.join(shared, "token"))
    sizes = nodes.groupBy("doc_id").agg(F.max("n").alias("n"))
    parts = materialize(groups(tokens, sizes, most, most_tokens))

    at = nodes.select("doc_id", F.col("doc_id").alias("component")).distinct()
    several = parts.groupBy("grp", "part").count().filter("count > 1").select("grp", "part")
    inside = parts.join(several, ["grp", "part"]).select("grp", "part", F.lit(2).alias("side"), "doc_id", F.col("doc_id").alias("component"))
    inside = with_texts(materialize(inside), docs)
    inside = materialize(linked(inside, shingle, percent))
    at = materialize(relabelled(at, inside))

    more = materialize(linked(with_texts(asked(tokens, parts, nodes, at, percent), docs), shingle, percent))
    if repeated:  # an id's rows may have several sets, which then are one class
        held = every.select("doc_id", "hi", "lo").join(several_texts, "doc_id").join(nodes.select("hi", "lo", F.col("doc_id").alias("a")), ["hi", "lo"])
        held = materialize(held.select("doc_id", "a").distinct())
        more = more.unionByName(held.join(held.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").filter("a <> b").select("a", "b"))
    at = relabelled(at, more)
    of_set = nodes.select("hi", "lo", "doc_id").join(at, "doc_id").select("hi", "lo", F.col("component").alias("of_set"))
    out = every.select("doc_id", "n", "hi", "lo").join(of_set, ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id")).alias("component_id"))


def asked(tokens: DataFrame, parts: DataFrame, nodes: DataFrame, at: DataFrame, percent: int) -> DataFrame:
    """grp, part, side, doc_id, component of the groups that may hold a set similar to one outside: its members (0) and those sets (1)."""
    weight = at.groupBy("component").agg(F.count("*").alias("weight"))
    placed = at.join(weight, "component").select("doc_id", "component", F.struct("weight", "component").alias("rank"))
    own = materialize(parts.join(placed, "doc_id").select("grp", "part", "doc_id", "n", "component", "rank"))
    held = own.groupBy("grp", "part").agg(F.max("rank").alias("top"), F.min("n").alias("least"), F.max("n").alias("largest"))
    ranked = tokens.join(placed, "doc_id")
    live = ranked.groupBy("token").agg(F.max("rank").alias("r"), F.min("rank").alias("low")).filter("r <> low").select("token", "r")
    ranked = ranked.join(live, "token")
    matrix = ranked.select("token", "doc_id").join(own.select("doc_id", "grp", "part"), "doc_id").select("token", "grp", "part").distinct().join(held, ["grp", "part"])
    queries = ranked.filter(F.col("rank") < F.col("r")).select("token", "doc_id", "component", "rank").join(nodes.groupBy("doc_id").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high")), "doc_id")
    fits = (F.col("rank") < F.col("top")) & (100 * F.col("n_high") >= percent * F.col("least")) & (100 * F.col("largest") >= percent * F.col("n_low"))
    met = queries.join(matrix, "token").filter(fits).groupBy("grp", "part", "doc_id", "component", "n_low").agg(F.count("*").alias("met"))
    pairs = materialize(met.filter((F.col("met") >= MEET) | (100 * F.col("met") >= percent * F.col("n_low"))).select("grp", "part", "doc_id", "component"))
    members = own.join(pairs.select("grp", "part").distinct(), ["grp", "part"], "left_semi")
    return (members.select("grp", "part", F.lit(0).alias("side"), "doc_id", "component")
            .unionByName(pairs.select("grp", "part", F.lit(1).alias("side"), "doc_id", "component")))
