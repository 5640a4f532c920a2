"""Mixing sources to target weights, in DataFrame and SQL functions only.

Targets: the sources, by code point and null last, weigh 3, 1, 2 in turn and share ``share`` times all words; a target stops at
``most`` times its source, and the excess goes to the others by weight until none is above (one water level for all, found with
running sums over one row per source).

Draws: a source's documents are hashed into blocks, and the blocks are permuted by a hash. Whole passes take every block; the last pass
takes the permuted blocks up to the words that are left, and cuts the block, and in it the one document, at the boundary. A splitting
tree spreads the drawn blocks over the output shards: at each node the left half's share of every source is a
hypergeometric draw, given what is left (exact quotas, no global permutation). Ranges of the permuted blocks then
belong to one shard each, and a shard's documents are ordered by a hash.

What a document gives is read from its passes: the shards of its block in the whole passes, and that of the last one.
Shards grow with the corpus (a power of two with about ``SHARD_WORDS`` words each, up to a quarter of ``blocks``); a larger shard is
written in several pieces, so that no task holds more than about ``SHARD_WORDS`` words.

The tables that hold one row per block or per source and shard are bounded by ``blocks`` and ``shards``; documents meet
them by (source, block), so a source with a third of all rows is spread over its blocks. All draws are hashes: reruns agree.

Defined results: null or white-space texts have size 0 and are never taken; null sources are one source; repeated rows are
each a document; an empty table gives no rows; other columns are ignored by ``plan_mix`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airgrid.session import materialize

WEIGHTS = (3, 1, 2)
SHARD_WORDS = 1 << 23
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_no, n_docs, source_size, target from (source, size); windows see one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1).cast("double")
    per = per.withColumns({"w": weight, "cap": F.col("source_size") * most, "want": F.sum("source_size").over(every) * share})
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "source_no")
    below = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("want") - below) / above)
    # where the level first stays below the caps; it only sinks after that
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every)
    target = F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return per.select("source", "source_no", "n_docs", "source_size", target.alias("target"))


def _uniform(*keys) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Number of good among ``draws`` out of ``total`` by inversion, from the mode up and then down; weights are relative to the
    mode's, and 12 standard deviations on both sides leave less than 1e-30."""
    low, high = F.greatest(F.lit(0), draws + good - total), F.least(draws, good)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1.0) * (good + 1.0) / (total + 2.0))))
    spread = F.sqrt(draws * (good / F.greatest(total, F.lit(1))) * (total - good) / F.greatest(total, F.lit(1))) * 12 + 8
    up, down = F.least(high - mode, F.ceil(spread)), F.least(mode - low, F.ceil(spread))
    steps = F.array_union(F.sequence(F.lit(0).cast("bigint"), up), F.when(down > 0, F.sequence(F.lit(-1).cast("bigint"), -down)).otherwise(F.array().cast("array<bigint>")))

    def weight(acc: Column, j: Column) -> Column:
        k = mode + j
        rise = (good - k + 1.0) * (draws - k + 1.0) / (k * (total - good - draws + k) * 1.0)
        fall = (k + 1.0) * (total - good - draws + k + 1.0) / ((good - k) * (draws - k) * 1.0)
        return F.when(j == 0, F.lit(1.0)).when(j > 0, acc["w"] * rise).otherwise(F.when(j == -1, F.lit(1.0)).otherwise(acc["w"]) * fall)

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"))
    whole = F.aggregate(steps, zero, lambda acc, j: F.struct(weight(acc, j).alias("w"), (acc["sum"] + weight(acc, j)).alias("sum")), lambda acc: acc["sum"])
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), mode.alias("k"), F.lit(False).alias("done"), whole.alias("whole"))

    def pick(acc: Column, j: Column) -> Column:
        w = weight(acc, j)
        now = acc["sum"] + w
        return F.struct(w.alias("w"), now.alias("sum"), F.when(acc["done"], acc["k"]).otherwise(mode + j).alias("k"),
                        (acc["done"] | (now >= u * acc["whole"])).alias("done"), acc["whole"].alias("whole"))

    return F.aggregate(steps, start, pick, lambda acc: acc["k"])


def split_quotas(quotas: DataFrame, shards: int, seed: int = 3) -> DataFrame:
    """source_no, shard, first (of the source's permuted blocks), n: the blocks of each source and shard.

    ``quotas``: source_no, n. Level by level each node's quotas are split in two; a node's left half gets half of its blocks.
    ``shards`` is a power of two.
    """
    key = "array<struct<source_no:int,n:bigint>>"
    nodes = quotas.select(F.lit(0).alias("node"), F.struct(F.col("source_no").cast("int").alias("source_no"), F.col("n").cast("bigint").alias("n")).alias("q"))
    nodes = nodes.groupBy("node").agg(F.array_sort(F.collect_list("q")).alias("qs"))  # one entry per source
    level, width = 0, 1
    while width < shards:
        total = F.aggregate("qs", F.lit(0).cast("bigint"), lambda a, q: a + q["n"])
        nodes = nodes.withColumn("total", total)
        start = F.struct(F.col("total").alias("total"), F.floor(F.col("total") / 2).cast("bigint").alias("left"), F.array().cast(key).alias("out"))

        def step(acc: Column, q: Column, level: int = level) -> Column:
            got = _hypergeometric(q["n"], acc["total"], acc["left"], _uniform(F.lit(seed), F.lit(level), F.col("node"), q["source_no"])).cast("bigint")
            return F.struct((acc["total"] - q["n"]).alias("total"), (acc["left"] - got).alias("left"),
                            F.concat(acc["out"], F.array(F.struct(q["source_no"].alias("source_no"), got.alias("n")))).alias("out"))

        left = F.aggregate("qs", start, lambda a, q: step(a, q), lambda acc: acc["out"])
        nodes = materialize(nodes.withColumn("left", left))
        right = F.zip_with("qs", "left", lambda q, x: F.struct(q["source_no"].alias("source_no"), (q["n"] - x["n"]).alias("n")))
        nodes = nodes.select((F.col("node") * 2).alias("node"), F.col("left").alias("qs")).union(nodes.select((F.col("node") * 2 + 1).alias("node"), right.alias("qs")))
        level, width = level + 1, width * 2
    flat = nodes.select(F.col("node").alias("shard"), F.explode("qs").alias("q")).select("shard", "q.source_no", "q.n")
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def shard_count(words: float, blocks: int) -> int:
    """Output shards of a mix of that many words: a power of two, 8 at least, with ``SHARD_WORDS`` words each as long as blocks are four times as many."""
    shards = 8
    while shards * SHARD_WORDS < words and shards * 4 < blocks:
        shards *= 2
    return shards


def plan_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, blocks: int = 1 << 12, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, taken, and passes, an array of
    (shard, words) with an entry for each time that the document is taken; ``taken`` is their sum."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = materialize(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size.alias("size")))
    sources = materialize(source_targets(sized, share, most, weights))
    shards = shards or shard_count(sources.agg(F.sum("target")).first()[0] or 0.0, blocks)
    spread = sources.select("source_no", F.col("source").alias("s"), F.least(F.lit(blocks), "n_docs").alias("n_blocks"))
    placed = sized.join(spread, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("n_blocks"))).drop("s", "n_blocks")
    per = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words")).join(sources.select("source_no", "source_size", "target"), "source_no")
    order = Window.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", F.lit("order")), "block")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    per = per.withColumns({"full": full, "rest": F.round(F.col("target") - full * F.col("source_size")).cast("bigint"), "rank": F.row_number().over(order) - 1,
                           "n": F.count("*").over(Window.partitionBy("source_no")),
                           "before": F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # words that the last pass takes of each block
    per = materialize(per.withColumn("last", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before")))))
    drawn = per.groupBy("source_no").agg(F.sum(F.col("full") + (F.col("last") > 0).cast("bigint")).alias("n"))
    # blocks with words come first in the last pass, so that its draws are ranks without gaps
    split = split_quotas(drawn, shards).groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("ranges"))
    index = Window.partitionBy("source_no").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("nth", F.coalesce(F.sum((F.col("last") > 0).cast("bigint")).over(index), F.lit(0)))
    per = per.join(split, "source_no")
    shard_of = lambda place: F.element_at(F.filter("ranges", lambda r: r["first"] <= place), -1)["shard"]
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), "full"), lambda p: shard_of((p - 1) * F.col("n") + F.col("rank")))).otherwise(F.array().cast("array<int>"))
    per = materialize(per.select("source_no", "block", "source_size", "target", "words", "last", "full", whole.alias("shards"),
                                 F.when(F.col("last") > 0, shard_of(F.col("full") * F.col("n") + F.col("nth"))).alias("last_shard")))
    rows = placed.join(per, ["source_no", "block"])
    cut = (F.col("last") > 0) & (F.col("last") < F.col("words"))
    inner = Window.partitionBy("source_no").orderBy(F.xxhash64("doc_id", F.lit("cut")), "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole_rows = rows.filter(~cut).withColumn("part", F.when(F.col("last") > 0, F.col("size")).otherwise(0))
    # one block of each source at most is cut
    cut_rows = rows.filter(cut).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("last") - F.coalesce(F.sum("size").over(inner), F.lit(0)))))
    rows = whole_rows.unionByName(cut_rows)
    passes = F.concat(F.transform("shards", lambda s: F.struct(s.alias("shard"), F.col("size").alias("words"))),
                      F.when(F.col("part") > 0, F.array(F.struct(F.col("last_shard").alias("shard"), F.col("part").alias("words")))).otherwise(F.array().cast("array<struct<shard:int,words:bigint>>")))
    rows = rows.select("doc_id", "source", "text_hash", "size", "source_size", "target", passes.alias("passes"))
    taken = F.aggregate("passes", F.lit(0).cast("bigint"), lambda words, p: words + p["words"])
    return rows.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"), "passes")


def mix(docs: DataFrame, shards: int | None = None, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each time that a document is taken, shard by shard and shuffled
    inside. A document that was cut counts as taken if at least half of it was. Each row has its own decision; only rows equal in id,
    source and text share one. A partition holds one shard, or a piece of one with over ``shard_words`` words."""
    plan = materialize(plan_mix(docs, shards=shards, **options).filter(F.size("passes") > 0))
    taken = (plan.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__text"))
             .agg(F.max(F.struct("passes", "size")).alias("__p"))
             .select("__id", "__source", "__text", F.col("__p.size").alias("__size"), F.explode("__p.passes").alias("__p")).filter(F.col("__p.words") * 2 >= F.col("__size")))
    last, words = plan.agg(F.max(F.array_max("passes.shard")), F.sum("taken")).first()
    n = (last or 0) + 1
    pieces = int((words or 0) // (n * shard_words)) + 1
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__text"))
    rows = docs.join(taken.select("__id", "__source", "__text", F.col("__p.shard").alias("__shard")), same)
    order = F.xxhash64("doc_id", "source", "__text", "__shard", F.lit("mix"))
    part = (F.col("__shard") * pieces + F.pmod(order, F.lit(pieces))).cast("int")
    return rows.repartitionById(n * pieces, part).sortWithinPartitions(order).select(*docs.columns)
