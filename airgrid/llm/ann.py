"""Approximate nearest neighbours by an inverted multi-index, largest inner product first.

The two halves of a vector are quantised separately: k-means in numpy on a bounded sample (``sample_rows`` vectors in the order of a
hash of vec_id) gives ``centroids`` for each half, and a pair of centroids is a cell. All vectors are indexed. A query walks the pairs in the order of
the sum of its halves' inner products with the two centroids, with a heap over the two sorted lists, until the cells that it met
hold ``share`` of all vectors (and the ``k`` + 1 that an answer needs); the walk only needs the number of vectors in each cell (``centroids`` squared
numbers). The vectors of these cells are reranked by exact double-precision products. ``share`` is what recall costs: on vectors
without clusters, such as the test tables, 0.7 is needed for 0.9 and more at every size.

Vectors are dealt by blocks of cells; a block with many vectors is dealt over several tasks, and queries follow it with their cells; a task returns the best ``k`` of a query only. Equal vectors are folded to
the ``k`` + 1 smallest ids first, which loses nothing as ties go to smaller ids.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null
ids; repeated rows of an id count once (the smallest vector); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airgrid.session import materialize


def sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = assign(x, centres)
        n = np.bincount(nearest, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # vectors in each cell (first, second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return assign(x[:, :half], self.first) * len(self.second) + assign(x[:, half:], self.second)

    def walk(self, query: np.ndarray, wanted: int) -> list[int]:
        """Cells in the order of the summed products, until they hold ``wanted`` vectors."""
        half = self.first.shape[1]
        a, b = self.first @ query[:half], self.second @ query[half:]
        rows, columns = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, seen, out, held = [(-(a[rows[0]] + b[columns[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            n = self.counts[rows[i], columns[j]]
            if n:
                out.append(int(rows[i]) * len(self.second) + int(columns[j]))
                held += n
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(rows) and y < len(columns) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[rows[x]] + b[columns[y]]), x, y))
        return out


def fit(vectors: DataFrame, dims: int, centroids: int, sample_rows: int) -> MultiIndex:
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(sample_rows).select("v").collect()
    x = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dims)
    half = dims // 2
    k = max(1, min(centroids, len(x) // 8))
    return MultiIndex(kmeans(x[:, :half], k), kmeans(x[:, half:], k), np.zeros((k, k), np.int64))


def search(vectors: DataFrame, queries: Column, k: int = 20, centroids: int = 32, share: float = 0.7, sample_rows: int = 20000,
           blocks: int = 16, most_in_block: int = 20000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row where ``queries`` holds.

    ``vectors`` has vec_id and embedding.
    """
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    good = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & sound(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v")))
    good = materialize(good)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dims = sizes["d"]
    good = good.filter(F.size("v") == dims)
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = good.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    index = fit(good, dims, centroids, sample_rows)
    n_second, shared = len(index.second), spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(np.stack(v.to_list())).astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

    placed = materialize(kept.withColumn("cell", cell_of("v")))
    per_cell = placed.groupBy("cell").agg(F.count("*").alias("n")).collect()  # at most centroids squared rows
    for r in per_cell:
        index.counts[divmod(r["cell"], n_second)] = r["n"]
    total = int(index.counts.sum())
    # a block holds neighbouring cells; one with many vectors is dealt over several parts
    flat = index.counts.ravel()
    block_of = np.minimum((np.cumsum(flat) - flat) * blocks // max(total, 1), blocks - 1).astype(np.int64)
    parts = np.maximum(1, -(-np.bincount(block_of, weights=flat, minlength=blocks).astype(np.int64) // most_in_block))
    plan = spark.sparkContext.broadcast((index, block_of, parts, max(k + 1, int(np.ceil(total * share)))))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, of, n_parts, wanted = plan.value
        for batch in batches:
            rows = []
            for q, v in zip(batch["vec_id"], batch["v"], strict=True):
                cells = np.array(idx.walk(np.asarray(v), wanted))
                for block in np.unique(of[cells]):
                    rows += [(int(block), part, 1, q, v, cells[of[cells] == block].tolist()) for part in range(n_parts[block])]
            yield pd.DataFrame(rows, columns=["block", "part", "side", "vec_id", "v", "cells"])

    schema = "block bigint, part bigint, side int, vec_id bigint, v array<double>, cells array<bigint>"
    probes = good.filter(queries).mapInPandas(walked, schema)
    lookup = F.array(*[F.lit(int(x)) for x in block_of])
    spread = F.array(*[F.lit(int(x)) for x in parts])
    block = F.element_at(lookup, F.col("cell") + 1).cast("bigint")
    entries = (placed.withColumn("block", block).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.element_at(spread, (F.col("block") + 1).cast("int"))).cast("bigint"))
               .select("block", "part", F.lit(0).alias("side"), "vec_id", "v", F.array(F.col("cell").cast("bigint")).alias("cells")))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        e, q = rows[rows["side"] == 0], rows[rows["side"] == 1]
        found = []
        if len(e) and len(q):
            cells = np.array([c[0] for c in e["cells"]])
            by = np.argsort(cells, kind="stable")
            cells, ids, x = cells[by], e["vec_id"].to_numpy()[by], np.stack(e["v"].to_list())[by]
            met = np.zeros(len(block_of), bool)
            for at in range(0, len(q), 64):
                some = q.iloc[at:at + 64]
                scores = np.stack(some["v"].to_list()) @ x.T
                for qid, walk, row in zip(some["vec_id"], some["cells"], scores, strict=True):
                    met[:] = False
                    met[walk] = True
                    here = np.flatnonzero(met[cells] & (ids != qid))
                    if len(here):
                        top = _top(row[here], ids[here], k)
                        found += zip([qid] * len(top), ids[here][top], row[here][top], strict=True)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    parts_found = entries.unionByName(probes).groupBy("block", "part").applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts_found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best by score, then smaller id; all ties at the edge are looked at."""
    edge = np.partition(score, -k)[-k] if len(score) > k else -np.inf
    near = np.flatnonzero(score >= edge)
    return near[np.lexsort((ids[near], -score[near]))[:k]]
