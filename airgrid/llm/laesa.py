"""Clustering around centroids with a pivot table (linear approximating and eliminating search).

Components become integers (``floor(scale x)``), so that every distance and every mean is exact and does not depend on how the rows
are dealt out. A few starting centroids, far from each other, are the pivots: the distances of all vectors to them are stored
once. In each round ``|d(x, p) - d(c, p)|``, at most over the pivots, bounds the distance of vector x and centroid c from below; the centroid
with the least bound is measured first, and only centroids whose bound does not exceed that distance are measured exactly.
A round is one pass over the table whose partial sums are added up by Spark; the driver holds centroids (k x dims) and nothing else.

Defined results: vectors that are null, have another number of components, or hold null, non-finite or unmanageably large (2^19 and more, whose
squared distance a long can't hold) components take no part; of equal distances the smaller centroid number wins; a null vec_id is
hashed as an empty id; repeated rows are assigned each; fewer than k vectors give fewer centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.session import materialize

LARGEST = 1 << 19
_ROWS = 512


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and xs (array of int) of the vectors that take part."""
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)) & ~F.isnan(x))
    vectors = vectors.filter((F.size("embedding") == dims) & usable)
    return vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("xs"))


def first_centroids(table: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id (then of smallest components), in that order."""
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = table.select(key.alias("key"), "xs").orderBy("key", "xs").limit(k).collect()
    return np.array([r.xs for r in rows], np.int64)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, each as far as possible from those before it."""
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances (points, others), from exact squares."""
    return np.sqrt(np.stack([((points - o) ** 2).sum(1) for o in others], axis=1).astype(np.float64))


def nearest(points: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, from_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroid number and squared distance of each point, and how many distances were computed.

    The stored distances are rounded; the slack keeps a centroid that might be as near.
    """
    bound = np.zeros((len(points), len(centroids)))
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - from_pivots[None, :, p]), out=bound)
    guess = bound.argmin(1)
    best = ((points - centroids[guess]) ** 2).sum(1)
    reach = np.sqrt(best.astype(np.float64))
    survive = bound <= (reach * (1 + 1e-9) + 1e-3)[:, None]
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[np.arange(len(points)), guess] = best
    survive[np.arange(len(points)), guess] = False
    for c in np.flatnonzero(survive.any(0)):
        rows = np.flatnonzero(survive[:, c])
        exact[rows, c] = ((points[rows] - centroids[c]) ** 2).sum(1)
    cluster = exact.argmin(1)
    return cluster, exact[np.arange(len(points)), cluster], int(survive.sum()) + len(points)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def pivot_table(table: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The table with the distances of each vector to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_matrix(batch.column("xs"), np.int64), pivots) if batch.num_rows else np.zeros((0, len(pivots)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * len(pivots)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("xs"), lists], names=["vec_id", "xs", "to_pivots"])

    return table.mapInArrow(run, "vec_id bigint, xs array<int>, to_pivots array<double>")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, from_pivots: np.ndarray):
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            points = _matrix(part.column("xs"), np.int64)
            cluster, far, _ = nearest(points, _matrix(part.column("to_pivots"), np.float64), centroids, from_pivots)
            yield part.column("vec_id"), points, cluster, far


def sums(table: DataFrame, centroids: np.ndarray, from_pivots: np.ndarray) -> DataFrame:
    """cluster, n, s0, s1, ...: number and componentwise sum of the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, points, cluster, _ in _assigned(batches, centroids, from_pivots):
            np.add.at(total, cluster, points)
            count += np.bincount(cluster, minlength=k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * dims), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), lists], names=["cluster", "n", "sums"])

    partial = table.select("xs", "to_pivots", F.lit(None).cast("bigint").alias("vec_id")).mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)))


def moved(centroids: np.ndarray, rows: list) -> np.ndarray:
    """Each centroid that has vectors becomes the floor of their mean."""
    out = centroids.copy()
    for row in rows:
        if row.n:
            out[row.cluster] = [int(s) // row.n for s in row[2:]]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, pivots: int = 6, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    table = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(table, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    fixed = far_apart(centroids, pivots)
    table = materialize(pivot_table(table, fixed))
    for _ in range(rounds):
        centroids = moved(centroids, sums(table, centroids, distances(centroids, fixed)).collect())
    from_pivots = distances(centroids, fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, far in _assigned(batches, centroids, from_pivots):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    found = materialize(table.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"))
    # at most k rows
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = sum(t.cluster_inertia for t in totals)
    facts = spark.createDataFrame([(t.cluster, t.cluster_inertia, inertia, hashes[t.cluster]) for t in totals],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
