"""Joins that don't move the rows of a frequent key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.session import materialize

SHARE = 4


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per key at most), null where there is none.

    Keys with more than 1/(4 x shuffle partitions) of the rows of ``left`` are looked up in a broadcast table: as there
    are fewer than 4 x shuffle partitions of them, its size is bounded whatever the size of the inputs. The other rows are
    joined by shuffle, where no key is frequent.
    """
    on, partitions = list(on), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_c")))
    limit = max(1, (counts.agg(F.sum("_c")).first()[0] or 0) // (SHARE * partitions))
    frequent = counts.where(F.col("_c") > limit).select(*on)
    carried = [c for c in right.columns if c not in on]
    if frequent.isEmpty():
        return left.join(right, on, "left")
    found = frequent.join(right, on, "left").select(*on, F.struct(*carried).alias("_found"))
    marked = left.join(F.broadcast(found), on, "left")
    near = marked.where(F.col("_found").isNotNull()).select(*left.columns, "_found.*")
    far = marked.where(F.col("_found").isNull()).select(*left.columns).join(right, on, "left").select(*left.columns, *carried)
    return near.unionByName(far)


def resolved(answers: DataFrame, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """One row per key of a lookup with repeated answers: the latest version, among equals the largest values; rows without a key go.

    One aggregate that combines before it shuffles, whatever the number of answers for a key. Keys without an answer are
    left to the join (null columns).
    """
    order = F.struct(version, *values)
    best = answers.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_r"))
    return best.select(key, *[F.col(f"_r.{v}").alias(v) for v in values])
