"""Reproducible random numbers from md5, equal in every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def draw_index(n: Column, *parts) -> Column:
    """Uniform integer in [0, n) from the first 60 bits of the digest."""
    return F.pmod(F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint"), n)


def draw_grid(spark: SparkSession, n: int, size: int) -> DataFrame:
    """(iter, j) for every draw of every iteration, generated evenly over the cluster without a shuffle."""
    return spark.range(n * size).select(F.expr(f"id div {size}").alias("iter"), F.expr(f"id % {size}").alias("j"))


def iterated(df: DataFrame, n: int) -> DataFrame:
    """Every row once per iteration (column ``iter``).

    Small inputs arrive in few partitions, so rows are first spread over all
    cores; otherwise one task would produce, and hash, all the copies.
    """
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return spread.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
