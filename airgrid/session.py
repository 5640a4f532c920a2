"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for
    a local master, where driver and tasks share a disk."""
    context = spark.sparkContext
    configured = (spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
                  or context.getCheckpointDir())
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-airgrid-"))
    return context.getCheckpointDir()


def table_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark).rstrip('/')}/airgrid/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several branches or iterations read, and scan it back.

    This cuts the lineage like a checkpoint and survives lost executors. As a
    parquet scan the result also has a known size, so a join broadcasts it only
    when it really is below the threshold, and unused columns are not read.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
