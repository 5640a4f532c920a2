"""Table and metric writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from airgrid.sources.tables import allow_charset


def write_table(df: DataFrame, path: str, *, partition_by: str | None = None, fmt: str = "parquet",
                encoding: str = "UTF-8") -> None:
    """Overwrite a table.

    With a partition column the rows are rebalanced on it first: small
    partitions share a task, a dominant one is split over several, and no task
    opens a file per partition value.
    """
    writer = df.hint("rebalance", partition_by).write if partition_by else df.write
    writer = writer.mode("overwrite").format(fmt)
    if fmt == "csv":
        allow_charset(df.sparkSession, encoding)
        writer = writer.option("header", True).option("encoding", encoding)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines; result tables are a few rows."""
    df.write.mode("overwrite").json(path)
