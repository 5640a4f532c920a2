"""Local session for tests, the bench and the oracle check."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("airgrid")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", memory)
             .config("spark.local.dir", scratch)
             .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
             .config("spark.driver.host", "127.0.0.1")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
