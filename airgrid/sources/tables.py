"""Readers with fixed schemas. Nothing is inferred, so every scan can prune columns and skip files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_COLUMNS = ("order_id", "sn", "vendor", "time", "speed", "altitude", "yaw", "flight_time", "longitude", "latitude")
SITE_COLUMNS = ("site_name", "platform", "city", "note", "open_time", "lon", "lat")
ROAD_SCHEMA = "route_key string, attempt int, status string, distance_m double, duration_s double"
TERRAIN_SCHEMA = "lat double, lon double, terrain_m double, source string"
BUILDING_SCHEMA = "building_height_m double, lon double, lat double"
FOLLOWUP_SCHEMA = ("path string, lat double, lon double, logtime bigint, vel_x double, vel_y double, vel_z double, "
                   "altitude_msl double, altitude_agl double, yaw double")


def _text_schema(columns: Sequence[str]) -> str:
    return ", ".join(f"{c} string" for c in columns)


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Other charsets than these are refused by the CSV source unless the session allows them."""
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _csv(spark: SparkSession, path: str, schema: str, encoding: str) -> DataFrame:
    allow_charset(spark, encoding)
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def read_raw_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Raw telemetry as text; a UTF-8 byte-order mark is skipped by the reader."""
    return _csv(spark, path, _text_schema(RAW_COLUMNS), encoding)


def read_sites(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return _csv(spark, path, _text_schema(SITE_COLUMNS), encoding)


def read_road_lookup(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ROAD_SCHEMA, "UTF-8")


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, TERRAIN_SCHEMA, "UTF-8")


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, BUILDING_SCHEMA, "UTF-8").na.drop()


def read_followup_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOLLOWUP_SCHEMA).parquet(path)


def read_points(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Landed points: only the named columns, with partition and row-group pruning from ``where``."""
    points = spark.read.parquet(path)
    return (points.where(where) if where is not None else points).select(*columns)


def source_path() -> Column:
    return F.col("_metadata.file_path")
