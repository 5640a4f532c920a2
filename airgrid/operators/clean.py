"""Cleaning of raw telemetry text into typed points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.time import calendar_features, parse_compact, strip_fraction, window_start
from airgrid.spec import (BBOX_MAX_LAT, BBOX_MAX_LON, BBOX_MIN_LAT, BBOX_MIN_LON, INVALID_YAW, MAX_ALTITUDE, MAX_SPEED)

NUMERIC = ("speed", "altitude", "yaw", "flight_time", "longitude", "latitude")


def drop_empty(raw: DataFrame) -> DataFrame:
    return raw.na.drop("all")


def parse_time(raw: DataFrame, *, strip: bool = True) -> DataFrame:
    """Add ``datetime``; rows with an unreadable time are dropped."""
    text = F.col("time")
    parsed = raw.withColumn("datetime", parse_compact(strip_fraction(text) if strip else text))
    return parsed.where(F.col("datetime").isNotNull())


def to_numbers(df: DataFrame) -> DataFrame:
    """Numeric columns from text; what is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in NUMERIC if c in df.columns})


def valid_ranges(*, flight_time: bool = True) -> Column:
    """Speed, altitude, coordinates (and flight time) inside their inclusive limits; null fails."""
    test = (F.col("speed").between(0.0, MAX_SPEED) & F.col("altitude").between(0.0, MAX_ALTITUDE)
            & F.col("longitude").between(BBOX_MIN_LON, BBOX_MAX_LON)
            & F.col("latitude").between(BBOX_MIN_LAT, BBOX_MAX_LAT))
    return test & (F.col("flight_time") >= 0.0) if flight_time else test


def keep_long_orders(points: DataFrame, minimum: int = 3) -> DataFrame:
    """Points of orders with at least ``minimum`` points, as a semi-join on a pre-aggregated count."""
    orders = points.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return points.join(orders.select("order_id"), "order_id", "left_semi")


def clean_points(raw: DataFrame, *, strip: bool = True, flight_time: bool = True) -> DataFrame:
    """Typed, in-range points with calendar columns; yaw 999 becomes null."""
    typed = to_numbers(parse_time(drop_empty(raw), strip=strip)).where(valid_ranges(flight_time=flight_time))
    yaw = F.nullif(F.col("yaw"), F.lit(INVALID_YAW))
    return typed.withColumns(calendar_features(F.col("datetime")) | {
        "yaw_clean": yaw, "yaw_valid": F.coalesce(F.col("yaw") != INVALID_YAW, F.lit(True))})


def window_key(raw: DataFrame, seconds: int) -> DataFrame:
    """Floored window of each readable time, as compact text."""
    floored = window_start(F.col("datetime"), seconds)
    return parse_time(raw).withColumn("window_key", F.date_format(floored, "yyyyMMddHHmmss"))


def data_summary(points: DataFrame, trips: DataFrame) -> DataFrame:
    """One-row report: rows, time span in days, trip count and trip means."""
    rows = points.agg(F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first_time"),
                      F.max("datetime").alias("last_time"))
    rows = rows.withColumn("days", F.floor(
        (F.unix_timestamp("last_time") - F.unix_timestamp("first_time")) / 86400) + 1)
    means = trips.agg(F.count(F.lit(1)).alias("trips"), F.avg("num_points").alias("mean_points"),
                      F.avg("duration_seconds").alias("mean_duration_s"), F.avg("avg_speed").alias("mean_speed"),
                      F.avg("avg_altitude").alias("mean_altitude"))
    return rows.select("*", *[means.select(c).scalar().alias(c) for c in means.columns])


def hour_distribution(points: DataFrame) -> DataFrame:
    """Rows and percentage for each of the 24 hours, empty hours included."""
    hours = points.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = points.groupBy(F.hour("datetime").alias("hour")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("t")).scalar()
    return hours.join(counts, "hour", "left").na.fill(0, ["rows"]).withColumn("percent", F.col("rows") / total * 100)
