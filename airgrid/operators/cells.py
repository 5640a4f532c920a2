"""Cells, cell-windows and the occupancy histogram derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.time import window_start
from airgrid.spec import SLOW_SPEED, WindowSpec


def cell_stats(points: DataFrame) -> DataFrame:
    """Per cell: volume, speed and altitude moments (ddof 1), first/last seen, active hours and days."""
    return points.groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("total_points"),
        F.avg("speed").alias("avg_speed"), F.stddev_samp("speed").alias("std_speed"),
        F.avg("altitude").alias("avg_altitude"), F.stddev_samp("altitude").alias("std_altitude"),
        F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, hour(datetime))"))).alias("active_hours"),
        F.count_distinct(F.to_date("datetime")).alias("active_days"))


def with_window(points: DataFrame, window: WindowSpec) -> DataFrame:
    return points.withColumn("window_start", window_start(F.col("datetime"), window.seconds))


def cell_windows(points: DataFrame, window: WindowSpec) -> DataFrame:
    """The central fact table: one row per (cell, time window) with its samples."""
    grouped = with_window(points, window).groupBy("row", "col", "window_start").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg("speed").alias("mean_speed"), F.stddev_samp("speed").alias("std_speed"),
        F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"),
        F.avg("altitude").alias("mean_altitude"))
    weekday = F.weekday("window_start")
    return grouped.withColumns({"hour": F.hour("window_start"), "day_of_week": weekday, "is_weekend": weekday >= 5})


def flight_windows(points: DataFrame, window: WindowSpec) -> DataFrame:
    """Distinct flights and mean point speed per cell-window."""
    return with_window(points, window).groupBy("row", "col", "window_start").agg(
        F.count_distinct("order_id").alias("n_unique"), F.avg("speed").alias("mean_speed"),
        F.count(F.lit(1)).alias("n_points"))


def contributions(points: DataFrame, window: WindowSpec, group: str) -> DataFrame:
    """Distributive parts of each cell-window by group: point count and speed sum."""
    return with_window(points, window).groupBy(group, "row", "col", "window_start").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("speed").alias("speed_sum"))


def from_contributions(parts: DataFrame) -> DataFrame:
    return parts.groupBy("row", "col", "window_start").agg(
        F.sum("n_points").alias("n_points"), F.sum("speed_sum").alias("speed_sum")).withColumn(
        "mean_speed", F.col("speed_sum") / F.col("n_points"))


def occupancy(cell_windows_df: DataFrame, by: Sequence[str] = (), density: str = "n_points") -> DataFrame:
    """Histogram (group, cell, density) -> number of windows and their speed sums.

    Backbone, density curve and 2x2 table all follow from this table by plain
    sums, so subset studies scan the cell-windows once.
    """
    moving = F.col("mean_speed") > 0
    return cell_windows_df.groupBy(*by, "row", "col", F.col(density).alias("n_points")).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("mean_speed").alias("speed_sum"),
        F.count("mean_speed").alias("speed_windows"),
        F.coalesce(F.sum(F.when(moving, F.lit(1))), F.lit(0)).alias("moving_windows"),
        F.coalesce(F.sum(F.when(moving, F.col("mean_speed"))), F.lit(0.0)).alias("moving_sum"))


OCCUPANCY_SUMS = ("windows", "speed_sum", "speed_windows", "moving_windows", "moving_sum")


def merge_occupancy(occ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return occ.groupBy(*by, "row", "col", "n_points").agg(*[F.sum(c).alias(c) for c in OCCUPANCY_SUMS])


def traffic(occ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points and windows per cell."""
    return occ.groupBy(*by, "row", "col").agg(
        F.sum(F.col("n_points") * F.col("windows")).alias("total_points"), F.sum("windows").alias("total_samples"))


def exceedance(occ: DataFrame, rho: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per cell: windows at or above the critical density, and all windows."""
    return occ.groupBy(*by, "row", "col").agg(
        F.coalesce(F.sum(F.when(F.col("n_points") >= rho, F.col("windows"))), F.lit(0)).alias("exceedance_count"),
        F.sum("windows").alias("total_samples"))


def median_density(occ: DataFrame) -> Column:
    """Median n_points over all windows; n_points has few distinct values, so the map stays small."""
    return occ.agg(F.percentile("n_points", F.lit(0.5), F.col("windows")).alias("m")).scalar()


def interface_like(median: Column) -> Column:
    return (F.col("mean_speed") < F.lit(SLOW_SPEED)) & (F.col("n_points") > median)


def in_set(df: DataFrame, members: DataFrame, flag: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Boolean membership column. The join side is chosen by size at run time."""
    tagged = members.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(tagged, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
