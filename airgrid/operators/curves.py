"""Binned speed-density relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.operators.percentiles import exact_percentiles
from airgrid.spec import MIN_BIN_SAMPLES


def curve_from_occupancy(occ: DataFrame, by: Sequence[str] = (), *, bin_width: int = 1,
                         min_samples: int = MIN_BIN_SAMPLES, center: str = "mid") -> DataFrame:
    """Density bins with at least ``min_samples`` moving windows and their mean speed."""
    low = F.floor(F.col("n_points") / F.lit(bin_width)) * F.lit(bin_width)
    grouped = occ.where(F.col("n_points") > 0).groupBy(*by, low.alias("density_min")).agg(
        F.sum("moving_windows").alias("sample_count"),
        F.try_divide(F.sum(F.col("n_points") * F.col("moving_windows")), F.sum("moving_windows")).alias("density_mean"),
        F.try_divide(F.sum("moving_sum"), F.sum("moving_windows")).alias("speed_mean"))
    kept = grouped.where(F.col("sample_count") >= min_samples)
    mid = F.col("density_min") + F.lit(bin_width / 2.0)
    return kept.withColumn("density_center", mid if center == "mid" else F.col("density_mean"))


def diagram(cell_windows_df: DataFrame, *, min_samples: int = MIN_BIN_SAMPLES) -> DataFrame:
    """Unit-width bins with count, mean density, mean and sample std of the window mean speeds."""
    valid = cell_windows_df.where((F.col("n_points") > 0) & (F.col("mean_speed") > 0))
    grouped = valid.groupBy(F.col("n_points").cast("double").alias("density_min")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("n_points").alias("density_mean"),
        F.avg("mean_speed").alias("speed_mean"), F.stddev_samp("mean_speed").alias("speed_std"))
    return grouped.where(F.col("sample_count") >= min_samples).withColumns({
        "density_max": F.col("density_min") + 1.0, "density_center": F.col("density_min") + 0.5})


def with_regime(curve: DataFrame, rho: Column) -> DataFrame:
    label = F.when(F.col("density_center") >= rho, "at_or_above_rho_star").otherwise("below_rho_star")
    return curve.withColumns({"regime": label, "rho_star": rho})


def binned_relation(df: DataFrame, x: str, y: str, *, bin_width: float | str, min_samples: int = 30,
                    by: Sequence[str] = (), origin: float | None = 0.0) -> DataFrame:
    """Mean, median and quartiles of y in left-closed x bins; ``origin=None`` starts at the group minimum of x."""
    by = list(by)
    width = F.col(bin_width) if isinstance(bin_width, str) else F.lit(float(bin_width))
    data = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), width.alias("_width"))
    if origin is None:
        lows = data.groupBy(*by).agg(F.min("x").alias("_x0"))
        data = data.join(lows, by) if by else data.withColumn("_x0", lows.scalar())
        start = F.col("_x0")
    else:
        start = F.lit(float(origin))
    data = data.withColumn("bin", F.floor((F.col("x") - start) / F.col("_width")).cast("bigint"))
    stats = data.groupBy(*by, "bin").agg(F.count("y").alias("sample_count"), F.avg("x").alias("x_mean"),
                                         F.avg("y").alias("y_mean")).where(F.col("sample_count") >= min_samples)
    quartiles = exact_percentiles(data, "y", {"y_median": 0.5, "y_q25": 0.25, "y_q75": 0.75}, width=0.05, by=by + ["bin"])
    return stats.join(quartiles, by + ["bin"])


def equal_width_curve(cell_windows_df: DataFrame, bins: int = 100) -> DataFrame:
    """Mean density and speed in ``bins`` right-closed equal-width bins over the density range."""
    # n_points has few distinct values; bins are assigned on the histogram
    hist = cell_windows_df.groupBy("n_points").agg(
        F.count(F.lit(1)).alias("w"), F.sum("mean_speed").alias("s"), F.count("mean_speed").alias("k"))
    low = F.min("n_points").over(Window.partitionBy())
    width = (F.max("n_points").over(Window.partitionBy()) - low) / F.lit(float(bins))
    number = F.greatest(F.lit(0), F.ceil((F.col("n_points") - low) / width) - 1)
    binned = hist.withColumn("bin", number.cast("int")).groupBy("bin").agg(
        (F.sum(F.col("n_points") * F.col("w")) / F.sum("w")).alias("density"),
        F.try_divide(F.sum("s"), F.sum("k")).alias("speed"))
    position = F.row_number().over(Window.orderBy("bin")) - 1
    return binned.where(F.col("speed").isNotNull()).withColumn("position", position)
