"""The core pipeline: points -> cells and cell-windows -> density curve -> critical density, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.risk import pearson_p
from airgrid.operators import breakpoints as bp
from airgrid.operators.cells import exceedance, in_set, traffic
from airgrid.operators.curves import curve_from_occupancy
from airgrid.operators.ranking import (cumulative_by_value, gini, rank_with_shares, top_fraction, top_k_size)
from airgrid.spec import BACKBONE_SHARE, GridSpec


def backbone_cells(occ: DataFrame, share: float = BACKBONE_SHARE) -> DataFrame:
    """The busiest ``share`` of active cells."""
    return top_fraction(traffic(occ), "total_points", share).select("row", "col")


def critical_density(occ: DataFrame, **options) -> DataFrame:
    """One-row breakpoint estimate from unit density bins."""
    return bp.piecewise(curve_from_occupancy(occ), **options)


def rho_star(occ: DataFrame) -> Column:
    """The critical density as a scalar subquery: evaluated once, inlined as a literal."""
    return critical_density(occ).select("rho_star").scalar()


def congestion_metrics(occ: DataFrame, windows: DataFrame, rho: Column) -> DataFrame:
    """Correlation of density and speed with its p-value, sample counts, share at or above rho."""
    valid = windows.where((F.col("n_points") > 0) & F.col("mean_speed").isNotNull())
    out = valid.agg(
        F.corr(F.col("n_points").cast("double"), "mean_speed").alias("correlation"), F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("n_points") >= rho).alias("n_congested"),
        (F.avg((F.col("n_points") >= rho).cast("int")) * 100).alias("congestion_share_percent"))
    return out.withColumn("p_value", pearson_p("correlation", F.col("n_samples").cast("double")))


def ranked_cells(cells: DataFrame) -> DataFrame:
    """Traffic rank (ties by cell), share, cumulative share and backbone flag."""
    ranked = rank_with_shares(cells, "total_points")
    size = cells.agg(top_k_size(F.count(F.lit(1)), BACKBONE_SHARE).alias("k")).scalar()
    return ranked.withColumn("is_backbone_cell", F.col("rank") <= size)


def hotspot_cells(occ: DataFrame, rho: Column, endpoint_cells: DataFrame, endpoint_buffer: DataFrame) -> DataFrame:
    """Cells with congested windows, ranked, with traffic rank and membership flags."""
    cells = exceedance(occ, rho).where(F.col("exceedance_count") > 0)
    hot = rank_with_shares(cells, "exceedance_count").withColumnRenamed("rank", "exceedance_rank")
    ranks = ranked_cells(traffic(occ)).select("row", "col", F.col("rank").alias("traffic_rank"), "is_backbone_cell")
    hot = hot.join(ranks, ["row", "col"], "left")
    hot = in_set(hot, endpoint_cells, "is_endpoint_cell")
    hot = in_set(hot, endpoint_buffer, "is_endpoint_buffer1_cell")
    return hot.withColumn("rho_star_reference", rho)


def top_shares(cells: DataFrame, measure: str, fractions: dict[str, float]) -> DataFrame:
    """Share of ``measure`` held by its top fractions, read from the value histogram."""
    hist = cumulative_by_value(cells, measure)
    picks = []
    for name, fraction in fractions.items():
        k = top_k_size(F.col("rows_total"), fraction)
        take = F.greatest(F.lit(0), F.least(F.col("ties"), k - F.col("rows_before")))
        picks.append(F.try_divide(F.sum(take * F.col(measure)), F.max("sum_total")).alias(name))
    return hist.agg(*picks)


def lorenz_curve(cells: DataFrame, measure: str, ties=("row", "col"), descending: bool = False) -> DataFrame:
    """Cumulative share of cells against cumulative share of the measure."""
    ranked = rank_with_shares(cells, measure, ties, descending=descending)
    total = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.select(*ties, "rank", (F.col("rank") / total * 100).alias("cell_percent"),
                         (F.col("cumulative_share") * 100).alias("measure_percent"))


def concentration(cells: DataFrame) -> DataFrame:
    shares = top_shares(cells, "total_points", {"top_1pct_share": 0.01, "top_10pct_share": 0.10})
    stats = cells.agg(F.count(F.lit(1)).alias("active_cells"), F.sum("total_points").alias("total_points"))
    value = gini(cells, "total_points").select("gini").scalar()
    return stats.select("*", value.alias("gini"),
                        *[shares.select(c).scalar().alias(c) for c in ("top_1pct_share", "top_10pct_share")])


def grid_summary(cells: DataFrame, windows: DataFrame, grid: GridSpec) -> DataFrame:
    """One-row report over cells and cell-windows."""
    share = top_shares(cells, "total_points", {"s": 0.10}).select("s").scalar()
    by_cell = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("total_points").alias("points"),
                        F.avg("total_points").alias("mean_points_per_cell"), F.max("total_points").alias("max_points_per_cell"))
    by_window = windows.agg(F.count(F.lit(1)).alias("cell_windows"), F.avg("n_points").alias("mean_density"),
                            F.max("n_points").alias("max_density"), F.avg("mean_speed").alias("mean_speed"),
                            F.count_distinct("window_start").alias("time_windows"))
    names = ("cell_windows", "mean_density", "max_density", "mean_speed", "time_windows")
    return by_cell.select("*", (share * 100).alias("top10_share_percent"), F.lit(grid.total_cells).alias("grid_cells"),
                          *[by_window.select(n).scalar().alias(n) for n in names])
