"""Summaries of many leave-out folds without spreading the histogram over the folds.

A fold is the whole occupancy histogram plus signed rows (deltas) of the cells it touches. Everything that a summary
needs follows from sums over the whole, worked out once, and from the touched cells of the fold:

* density curve and totals: one row per density value (few) and fold, plus the deltas summed by density;
* backbone: the cells ranked once by traffic. Deltas of a leave-out only lower a cell's traffic, so untouched cells keep their order and
  those within the fold's number of backbone cells stay in. The places of touched cells are filled from the touched
  cells and from as many of the next ranks; no other cell can move across the cut;
* 2x2 table: prefix sums over (rank, density) of the whole at the few distinct backbone sizes, corrected by cells that crossed the cut and by
  the deltas inside the backbone.

Rows grow with the touched cells and with folds x density values; fold ids are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.operators.breakpoints import piecewise
from airgrid.operators.cells import OCCUPANCY_SUMS, merge_occupancy, traffic
from airgrid.operators.curves import curve_from_occupancy
from airgrid.operators.ranking import global_rank, top_k_size
from airgrid.plans.summary import completed
from airgrid.session import materialize
from airgrid.spec import BACKBONE_SHARE

_TRAFFIC = [("total_points", False), ("row", True), ("col", True)]
_CELL = ["row", "col"]


def _sum_if(test: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0))


def density_rows(total: DataFrame, deltas: DataFrame, folds: DataFrame, fold: str) -> DataFrame:
    """Occupancy sums by (fold, n_points). The whole is an array with one entry per density value, which few are."""
    sums = [F.sum(c).alias(c) for c in OCCUPANCY_SUMS]
    whole = total.groupBy("n_points").agg(*sums).select(F.collect_list(F.struct("n_points", *OCCUPANCY_SUMS))).scalar()
    spread = folds.select(fold, F.explode(whole).alias("d")).select(fold, "d.*")
    changed = deltas.groupBy(fold, "n_points").agg(*sums)
    return spread.unionByName(changed).groupBy(fold, "n_points").agg(*sums).where(F.col("windows") > 0)


def backbone_changes(cells: DataFrame, touched: DataFrame, sizes: DataFrame, fold: str) -> DataFrame:
    """(fold, row, col, was_in, is_in): touched cells, and untouched ones that moved into a fold's backbone.

    ``cells`` have total_points and rank, ``touched`` also the points left, ``sizes`` the backbone size k of each fold.
    """
    placed = touched.join(sizes.select(fold, "k", "touched_cells"), fold).withColumn("was_in", F.col("rank") <= F.col("k"))
    free = placed.groupBy(fold).agg(F.count_if("was_in").alias("free"))
    sizes = sizes.join(free, fold)
    last = cells.agg(F.max("rank")).scalar()
    reach = F.least(last, F.col("k") + F.col("touched_cells"))
    following = sizes.where((F.col("free") > 0) & (F.col("k") < reach)).select(fold, F.explode(F.sequence(F.col("k") + 1, reach)).alias("rank"))
    following = following.join(cells.select("rank", "total_points", *_CELL), "rank").join(touched.select(fold, *_CELL), [fold, *_CELL], "left_anti")
    rivals = (placed.where("samples_left > 0").select(fold, *_CELL, F.col("points_left").alias("total_points"), "was_in")
              .unionByName(following.select(fold, *_CELL, "total_points", F.lit(False).alias("was_in"))))
    ranked = global_rank(materialize(rivals), _TRAFFIC, levels=2, by=[fold], rank="place").join(sizes.select(fold, "free"), fold)
    alive = ranked.select(fold, *_CELL, "was_in", (F.col("place") <= F.col("free")).alias("is_in"))
    gone = placed.where("samples_left <= 0").select(fold, *_CELL, "was_in", F.lit(False).alias("is_in"))
    return alive.where("is_in or was_in").unionByName(gone.where("was_in"))


def prefix_windows(total: DataFrame, cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, rho_star, base_over, base_all): windows at or above rho_star, and all, of the k busiest cells, for every wanted (k, rho_star).

    ``wanted`` has few distinct k. The cells between two of them are summed by density, and running sums go over the sizes.
    """
    ks = wanted.select("k").distinct().withColumn("before", F.lag("k").over(Window.orderBy("k")))  # distinct backbone sizes
    steps = materialize(ks)
    low = steps.agg(F.min("k")).scalar()
    spans = steps.select("k", F.explode(F.when(F.col("before").isNull(), F.array("k")).otherwise(F.sequence(F.col("before") + 1, F.col("k")))).alias("upto"))
    ranked = total.join(cells.select(*_CELL, F.greatest("rank", low).alias("upto")), _CELL)
    parts = ranked.join(spans, "upto").groupBy("k", "n_points").agg(F.sum("windows").alias("windows"))
    values = total.select(F.collect_set("n_points")).scalar()  # density values
    grid = steps.select("k", F.explode(values).alias("n_points")).join(parts, ["k", "n_points"], "left").na.fill(0, ["windows"])
    up_to = Window.partitionBy("n_points").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    grid = materialize(grid.withColumn("windows", F.sum("windows").over(up_to)))
    return wanted.distinct().join(grid, "k").groupBy("k", "rho_star").agg(
        _sum_if(F.col("n_points") >= F.col("rho_star"), "windows").alias("base_over"), F.sum("windows").alias("base_all"))


def summarize_folds(total: DataFrame, deltas: DataFrame, folds: DataFrame, fold: str) -> DataFrame:
    """One summary row per fold: the whole histogram ``total`` plus the signed rows ``deltas`` (fold, row, col, n_points, sums).

    ``folds`` names the folds, which may touch nothing. Backbone and critical density are estimated anew in each fold.
    """
    total = materialize(total)
    deltas = materialize(merge_occupancy(deltas, [fold]))
    folds = folds.select(fold).distinct()
    density = materialize(density_rows(total, deltas, folds, fold))
    fit = piecewise(curve_from_occupancy(density, [fold]), [fold]).select(
        fold, "rho_star", F.col("speed_free").alias("_sf"), F.col("speed_congested").alias("_sc"))
    fit = materialize(folds.join(fit, fold))

    cells = materialize(global_rank(traffic(total), _TRAFFIC, levels=2))
    touched = deltas.groupBy(fold, *_CELL).agg(F.sum(F.col("n_points") * F.col("windows")).alias("_p"), F.sum("windows").alias("_s"))
    touched = materialize(touched.join(cells, _CELL).select(
        fold, *_CELL, "rank", (F.col("total_points") + F.col("_p")).alias("points_left"), (F.col("total_samples") + F.col("_s")).alias("samples_left")))
    n_cells = cells.agg(F.count(F.lit(1))).scalar()
    lost = touched.groupBy(fold).agg(F.count(F.lit(1)).alias("touched_cells"), F.count_if(F.col("samples_left") <= 0).alias("_lost"))
    sizes = fit.select(fold, "rho_star").join(lost, fold, "left").na.fill(0, ["touched_cells", "_lost"])
    sizes = sizes.withColumn("active_cells", n_cells - F.col("_lost")).where("active_cells > 0")
    sizes = materialize(sizes.withColumn("k", top_k_size(F.col("active_cells"), BACKBONE_SHARE)))

    # what crosses the cut, and what the deltas take from the cells inside
    changes = materialize(backbone_changes(cells, touched, sizes, fold))
    rho = sizes.select(fold, "rho_star")
    over = F.col("n_points") >= F.col("rho_star")
    crossed = changes.where("was_in <> is_in").join(total.select(*_CELL, "n_points", "windows"), _CELL).withColumn(
        "windows", F.when(F.col("is_in"), F.col("windows")).otherwise(-F.col("windows")))
    inside = deltas.join(changes.where("is_in").select(fold, *_CELL), [fold, *_CELL], "left_semi")
    moved = crossed.select(fold, "n_points", "windows").unionByName(inside.select(fold, "n_points", "windows")).join(rho, fold).groupBy(fold).agg(
        _sum_if(over, "windows").alias("_over"), F.sum("windows").alias("_all"))
    base = prefix_windows(total, cells, sizes.select("k", "rho_star"))
    backbone = sizes.join(base, ["k", "rho_star"]).join(moved, fold, "left").na.fill(0, ["_over", "_all"]).select(
        fold, "active_cells", F.col("k").alias("backbone_cells"), (F.col("base_over") + F.col("_over")).alias("a"),
        (F.col("base_all") + F.col("_all")).alias("_in"))

    mean = lambda test: F.try_divide(F.sum(F.when(test, F.col("speed_sum"))), F.sum(F.when(test, F.col("speed_windows"))))
    whole = density.join(fit, fold).groupBy(fold).agg(
        F.sum("windows").alias("samples"), F.max("rho_star").alias("rho_star"), F.coalesce(F.max("_sf"), mean(~over)).alias("speed_free"),
        F.coalesce(F.max("_sc"), mean(over)).alias("speed_congested"), _sum_if(over, "windows").alias("_congested"))
    a, congested = F.col("a"), F.col("_congested")
    table = whole.join(backbone, fold).withColumns({
        "b": F.col("_in") - a, "c": congested - a, "d": F.col("samples") - F.col("_in") - congested + a})
    return completed(table.select(fold, "samples", "rho_star", "speed_free", "speed_congested", *[F.col(x).cast("bigint").alias(x) for x in "abcd"],
                                  "active_cells", "backbone_cells"))
