"""Neighbourhoods of cell sets by offset expansion and equi-joins (no theta join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.spec import GridSpec


def buffer_cells(cells: DataFrame, radius: int, *, grid: GridSpec | None = None, edge: str = "discard",
                 by: Sequence[str] = ()) -> DataFrame:
    """Cells within Chebyshev distance ``radius``.

    ``edge``: "discard" drops cells outside the grid, "clamp" moves them to the
    border, "unbounded" keeps them.
    """
    span = F.sequence(F.lit(-radius), F.lit(radius))
    grown = cells.select(*by, "row", "col").distinct()
    grown = grown.withColumn("_dr", F.explode(span)).withColumn("_dc", F.explode(span)).select(
        *by, (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"))
    if edge == "clamp":
        grown = grown.withColumns({
            "row": F.greatest(F.lit(0), F.least(F.lit(grid.n_rows - 1), F.col("row"))),
            "col": F.greatest(F.lit(0), F.least(F.lit(grid.n_cols - 1), F.col("col")))})
    elif edge == "discard":
        grown = grown.where(F.col("row").between(0, grid.n_rows - 1) & F.col("col").between(0, grid.n_cols - 1))
    elif edge != "unbounded":
        raise ValueError(edge)
    return grown.distinct()


def neighbour_pairs(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ordered pairs of distinct cells of the set that touch (8-neighbourhood)."""
    by, span = list(by), F.sequence(F.lit(-1), F.lit(1))
    members = cells.select(*by, "row", "col").distinct()
    around = members.withColumn("_dr", F.explode(span)).withColumn("_dc", F.explode(span)).select(
        *by, "row", "col", (F.col("row") + F.col("_dr")).alias("n_row"), (F.col("col") + F.col("_dc")).alias("n_col"))
    around = around.where((F.col("n_row") != F.col("row")) | (F.col("n_col") != F.col("col")))
    targets = members.withColumnsRenamed({"row": "n_row", "col": "n_col"})
    return around.join(targets, by + ["n_row", "n_col"])


def cell_degrees(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of neighbours inside the set, zero included."""
    by = list(by)
    counted = neighbour_pairs(cells, by).groupBy(*by, "row", "col").agg(F.count(F.lit(1)).alias("degree"))
    return cells.select(*by, "row", "col").distinct().join(counted, by + ["row", "col"], "left").na.fill(0, ["degree"])


def set_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of two key sets, their intersection, union, differences and Jaccard index."""
    both = (left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
            .unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))))
    marks = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    count = lambda test: F.count_if(test)
    l, r = F.col("l") == 1, F.col("r") == 1
    out = marks.agg(count(l).alias("left_size"), count(r).alias("right_size"), count(l & r).alias("shared"),
                    count(l | r).alias("either"), count(l & ~r).alias("left_only"), count(r & ~l).alias("right_only"))
    return out.withColumn("jaccard", F.coalesce(F.try_divide(F.col("shared"), F.col("either")), F.lit(0.0)))
