"""Subset summaries: breakpoint, backbone and 2x2 coupling, for many subsets in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.risk import contingency, finite, fisher_p, risk_columns
from airgrid.operators.breakpoints import piecewise
from airgrid.operators.cells import OCCUPANCY_SUMS, in_set, merge_occupancy, traffic
from airgrid.operators.curves import curve_from_occupancy
from airgrid.operators.ranking import top_fraction
from airgrid.session import materialize
from airgrid.spec import BACKBONE_SHARE


def with_risk(table: DataFrame) -> DataFrame:
    return table.withColumns(risk_columns())


def coupling(occ: DataFrame, exposed: str, rho: Column, by: Sequence[str] = ()) -> DataFrame:
    """2x2 table and risk measures of an exposure flag against n_points >= rho."""
    table = occ.groupBy(*by).agg(*contingency(F.col(exposed), F.col("n_points") >= rho, F.col("windows")))
    return with_risk(table)


def summarize(occ: DataFrame, by: Sequence[str] = (), *, backbone: DataFrame | None = None,
              rho: Column | None = None) -> DataFrame:
    """One row per subset.

    ``occ`` is an occupancy histogram, with the subset id in ``by``. The
    backbone and the critical density are re-estimated per subset unless given.
    With a re-estimated rho the speeds are means over curve bins, with a fixed
    one they are means over windows.
    """
    by, occ = list(by), materialize(occ)
    cells = traffic(occ, by)
    members = top_fraction(cells, "total_points", BACKBONE_SHARE, by=by).select(*by, "row", "col") \
        if backbone is None else backbone.select("row", "col").distinct()
    keys = (by if backbone is None else []) + ["row", "col"]
    flagged = in_set(occ, members, "is_backbone", keys)
    if rho is None:
        fit = piecewise(curve_from_occupancy(occ, by), by).select(
            *by, "rho_star", F.col("speed_free").alias("_sf"), F.col("speed_congested").alias("_sc"))
        if by:
            flagged = flagged.join(fit, by)
        else:
            flagged = flagged.withColumns({c: fit.select(c).scalar() for c in ("rho_star", "_sf", "_sc")})
    else:
        flagged = flagged.withColumns({"rho_star": rho, "_sf": F.lit(None).cast("double"), "_sc": F.lit(None).cast("double")})
    over = F.col("n_points") >= F.col("rho_star")
    mean = lambda test: F.try_divide(F.sum(F.when(test, F.col("speed_sum"))), F.sum(F.when(test, F.col("speed_windows"))))
    out = flagged.groupBy(*by).agg(
        F.sum("windows").alias("samples"), F.max("rho_star").alias("rho_star"),
        F.coalesce(F.max("_sf"), mean(~over)).alias("speed_free"), F.coalesce(F.max("_sc"), mean(over)).alias("speed_congested"),
        *contingency(F.col("is_backbone"), over, F.col("windows")))
    counts = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("active_cells"))
    if by:
        out = out.join(counts, by)
        if backbone is None:
            out = out.join(members.groupBy(*by).agg(F.count(F.lit(1)).alias("backbone_cells")), by)
        else:
            out = out.withColumn("backbone_cells", members.agg(F.count(F.lit(1))).scalar())
    else:
        out = out.withColumns({"active_cells": counts.scalar(), "backbone_cells": members.agg(F.count(F.lit(1))).scalar()})
    return completed(out)


def completed(table: DataFrame) -> DataFrame:
    """Risk measures, speed drop and congestion share of rows with a, b, c, d, both speeds and samples."""
    drop = F.when(F.col("speed_free") > 0, (F.col("speed_free") - F.col("speed_congested")) / F.col("speed_free") * 100)
    return with_risk(table).withColumns({
        "fisher_p": fisher_p(),
        "speed_drop_percent": drop,
        "congestion_share_percent": (F.col("a") + F.col("c")) / F.col("samples") * 100})


def label_subsets(occ: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Stack overlapping subsets of an occupancy table; each row is repeated once per subset it belongs to."""
    tags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in subsets.items()]))
    return occ.withColumn("subset", F.explode(tags))


def collection_summary(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Range of finite rr, rho_star and odds ratio over a collection of runs."""
    picks = [F.count(F.lit(1)).alias("n_runs")]
    for column, name in (("rr", "rr"), ("rho_star", "rho_star"), ("odds_ratio", "or")):
        value = finite(F.col(column))
        picks += [F.min(value).alias(f"{name}_min"), F.median(value).alias(f"{name}_median"), F.max(value).alias(f"{name}_max")]
    return summaries.groupBy(*by).agg(*picks)


def negated(occ: DataFrame) -> DataFrame:
    return occ.withColumns({c: -F.col(c) for c in OCCUPANCY_SUMS})


def group_deltas(parts: DataFrame, group: str, removed: DataFrame | None = None) -> DataFrame:
    """Signed occupancy rows that turn the full histogram into the one without ``group``.

    ``parts`` are per-group contributions (n_points, speed_sum) of cell-windows.
    Each affected window leaves its old density and, if points remain, enters the
    new one. ``removed`` limits the folds to some groups' contributions.
    """
    keys = ["row", "col", "window_start"]
    full = parts.groupBy(*keys).agg(F.sum("n_points").alias("_n"), F.sum("speed_sum").alias("_s"))
    joined = (parts if removed is None else removed).join(full, keys)

    def rows(n: Column, s: Column, sign: int) -> Column:
        mean, one = s / n, F.lit(sign).cast("bigint")
        moving = mean > 0
        return F.struct(n.alias("n_points"), one.alias("windows"), (mean * sign).alias("speed_sum"), one.alias("speed_windows"),
                        F.when(moving, one).otherwise(F.lit(0).cast("bigint")).alias("moving_windows"),
                        F.when(moving, mean * sign).otherwise(F.lit(0.0)).alias("moving_sum"))

    left_n, left_s = F.col("_n") - F.col("n_points"), F.col("_s") - F.col("speed_sum")
    moves = F.array_compact(F.array(rows(F.col("_n"), F.col("_s"), -1), F.when(left_n > 0, rows(left_n, left_s, 1))))
    exploded = joined.select(group, "row", "col", F.explode(moves).alias("m")).select(group, "row", "col", "m.*")
    return merge_occupancy(exploded, [group])
