"""Robustness studies of the backbone-congestion coupling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.geo import cell_col, cell_row
from airgrid.functions.time import window_start
from airgrid.operators import cells as cells_op
from airgrid.operators.buffers import buffer_cells, set_overlap
from airgrid.operators.breakpoints import piecewise
from airgrid.operators.curves import curve_from_occupancy
from airgrid.operators.percentiles import exact_percentiles
from airgrid.operators.ranking import global_rank, top_fraction, top_k_size
from airgrid.plans.core import backbone_cells, rho_star, top_shares
from airgrid.plans.folds import summarize_folds
from airgrid.plans.summary import (collection_summary, coupling, label_subsets, group_deltas, negated, summarize,
                                   with_risk)
from airgrid.functions.risk import contingency
from airgrid.session import materialize
from airgrid.spec import BACKBONE_SHARE, GridSpec, WindowSpec


def staged_occupancy(windows: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """The occupancy histogram, written once because every study reads it several times."""
    return materialize(cells_op.occupancy(windows, by, **options))


def chronological_holdout(windows: DataFrame) -> DataFrame:
    """Backbone from one half of the dates, 2x2 table on the other, both directions; rho from all data."""
    dated = windows.withColumn("date", F.to_date("window_start"))
    days = dated.select("date").distinct()
    ranked = days.select("date", F.row_number().over(Window.orderBy("date")).alias("r"))  # one row per calendar day
    n = days.agg(F.count(F.lit(1))).scalar()
    half = ranked.select("date", F.when(F.col("r") <= F.floor(n / 2), "first").otherwise("second").alias("half"))
    occ = staged_occupancy(dated.join(half, "date"), ["half"])
    rho = rho_star(cells_op.merge_occupancy(occ))
    train = top_fraction(cells_op.traffic(occ, ["half"]), "total_points", BACKBONE_SHARE, by=["half"]).select(
        F.when(F.col("half") == "first", "second").otherwise("first").alias("half"), "row", "col")
    flagged = cells_op.in_set(occ, train, "exposed", ["half", "row", "col"])
    out = coupling(flagged, "exposed", rho, ["half"])
    size = train.groupBy("half").agg(F.count(F.lit(1)).alias("backbone_cells_train"))
    direction = F.when(F.col("half") == "second", "forward").otherwise("reverse")
    days_in = half.groupBy("half").agg(F.count(F.lit(1)).alias("test_days"))
    return out.join(size, "half").join(days_in, "half").withColumn("split", direction)


def unique_flight_occupancy(flights: DataFrame, backbone: DataFrame) -> DataFrame:
    """Coupling with density measured as distinct flights; bin centres are bin means."""
    occ = staged_occupancy(flights, density="n_unique")
    fit = piecewise(curve_from_occupancy(occ, center="mean"))
    rho = fit.select("rho_star").scalar()
    table = coupling(cells_op.in_set(occ, backbone, "exposed"), "exposed", rho)
    r = flights.agg(F.corr(F.col("n_unique").cast("double"), "mean_speed").alias("r")).scalar()
    samples = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return table.select("*", r.alias("correlation"), rho.alias("rho_star"),
                        *[fit.select(c).scalar().alias(c) for c in ("speed_free", "speed_congested", "speed_drop_percent")],
                        samples.alias("samples"), ((F.col("a") + F.col("c")) / samples * 100).alias("congestion_share_percent"))


def interface_cells(windows: DataFrame, median: Column) -> DataFrame:
    """Cells with at least one slow window of above-median density."""
    return windows.where(cells_op.interface_like(median)).select("row", "col").distinct()


def terminal_zone_exclusion(windows: DataFrame) -> DataFrame:
    """Critical density with and without interface cells, and the number of windows that remain; null where none do."""
    occ = staged_occupancy(windows)
    cells = interface_cells(windows, cells_op.median_density(occ))
    kept = occ.join(cells, ["row", "col"], "left_anti")
    full, rest = rho_star(occ), rho_star(kept)
    sizes = occ.agg(F.sum("windows").alias("samples"))
    left = kept.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).scalar()
    return sizes.select(cells.agg(F.count(F.lit(1))).scalar().alias("terminal_cells"), left.alias("samples_after_exclusion"),
                        (F.lit(1.0) - left / F.col("samples")).alias("exclusion_ratio"),
                        rest.alias("rho_star_excluded"), full.alias("rho_star_original"))


def hotspot_localization(windows: DataFrame, grid: GridSpec) -> DataFrame:
    """How concentrated congested windows are, and how they meet backbone and interface cells."""
    occ = staged_occupancy(windows)
    rho = rho_star(occ)
    cells = cells_op.exceedance(occ, rho)
    flagged = cells_op.in_set(cells, backbone_cells(occ), "is_backbone")
    flagged = cells_op.in_set(flagged, interface_cells(windows, cells_op.median_density(occ)), "is_interface")
    x, total, active = F.col("exceedance_count"), F.sum("exceedance_count"), F.count(F.lit(1))
    share = lambda test: F.coalesce(F.sum(F.when(test, x)), F.lit(0)) / total
    hot, interface = F.count_if(x > 0), F.count_if(F.col("is_interface"))
    stats = flagged.agg(
        hot.alias("hotspot_cells"), (hot / active).alias("hotspot_share_active_cells"),
        (hot / F.lit(grid.total_cells)).alias("hotspot_share_full_grid"),
        share(F.col("is_backbone")).alias("congested_in_backbone_share"), interface.alias("interface_cells"),
        (interface / active).alias("interface_share_active_cells"),
        F.try_divide(F.count_if(F.col("is_interface") & F.col("is_backbone")), interface).alias("interface_in_backbone_share"),
        share(F.col("is_interface")).alias("congested_in_interface_share"),
        share(F.col("is_interface") & F.col("is_backbone")).alias("congested_in_overlap_share"))
    tops = top_shares(cells, "exceedance_count", {"top_0_5pct_share": 0.005, "top_1pct_share": 0.01})
    return stats.select("*", *[tops.select(c).scalar().alias(c) for c in tops.columns])


def endpoint_anchoring(windows: DataFrame, endpoint_counts: DataFrame, grid: GridSpec) -> DataFrame:
    """Shares of congested windows in, or within one or two cells of, endpoint cells."""
    occ = staged_occupancy(windows)
    cells = cells_op.exceedance(occ, rho_star(occ))
    top = top_fraction(endpoint_counts, "endpoint_count", BACKBONE_SHARE)
    flags = {"in_endpoint": endpoint_counts, "in_top": top, "in_buffer1": buffer_cells(endpoint_counts, 1, grid=grid),
             "in_buffer2": buffer_cells(endpoint_counts, 2, grid=grid)}
    flagged = cells
    for name, members in flags.items():
        flagged = cells_op.in_set(flagged, members, name)
    x, total = F.col("exceedance_count"), F.sum("exceedance_count")
    share = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), x)), F.lit(0)) / total
    hot = F.count_if(x > 0)
    stats = flagged.agg(
        F.count(F.lit(1)).alias("active_cells"), F.count_if((x > 0) & F.col("in_endpoint")).alias("hotspots_in_endpoints"),
        (F.count_if((x > 0) & F.col("in_endpoint")) / hot).alias("hotspot_overlap_share"),
        share("in_endpoint").alias("congested_in_endpoint_share"), share("in_top").alias("congested_in_top_endpoint_share"),
        share("in_buffer1").alias("congested_within_1_share"), share("in_buffer2").alias("congested_within_2_share"))
    n = endpoint_counts.agg(F.count(F.lit(1))).scalar()
    in_backbone = cells_op.in_set(endpoint_counts, backbone_cells(occ), "b").agg(F.avg(F.col("b").cast("int"))).scalar()
    return stats.select("*", n.alias("endpoint_cells"), (n / F.col("active_cells")).alias("endpoint_share_active_cells"),
                        in_backbone.alias("endpoint_backbone_overlap"), top.agg(F.count(F.lit(1))).scalar().alias("top_endpoint_cells"))


def alternative_backbone(windows: DataFrame, flights: DataFrame) -> DataFrame:
    """Backbone by summed distinct flights: overlap with the point-count backbone, and its coupling."""
    occ = staged_occupancy(windows)
    by_flights = flights.groupBy("row", "col").agg(F.sum("n_unique").alias("flights"))
    alternative = top_fraction(by_flights, "flights", BACKBONE_SHARE).select("row", "col")
    table = coupling(cells_op.in_set(occ, alternative, "exposed"), "exposed", rho_star(occ))
    overlap = set_overlap(backbone_cells(occ), alternative, ["row", "col"])
    names = {"right_size": "alternative_cells", "jaccard": "jaccard", "left_only": "point_count_only", "right_only": "flights_only"}
    return table.select("*", *[overlap.select(c).scalar().alias(n) for c, n in names.items()])


def _subset_occupancy(windows: DataFrame, subsets: dict[str, Column], extra: Sequence[str] = ()) -> DataFrame:
    tagged = label_subsets(windows, subsets)
    return staged_occupancy(tagged, ["subset", *extra])


def interface_masking(windows: DataFrame) -> DataFrame:
    """Full sample, without interface windows, only those, and without interface cells; the backbone stays fixed."""
    occ = staged_occupancy(windows)
    median = cells_op.median_density(occ)
    like = cells_op.interface_like(median)
    flagged = cells_op.in_set(windows, interface_cells(windows, median), "interface_cell")
    subsets = {"full_sample": F.lit(True), "excluding_interface_windows": ~like, "interface_windows_only": like,
               "excluding_interface_cells": ~F.col("interface_cell")}
    return summarize(_subset_occupancy(flagged, subsets), ["subset"], backbone=backbone_cells(occ))


def cell_exclusion(windows: DataFrame, exclusions: dict[str, DataFrame]) -> DataFrame:
    """Subset summaries after dropping each named cell set."""
    occ = staged_occupancy(windows)
    for name, cells in exclusions.items():
        occ = cells_op.in_set(occ, cells, f"_{name}")
    tagged = label_subsets(occ, {name: ~F.col(f"_{name}") for name in exclusions})
    return summarize(tagged, ["subset"])


def exclusion_footprint(windows: DataFrame, endpoint_cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Sizes of the endpoint set and its buffer, and the congested windows they take away."""
    occ = staged_occupancy(windows)
    buffer1 = buffer_cells(endpoint_cells, 1, grid=grid, edge="clamp")
    cells = cells_op.in_set(cells_op.exceedance(occ, rho_star(occ)), endpoint_cells, "exact")
    cells = cells_op.in_set(cells, buffer1, "near")
    x = F.col("exceedance_count")
    share = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), x)), F.lit(0)) / F.sum(x)
    out = cells.agg(F.count_if("near").alias("buffer_cells_active"), (F.count_if("near") / F.count(F.lit(1))).alias("buffer_share_active"),
                    share("exact").alias("removed_exact_share"), share("near").alias("removed_buffer_share"))
    count = lambda df: df.select("row", "col").distinct().agg(F.count(F.lit(1))).scalar()
    return out.select("*", count(endpoint_cells).alias("endpoint_cells"), count(buffer1).alias("buffer_cells_grid"))


def phase_altitude(windows: DataFrame, endpoint_buffer: DataFrame, low: float = 120.0, cruise: float = 180.0) -> DataFrame:
    """Five subsets by endpoint proximity and mean window altitude."""
    flagged = cells_op.in_set(windows, endpoint_buffer, "near")
    high = F.col("mean_altitude") >= cruise
    subsets = {"near_endpoint_buffer": F.col("near"), "away_from_endpoint_buffer": ~F.col("near"),
               "low_altitude_lt_120m": F.col("mean_altitude") < low, "cruise_like_altitude_ge_180m": high,
               "away_from_endpoint_and_cruise_like": ~F.col("near") & high}
    return summarize(_subset_occupancy(flagged, subsets), ["subset"])


ALTITUDE_BANDS = ((None, 60.0), (60.0, 120.0), (120.0, 180.0), (180.0, 240.0), (240.0, None), (None, None))


def band_label(lower: float | None, upper: float | None) -> str:
    if lower is None:
        return "all_sample" if upper is None else f"lt_{int(upper)}m"
    return f"ge_{int(lower)}m" if upper is None else f"{int(lower)}_{int(upper)}m"


def band_tests(bands: Sequence[tuple]) -> dict[str, Column]:
    tests = {}
    for lower, upper in bands:
        test = F.lit(True)
        if lower is not None:
            test = test & (F.col("mean_altitude") >= lower)
        if upper is not None:
            test = test & (F.col("mean_altitude") < upper)
        tests[band_label(lower, upper)] = test
    return tests


def altitude_bands(windows: DataFrame, bands: Sequence[tuple] = ALTITUDE_BANDS) -> DataFrame:
    """Summary, backbone overlap with the full backbone, and altitude quartiles per band."""
    full = backbone_cells(staged_occupancy(windows))
    tagged = label_subsets(windows, band_tests(bands))
    occ = staged_occupancy(tagged, ["subset"])
    own = top_fraction(cells_op.traffic(occ, ["subset"]), "total_points", BACKBONE_SHARE, by=["subset"])
    overlap = cells_op.in_set(own, full, "shared").groupBy("subset").agg(F.avg(F.col("shared").cast("int")).alias("backbone_overlap_share"))
    quart = exact_percentiles(tagged, "mean_altitude", {"altitude_p25": .25, "altitude_p50": .5, "altitude_p75": .75}, width=0.5, by=["subset"])
    total = windows.agg(F.count(F.lit(1))).scalar()
    out = summarize(occ, ["subset"]).join(overlap, "subset").join(quart, "subset")
    return out.withColumn("sample_share_percent", F.col("samples") / total * 100)


def grid_size_sensitivity(points: DataFrame, sizes: Sequence[float], window: WindowSpec) -> DataFrame:
    """The whole pipeline on several cell sizes; points are spread over sizes map-side, then aggregated once."""
    specs = [GridSpec(float(s)) for s in sizes]
    cells = F.explode(F.array(*[F.struct(F.lit(int(g.size_m)).alias("grid_size_m"), cell_row(F.col("latitude"), g).alias("row"),
                                         cell_col(F.col("longitude"), g).alias("col")) for g in specs]))
    placed = points.select("speed", window_start(F.col("datetime"), window.seconds).alias("window_start"), cells.alias("c"))
    by = ["grid_size_m"]
    windows = placed.groupBy("c.grid_size_m", "c.row", "c.col", "window_start").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("speed").alias("mean_speed"))
    # every window counts here, also standing ones
    occ = staged_occupancy(windows, by).withColumns({"moving_windows": F.col("windows"), "moving_sum": F.col("speed_sum")})
    out = summarize(occ, by)
    cells_table = cells_op.traffic(occ, by)
    top = top_fraction(cells_table, "total_points", BACKBONE_SHARE, by=by).groupBy(*by).agg(F.sum("total_points").alias("_top"))
    whole = cells_table.groupBy(*by).agg(F.sum("total_points").alias("_all"))
    hot = occ.join(out.select(*by, "rho_star"), by).where(F.col("n_points") >= F.col("rho_star")).select(*by, "row", "col").distinct()
    hot = hot.groupBy(*by).agg(F.count(F.lit(1)).alias("hotspot_cells"))
    total = F.lit(None).cast("bigint")
    for g in specs:
        total = F.when(F.col("grid_size_m") == int(g.size_m), F.lit(g.total_cells)).otherwise(total)
    out = out.join(top, by).join(whole, by).join(hot, by, "left").na.fill(0, ["hotspot_cells"])
    return out.withColumns({"top10_traffic_share": F.col("_top") / F.col("_all"), "total_cells": total,
                            "active_share_full_grid": F.col("active_cells") / total})


def backbone_cutoffs(occ: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Coverage and coupling of backbones of several sizes.

    Cells are ranked once; each cutoff then only compares ranks.
    """
    cells = cells_op.traffic(occ).join(cells_op.exceedance(occ, rho_star(occ)).drop("total_samples"), ["row", "col"])
    ranked = global_rank(cells, [("total_points", False), ("row", True), ("col", True)], levels=2)
    n = cells.agg(F.count(F.lit(1))).scalar()
    spread = ranked.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    inside = F.col("rank") <= top_k_size(n, F.col("cutoff"))
    x, s = F.col("exceedance_count"), F.col("total_samples")
    pick = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("bigint")
    table = spread.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("active_cells"), F.count_if(inside).alias("backbone_cells"),
        pick(inside, F.col("total_points")).alias("backbone_points"), F.sum("total_points").alias("_points"),
        F.count_if(x > 0).alias("hotspot_cells"), F.count_if((x > 0) & inside).alias("hotspot_cells_covered"),
        pick(inside, x).alias("a"), pick(inside, s - x).alias("b"), pick(~inside, x).alias("c"), pick(~inside, s - x).alias("d"))
    return with_risk(table).withColumns({
        "backbone_cell_share": F.col("backbone_cells") / F.col("active_cells"),
        "traffic_share": F.col("backbone_points") / F.col("_points"),
        "hotspot_share": F.try_divide(F.col("hotspot_cells_covered"), F.col("hotspot_cells")),
        "exceedance_share": F.try_divide(F.col("a"), F.col("a") + F.col("c"))})


def cutoff_contrasts(table: DataFrame, pairs: Sequence[tuple[float, float]]) -> DataFrame:
    """Gains and ratios between two cutoffs, one row per pair."""
    out = None
    table = materialize(table)  # one row per cutoff
    for small, large in pairs:
        at = lambda c, v: F.max(F.when(F.col("cutoff") == v, F.col(c)))
        gain = lambda c: at(c, large) - at(c, small)
        ratio = lambda c: F.try_divide(at(c, large), at(c, small))
        row = table.agg(F.lit(f"{small:g} vs {large:g}").alias("contrast"), ratio("backbone_cell_share").alias("footprint_ratio"),
                        gain("traffic_share").alias("traffic_gain"), gain("hotspot_share").alias("hotspot_gain"),
                        gain("exceedance_share").alias("exceedance_gain"), ratio("rr").alias("rr_ratio"),
                        ratio("odds_ratio").alias("or_ratio"))
        out = row if out is None else out.unionByName(row)
    return out


def threshold_subsets(windows: DataFrame, endpoint_buffer: DataFrame) -> DataFrame:
    """The four labelled subset rows: full, without interface windows, without endpoint buffer, away and high."""
    pick = ["subset", "rho_star", "speed_drop_percent", "rr", "rr_lo", "rr_hi", "samples"]
    masked = interface_masking(windows)
    excluded = cell_exclusion(windows, {"buffer": endpoint_buffer})
    phases = phase_altitude(windows, endpoint_buffer)
    rows = [(masked, "full_sample", "Full sample"), (masked, "excluding_interface_windows", "Exclude interface-like windows"),
            (excluded, "buffer", "Exclude endpoint +1 buffer"),
            (phases, "away_from_endpoint_and_cruise_like", "Away-from-endpoint, altitude >=180 m")]
    out = None
    for frame, key, label in rows:
        part = frame.where(F.col("subset") == key).select(*pick).withColumn("subset", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def leave_one_day_out(windows: DataFrame) -> DataFrame:
    """Summary of every leave-one-day-out fold."""
    dated = windows.withColumn("fold", F.date_format("window_start", "yyyy-MM-dd"))
    daily = staged_occupancy(dated, ["fold"])
    return summarize_folds(cells_op.merge_occupancy(daily), negated(daily), daily, "fold")


def leave_one_group_out(parts: DataFrame, group: str) -> DataFrame:
    """Summary without each vendor, vendor-day or route-day, by subtracting its contributions."""
    parts = materialize(parts)
    windows = cells_op.from_contributions(parts)
    total = staged_occupancy(windows)
    out = summarize_folds(total, group_deltas(parts, group), parts, group)
    removed = parts.groupBy(group).agg(F.sum("n_points").alias("removed_point_rows"), F.count(F.lit(1)).alias("removed_cell_windows"))
    return out.join(removed, group)


def leave_selected_groups_out(parts: DataFrame, group: str, selected: DataFrame) -> DataFrame:
    """Like :func:`leave_one_group_out`, folding only over the selected groups; all groups stay in the total."""
    total = cells_op.occupancy(cells_op.from_contributions(parts))
    deltas = group_deltas(parts, group, parts.join(selected, group, "left_semi"))
    return summarize_folds(total, deltas, deltas, group)


def leave_cells_out(occ: DataFrame, cell_groups: DataFrame, fold: str) -> DataFrame:
    """Summary without the cells of each group (hub neighbourhoods), with what was removed."""
    rho = rho_star(occ)
    hit = occ.join(cell_groups.select(fold, "row", "col").distinct(), ["row", "col"])
    taken = hit.groupBy(fold).agg(F.count_distinct("row", "col").alias("removed_active_cells"), F.sum("windows").alias("removed_samples"),
                                  F.coalesce(F.sum(F.when(F.col("n_points") >= rho, F.col("windows"))), F.lit(0)).alias("removed_congested"))
    out = summarize_folds(occ, negated(hit.select(fold, "row", "col", "n_points", *cells_op.OCCUPANCY_SUMS)), cell_groups, fold)
    total = cells_op.exceedance(occ, rho).agg(F.sum("exceedance_count")).scalar()
    out = out.join(taken, fold, "left").na.fill(0, ["removed_active_cells", "removed_samples", "removed_congested"])
    return out.withColumn("removed_congested_share", F.col("removed_congested") / total)


