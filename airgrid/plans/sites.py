"""Site inventories against the grid: anchors, coverage, hubs, monitoring budgets, per-cell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.geo import cell_id, centroid_lat, centroid_lon, with_cell
from airgrid.functions.risk import risk_columns
from airgrid.operators.buffers import buffer_cells
from airgrid.operators.cells import exceedance, in_set, traffic
from airgrid.operators.graph import cell_node
from airgrid.operators.joins import lookup_join
from airgrid.operators.ranking import rank_with_shares, top_k_size
from airgrid.operators.spatial import pairs_within, position_pairs
from airgrid.plans.core import backbone_cells, ranked_cells, rho_star
from airgrid.plans.robustness import leave_cells_out
from airgrid.session import materialize
from airgrid.spec import MONITORING_BUDGETS, GridSpec


def site_inventory(raw: DataFrame, city: str, test_mark: str, grid: GridSpec) -> DataFrame:
    """Sites of one city with usable coordinates, their cells and the test-site flag."""
    typed = raw.where(F.col("city") == city).withColumns({
        "note": F.coalesce("note", F.lit("")), "open_time": F.trim(F.coalesce("open_time", F.lit(""))),
        "lon": F.col("lon").try_cast("double"), "lat": F.col("lat").try_cast("double")})
    typed = typed.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    flag = F.contains("note", F.lit(test_mark)) | F.contains("site_name", F.lit(test_mark))
    return with_cell(typed.withColumn("is_test_site", flag), grid, "lon", "lat")


def anchor_sets(inventory: DataFrame) -> DataFrame:
    """Rows tagged with the sets they belong to: every site, and sites in operation."""
    sets = F.when(F.col("is_test_site"), F.array(F.lit("all_sites"))).otherwise(F.array(F.lit("all_sites"), F.lit("operational_sites")))
    return inventory.withColumn("anchor_set", F.explode(sets))


def site_metadata(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("anchor_set").agg(
        F.count(F.lit(1)).alias("site_rows"), F.count_distinct("site_name").alias("site_names"),
        F.count_distinct("row", "col").alias("anchor_cells"), F.count_if("is_test_site").alias("test_site_rows"))


def platform_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("anchor_set", "platform").agg(F.count(F.lit(1)).alias("sites"))


def operational_sites(inventory: DataFrame) -> DataFrame:
    """One row per operating site name (smallest coordinates win)."""
    return inventory.where(~F.col("is_test_site")).groupBy("site_name").agg(
        F.min(F.struct("lon", "lat", "row", "col", "platform")).alias("s")).select("site_name", "s.*")


def close_site_pairs(inventory: DataFrame, threshold_m: float) -> DataFrame:
    """Every pair of sites under the threshold."""
    return pairs_within(operational_sites(inventory), "site_name", threshold_m, strict=True, salts=16)


def closest_pair(sites: DataFrame, start_m: float) -> DataFrame:
    """The closest pair of sites; the search radius doubles until a pair appears. Equal distances (to a micrometre) are decided by names."""
    sites, radius = materialize(sites), start_m
    while True:
        pairs = position_pairs(sites, "site_name", radius).withColumn("distance_m", F.round("distance_m", 6))
        best = materialize(pairs.agg(F.min(F.struct("distance_m", "site_name_a", "site_name_b")).alias("b")).select("b.*"))
        if radius > 4.1e7 or not best.where(F.col("distance_m").isNotNull()).isEmpty():
            return best
        radius *= 2


def site_distance_summary(inventory: DataFrame, threshold_m: float) -> DataFrame:
    """Site count, pairs under the threshold and the closest pair of all."""
    sites = materialize(operational_sites(inventory))
    best = closest_pair(sites, threshold_m)
    pairs = position_pairs(sites, "site_name", threshold_m, strict=True).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs_within_threshold"))
    return pairs.select(sites.agg(F.count(F.lit(1))).scalar().alias("operational_sites"), "pairs_within_threshold",
                        *[best.select(c).scalar().alias(n) for c, n in (("distance_m", "nearest_distance_m"), ("site_name_a", "site_a"), ("site_name_b", "site_b"))])


def cell_flags(occ: DataFrame, endpoint_cells: DataFrame) -> DataFrame:
    """Active cells with exceedance counts and backbone, hotspot, endpoint flags."""
    rho = rho_star(occ)
    cells = exceedance(occ, rho).join(traffic(occ).drop("total_samples"), ["row", "col"])
    cells = in_set(cells, backbone_cells(occ), "is_backbone")
    cells = in_set(cells, endpoint_cells, "is_endpoint")
    return cells.withColumns({"is_hotspot": F.col("exceedance_count") > 0})


def anchor_coverage(flags: DataFrame, endpoint_cells: DataFrame, anchors: DataFrame, by: Sequence[str]) -> DataFrame:
    """What each anchor cell set covers, with the relative risk of exceedance inside it."""
    by, x, s = list(by), F.col("exceedance_count"), F.col("total_samples")
    anchors = materialize(anchors.select(*by, "row", "col").distinct())
    sizes = anchors.groupBy(*by).agg(F.count(F.lit(1)).alias("anchor_cells"))
    ends = anchors.join(endpoint_cells.select("row", "col").distinct(), ["row", "col"]).groupBy(*by).agg(F.count(F.lit(1)).alias("endpoint_cells_covered"))
    inside = anchors.join(flags, ["row", "col"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("active_cells_covered"), F.count_if("is_backbone").alias("backbone_cells_covered"),
        F.count_if("is_hotspot").alias("hotspot_cells_covered"), F.sum(x).alias("a"), F.sum(s - x).alias("b"))
    out = sizes.join(ends, by, "left").join(inside, by, "left").na.fill(0)
    totals = flags.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_backbone").alias("bb"), F.count_if("is_hotspot").alias("hot"),
                       F.sum(x).alias("x"), F.sum(s - x).alias("y"))
    total = {c: totals.select(c).scalar() for c in totals.columns}
    n_end = endpoint_cells.select("row", "col").distinct().agg(F.count(F.lit(1))).scalar()
    out = out.withColumns({"c": total["x"] - F.col("a"), "d": total["y"] - F.col("b")}).withColumns(risk_columns())
    share = lambda c, t: F.coalesce(F.try_divide(F.col(c), t), F.lit(0.0))
    return out.withColumns({
        "active_share": share("active_cells_covered", total["n"]), "backbone_share": share("backbone_cells_covered", total["bb"]),
        "hotspot_share": share("hotspot_cells_covered", total["hot"]), "endpoint_share": share("endpoint_cells_covered", n_end),
        "exceedance_share": share("a", total["x"])})


def site_buffers(tagged: DataFrame, grid: GridSpec, radii: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Cells around the sites of each anchor set, per radius (outside the grid dropped)."""
    cells, out = materialize(tagged.select("anchor_set", "row", "col").distinct()), None
    for radius in radii:
        part = buffer_cells(cells, radius, grid=grid, by=["anchor_set"]).withColumn("radius", F.lit(radius))
        out = part if out is None else out.unionByName(part)
    return out


def figure_anchors(flags: DataFrame, endpoint_cells: DataFrame, tagged: DataFrame, grid: GridSpec) -> DataFrame:
    """The six labelled anchor sets: backbone, endpoints, endpoint buffer, sites and two site buffers."""
    sites = tagged.where(F.col("anchor_set") == "operational_sites")
    sets = {"Backbone (top 10%)": flags.where("is_backbone"), "Endpoint exact": endpoint_cells,
            "Endpoint +1 cell": buffer_cells(endpoint_cells, 1, grid=grid), "Station exact": sites,
            "Station +1 cell": buffer_cells(sites, 1, grid=grid), "Station +2 cells": buffer_cells(sites, 2, grid=grid)}
    out = None
    for label, cells in sets.items():
        part = cells.select(F.lit(label).alias("anchor_label"), "row", "col")
        out = part if out is None else out.unionByName(part)
    return anchor_coverage(flags, endpoint_cells, out, ["anchor_label"])


def mapped_sites(tagged: DataFrame, flags: DataFrame) -> DataFrame:
    """Site table with the flags of the cell each site lies in."""
    marks = flags.select("row", "col", F.lit(True).alias("is_active"), "is_backbone", "is_hotspot", "is_endpoint")
    names = ["is_active", "is_backbone", "is_hotspot", "is_endpoint"]
    return tagged.join(marks, ["row", "col"], "left").na.fill(False, names).withColumn("grid_cell_id", cell_id(F.col("row"), F.col("col")))


def cell_metrics(cells: DataFrame, occ: DataFrame, endpoint_cells: DataFrame, tagged: DataFrame, grid: GridSpec) -> DataFrame:
    """Per-cell table: rank, shares, exceedance, flags, centroid; endpoint cells without traffic are appended."""
    rho = rho_star(occ)
    samples = exceedance(occ, rho)
    hot = rank_with_shares(samples.where(F.col("exceedance_count") > 0), "exceedance_count").select(
        "row", "col", F.col("share").alias("exceedance_share"), F.col("cumulative_share").alias("cumulative_exceedance_share"))
    active = cells.agg(F.count(F.lit(1))).scalar()
    ranked = ranked_cells(cells).select("row", "col", "rank", "total_points", F.col("share").alias("traffic_share"),
                                        F.col("cumulative_share").alias("cumulative_traffic_share"), "active_days", "active_hours", "is_backbone_cell")
    table = ranked.join(samples, ["row", "col"], "left").join(hot, ["row", "col"], "left").withColumn("traffic_rank_pct", F.col("rank") / active)
    missing = endpoint_cells.select("row", "col").distinct().join(ranked, ["row", "col"], "left_anti")
    missing = missing.withColumns({"total_points": F.lit(0).cast("bigint"), "cumulative_traffic_share": F.lit(1.0), "is_backbone_cell": F.lit(False)})
    table = table.unionByName(missing, allowMissingColumns=True)
    table = table.na.fill(0, ["exceedance_count", "total_samples", "exceedance_share", "cumulative_exceedance_share", "traffic_share",
                              "active_days", "active_hours"])
    sites = materialize(tagged.where(F.col("anchor_set") == "operational_sites").select("row", "col").distinct())
    ends = materialize(endpoint_cells.select("row", "col").distinct())
    for name, members in (("is_endpoint_cell", ends), ("endpoint_buffer1_cell", buffer_cells(ends, 1, grid=grid)), ("station_exact_cell", sites),
                          ("station_buffer1_cell", buffer_cells(sites, 1, grid=grid)), ("station_buffer2_cell", buffer_cells(sites, 2, grid=grid))):
        table = in_set(table, members, name)
    return table.withColumns({
        "is_hotspot_cell": F.col("exceedance_count") > 0, "log10_total_points": F.log10(F.greatest(F.col("total_points"), F.lit(1)).cast("double")),
        "lon": centroid_lon(F.col("col"), grid), "lat": centroid_lat(F.col("row"), grid)})


def hub_cells(inventory: DataFrame) -> DataFrame:
    """Cells within one cell of each operating site (not limited to the grid)."""
    return buffer_cells(operational_sites(inventory).select("site_name", "row", "col"), 1, edge="unbounded", by=["site_name"])



def leave_hubs_out(occ: DataFrame, inventory: DataFrame) -> DataFrame:
    """One summary per operating site, without the cells of its hub area.

    Sites of one cell have the same area, so there is one fold per occupied cell, whatever the number of sites; its row is looked up by each site.
    """
    placed = materialize(operational_sites(inventory).select("site_name", cell_node().alias("area"), "row", "col"))
    areas = materialize(buffer_cells(placed.select("area", "row", "col"), 1, edge="unbounded", by=["area"]))
    folds = materialize(leave_cells_out(occ, areas, "area").withColumn("_found", F.lit(True)))
    return lookup_join(placed.select("site_name", "area"), folds, ["area"]).where("_found").drop("area", "_found")


def ranked_hubs(folds: DataFrame) -> DataFrame:
    """Hub folds ordered by removed exceedance, removed samples, name."""
    return folds.orderBy(F.desc("removed_congested_share"), F.desc("removed_samples"), "site_name")


def top_hub_cells(folds: DataFrame, hubs: DataFrame, k: int = 3) -> DataFrame:
    """Union of the cells of the ``k`` hubs whose removal takes away most exceedance."""
    return hubs.join(ranked_hubs(folds).select("site_name").limit(k), "site_name", "left_semi").select("row", "col").distinct()


def top_traffic_budgets(flags: DataFrame, budgets: Sequence[float] = MONITORING_BUDGETS) -> DataFrame:
    """Exceedance and traffic captured by monitoring the busiest cells, per budget."""
    ranked = rank_with_shares(flags.select("row", "col", "total_points", "exceedance_count"), "total_points")
    n = flags.agg(F.count(F.lit(1))).scalar()
    spread = ranked.withColumn("budget_share", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    inside = F.col("rank") <= top_k_size(n, F.col("budget_share"))
    pick = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0))
    out = spread.groupBy("budget_share").agg(
        F.count_if(inside).alias("budget_cells"), pick("exceedance_count").alias("captured_exceedance"),
        F.try_divide(pick("exceedance_count"), F.sum("exceedance_count")).alias("captured_exceedance_share"), pick("share").alias("captured_traffic_share"))
    return out.withColumns({"strategy": F.lit("top_traffic_cells"),
                            "lift_exceedance": F.col("captured_exceedance_share") / F.col("budget_share"),
                            "lift_traffic": F.col("captured_traffic_share") / F.col("budget_share")})


def site_budgets(coverage: DataFrame) -> DataFrame:
    """Site-based monitoring expressed as budgets, one row per radius."""
    return coverage.where(F.col("anchor_set") == "operational_sites").select(
        F.concat(F.lit("station_radius_"), F.col("radius").cast("string")).alias("strategy"), F.col("active_share").alias("budget_share"),
        F.col("active_cells_covered").alias("budget_cells"), F.col("a").alias("captured_exceedance"),
        F.col("exceedance_share").alias("captured_exceedance_share"),
        F.try_divide(F.col("exceedance_share"), F.col("active_share")).alias("lift_exceedance"))


def monitoring_payoff(flags: DataFrame, coverage: DataFrame) -> DataFrame:
    return top_traffic_budgets(flags).unionByName(site_budgets(coverage), allowMissingColumns=True)
