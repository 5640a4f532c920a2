"""Registered queries: sites, anchors, cell tables, monitoring, endpoint heights, follow-up flights (A37-A40, C14-C17, C19, C23, G21-G23, J1, J8, J11-J13, J15, R16-R18, S4, S6-S7, S13-S15, W13, P11, P16, P21, P24-P25, P28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid import sinks
from airgrid.catalog import robustness as r
from airgrid.catalog import sql as q
from airgrid.catalog import trips as t
from airgrid.catalog.inputs import GRID, WINDOW, staged
from airgrid.catalog.registry import query
from airgrid.functions.geo import centroid_lat, centroid_lon
from airgrid.operators import buffers, cells as cells_op, trips
from airgrid.operators.sequences import compress_visits, transitions
from airgrid.plans import core, followup, heights, resampling as rs, robustness as rb, routes, sites
from airgrid.plans.summary import summarize
from airgrid.session import materialize, table_path
from airgrid.sources import tables

# ---------------------------------------------------------------- inventory
q.view("inventory", f"""SELECT *, {q.row_of('lat', GRID)} AS row, {q.col_of('lon', GRID)} AS col FROM (
  SELECT site_name, platform, coalesce(note, '') AS note, trim(coalesce(open_time, '')) AS open_time, try_cast(lon AS DOUBLE) AS lon, try_cast(lat AS DOUBLE) AS lat,
  contains(coalesce(note, ''), 'test') OR contains(site_name, 'test') AS is_test_site FROM sites WHERE city = 'main') WHERE lon IS NOT NULL AND lat IS NOT NULL""")
q.view("tagged_sites", "SELECT unnest(CASE WHEN is_test_site THEN ['all_sites'] ELSE ['all_sites', 'operational_sites'] END) AS anchor_set, * FROM inventory")
q.view("oper_sites", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_name ORDER BY lon, lat) AS rn FROM inventory WHERE NOT is_test_site) WHERE rn = 1")


@staged
def inventory_of(i):
    return sites.site_inventory(i.sites, "main", "test", GRID)


@staged
def tagged_of(i):
    return sites.anchor_sets(inventory_of(i))


@query("site_inventory", "site_name:s platform:s note:s open_time:s lon:f lat:f is_test_site:b row:i col:i", "SELECT * FROM inventory")
def site_inventory(i):
    """S4, P24."""
    return inventory_of(i)


@query("site_metadata", "anchor_set:s site_rows:i site_names:i anchor_cells:i test_site_rows:i",
       """SELECT anchor_set, count(*) AS site_rows, count(DISTINCT site_name) AS site_names, count(DISTINCT (row, col)) AS anchor_cells, count(*) FILTER (is_test_site) AS test_site_rows FROM tagged_sites GROUP BY 1""")
def site_metadata(i):
    """A40."""
    return sites.site_metadata(tagged_of(i))


@query("site_platform_counts", "anchor_set:s platform:s sites:i", "SELECT anchor_set, platform, count(*) AS sites FROM tagged_sites GROUP BY 1, 2")
def site_platform_counts(i):
    """A40."""
    return sites.platform_counts(tagged_of(i))


q.view("every_site_pair", f"""SELECT a.site_name AS site_name_a, b.site_name AS site_name_b, {q.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_m FROM oper_sites a JOIN oper_sites b ON a.site_name < b.site_name""")
q.view("site_spots", "SELECT lat, lon, count(*) AS n, min(site_name) AS low, max(site_name) AS high FROM oper_sites GROUP BY lat, lon")
q.view("site_pairs", f"""SELECT a.lat AS lat_a, a.lon AS lon_a, b.lat AS lat_b, b.lon AS lon_b, a.n AS n_a, b.n AS n_b, a.n * b.n AS pairs, a.low AS site_name_a, b.low AS site_name_b,
    {q.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_m FROM site_spots a JOIN site_spots b ON (a.lat, a.lon) < (b.lat, b.lon)
  UNION ALL SELECT lat, lon, lat, lon, n, n, n * (n - 1) / 2, low, high, 0.0 FROM site_spots WHERE n > 1""")


@query("close_site_pairs", "site_name_a:s site_name_b:s distance_m:f3", "SELECT * FROM every_site_pair WHERE distance_m < 300")
def close_site_pairs(i):
    """J11 (pairs under the threshold)."""
    return sites.close_site_pairs(inventory_of(i), 300.0)


@query("site_distance_summary", "operational_sites:i pairs_within_threshold:i nearest_distance_m:f3 site_a:s site_b:s",
       """SELECT (SELECT count(*) FROM oper_sites) AS operational_sites, (SELECT coalesce(sum(pairs), 0) FROM site_pairs WHERE distance_m < 300) AS pairs_within_threshold,
       round(distance_m, 6) AS nearest_distance_m, site_name_a AS site_a, site_name_b AS site_b FROM site_pairs ORDER BY round(distance_m, 6), site_name_a, site_name_b LIMIT 1""")
def site_distance_summary(i):
    """J11 (counts and closest pair)."""
    return sites.site_distance_summary(inventory_of(i), 300.0)


# ------------------------------------------------------------------ coverage
q.view("flag_cells", """SELECT c.row, c.col, c.total_points, x, s, b.row IS NOT NULL AS bb, h.row IS NOT NULL AS ep, x > 0 AS hot FROM cells c JOIN cell_x USING (row, col)
  LEFT JOIN backbone b ON b.row = c.row AND b.col = c.col LEFT JOIN hub_cells h ON h.row = c.row AND h.col = c.col""")


def coverage_sql(anchors: str, by: str) -> str:
    return f"""SELECT {q.rr_columns()}, {by}, anchor_cells, active_cells_covered, backbone_cells_covered, hotspot_cells_covered, endpoint_cells_covered, active_cells_covered::DOUBLE/(SELECT count(*) FROM flag_cells) AS active_share,
      backbone_cells_covered::DOUBLE/(SELECT count(*) FROM flag_cells WHERE bb) AS backbone_share, hotspot_cells_covered::DOUBLE/(SELECT count(*) FROM flag_cells WHERE hot) AS hotspot_share,
      endpoint_cells_covered::DOUBLE/(SELECT count(*) FROM hub_cells) AS endpoint_share, a::DOUBLE/(SELECT sum(x) FROM flag_cells) AS exceedance_share FROM (
      SELECT *, (SELECT sum(x) FROM flag_cells) - a AS c, (SELECT sum(s-x) FROM flag_cells) - b AS d FROM (
      SELECT {by}, count(*) AS anchor_cells, count(f.row) AS active_cells_covered, count(*) FILTER (f.bb) AS backbone_cells_covered, count(*) FILTER (f.hot) AS hotspot_cells_covered, count(h.row) AS endpoint_cells_covered,
        coalesce(sum(x), 0) AS a, coalesce(sum(s-x), 0) AS b FROM (SELECT DISTINCT {by}, row, col FROM ({anchors})) z LEFT JOIN flag_cells f ON f.row = z.row AND f.col = z.col
        LEFT JOIN hub_cells h ON h.row = z.row AND h.col = z.col GROUP BY {by}))"""


def _site_buffer_sql(radius: int, where: str = "") -> str:
    span = f"range(-{radius}, {radius + 1})"
    return (f"SELECT DISTINCT anchor_set, {radius} AS radius, row + dr AS row, col + dc AS col FROM tagged_sites, (SELECT unnest({span}) AS dr), (SELECT unnest({span}) AS dc)"
            f" WHERE row + dr BETWEEN 0 AND {GRID.n_rows - 1} AND col + dc BETWEEN 0 AND {GRID.n_cols - 1} {where}")


COVERAGE = ("anchor_cells:i active_cells_covered:i backbone_cells_covered:i hotspot_cells_covered:i endpoint_cells_covered:i active_share:f backbone_share:f hotspot_share:f "
            "endpoint_share:f exceedance_share:f " + q.RR_SPEC)
q.view("site_coverage", coverage_sql(" UNION ALL ".join(_site_buffer_sql(k) for k in (0, 1, 2)), "anchor_set, radius"))


@staged
def flags_of(i):
    return sites.cell_flags(i.occ, t.hub_cells_of(i))


@staged
def coverage_of(i):
    return sites.anchor_coverage(flags_of(i), t.hub_cells_of(i), sites.site_buffers(tagged_of(i), GRID), ["anchor_set", "radius"])


@query("site_coverage", "anchor_set:s radius:i " + COVERAGE, "SELECT * FROM site_coverage")
def site_coverage(i):
    """C14, J8 (discard)."""
    return coverage_of(i)


_OP = "AND anchor_set = 'operational_sites'"
q.view("figure_sets", f"""SELECT 'Backbone (top 10%)' AS anchor_label, row, col FROM backbone UNION ALL SELECT 'Endpoint exact', row, col FROM hub_cells
  UNION ALL SELECT 'Endpoint +1 cell', row, col FROM ({t.buffer_sql('SELECT row, col FROM hub_cells', 1)}) UNION ALL SELECT 'Station exact', row, col FROM ({_site_buffer_sql(0, _OP)})
  UNION ALL SELECT 'Station +1 cell', row, col FROM ({_site_buffer_sql(1, _OP)}) UNION ALL SELECT 'Station +2 cells', row, col FROM ({_site_buffer_sql(2, _OP)})""")


@query("anchor_summary", "anchor_label:s " + COVERAGE, coverage_sql("SELECT * FROM figure_sets", "anchor_label"))
def anchor_summary(i):
    """C14 (six labelled anchor sets)."""
    return sites.figure_anchors(flags_of(i), t.hub_cells_of(i), tagged_of(i), GRID)


@query("mapped_sites", "anchor_set:s site_name:s platform:s note:s open_time:s lon:f lat:f row:i col:i grid_cell_id:s is_test_site:b is_active:b is_backbone:b is_hotspot:b is_endpoint:b",
       """SELECT s.*, s.row::VARCHAR || '_' || s.col::VARCHAR AS grid_cell_id, f.row IS NOT NULL AS is_active, coalesce(bb, false) AS is_backbone, coalesce(hot, false) AS is_hotspot, coalesce(ep, false) AS is_endpoint
       FROM tagged_sites s LEFT JOIN flag_cells f ON f.row = s.row AND f.col = s.col""")
def mapped_sites(i):
    """C15."""
    return sites.mapped_sites(tagged_of(i), flags_of(i))


# A fifth of the site cells carry no traffic, so they serve as endpoint cells that must be appended.
q.view("far_cells", f"SELECT row, col FROM hub_cells UNION SELECT row + 40, col FROM hub_cells")


@staged
def far_cells_of(i):
    hubs = t.hub_cells_of(i)
    return hubs.unionByName(hubs.withColumn("row", F.col("row") + 40)).distinct()


def _member(name, source):
    return f"EXISTS (SELECT 1 FROM ({source}) m WHERE m.row = z.row AND m.col = z.col) AS {name}"


@query("cell_metrics", "row:i col:i rank:i total_points:i traffic_share:f cumulative_traffic_share:f active_days:i active_hours:i is_backbone_cell:b exceedance_count:i exceedance_share:f cumulative_exceedance_share:f "
       "total_samples:i traffic_rank_pct:f log10_total_points:f is_hotspot_cell:b is_endpoint_cell:b endpoint_buffer1_cell:b station_exact_cell:b station_buffer1_cell:b station_buffer2_cell:b lon:f lat:f",
       f"""SELECT z.*, {_member('is_endpoint_cell', 'SELECT * FROM far_cells')}, {_member('endpoint_buffer1_cell', t.buffer_sql('SELECT * FROM far_cells', 1))}, {_member('station_exact_cell', _site_buffer_sql(0, _OP))},
       {_member('station_buffer1_cell', _site_buffer_sql(1, _OP))}, {_member('station_buffer2_cell', _site_buffer_sql(2, _OP))}, exceedance_count > 0 AS is_hotspot_cell, log10(greatest(total_points, 1)) AS log10_total_points,
       {GRID.min_lon}::DOUBLE + (col + 0.5::DOUBLE)*{GRID.size_m}::DOUBLE/{q.num(GRID.m_lon)} AS lon, {GRID.min_lat}::DOUBLE + (row + 0.5::DOUBLE)*{GRID.size_m}::DOUBLE/111000.0::DOUBLE AS lat FROM (
       SELECT c.row, c.col, row_number() OVER o AS rank, total_points, total_points::DOUBLE/sum(total_points) OVER () AS traffic_share, sum(total_points) OVER (o ROWS UNBOUNDED PRECEDING)::DOUBLE/sum(total_points) OVER () AS cumulative_traffic_share,
         active_days, active_hours, row_number() OVER o <= greatest(1, floor(count(*) OVER ()*0.10::DOUBLE)) AS is_backbone_cell, x AS exceedance_count, x::DOUBLE/sum(x) OVER () AS exceedance_share,
         CASE WHEN x > 0 THEN sum(x) OVER (ORDER BY x DESC, c.row, c.col ROWS UNBOUNDED PRECEDING)::DOUBLE/sum(x) OVER () ELSE 0 END AS cumulative_exceedance_share, s AS total_samples, row_number() OVER o::DOUBLE/count(*) OVER () AS traffic_rank_pct
       FROM cells c JOIN cell_x USING (row, col) WINDOW o AS (ORDER BY total_points DESC, c.row, c.col)
       UNION ALL SELECT row, col, NULL, 0, 0, 1.0, 0, 0, false, 0, 0, 0, 0, NULL FROM far_cells f ANTI JOIN cells c ON f.row = c.row AND f.col = c.col) z""")
def cell_metrics(i):
    """C16, J1, J15, P11, P28."""
    cells = materialize(cells_op.cell_stats(i.points))
    return sites.cell_metrics(cells, i.occ, far_cells_of(i), tagged_of(i), GRID)


@query("hotspot_cells", "exceedance_rank:i row:i col:i exceedance_count:i share:f cumulative_share:f total_samples:i traffic_rank:i is_backbone_cell:b is_endpoint_cell:b is_endpoint_buffer1_cell:b rho_star_reference:f",
       f"""SELECT row, col, exceedance_rank, exceedance_count, share, cumulative_share, total_samples, traffic_rank, is_backbone_cell, rho_star AS rho_star_reference, {_member('is_endpoint_cell', 'SELECT * FROM hub_cells')},
       {_member('is_endpoint_buffer1_cell', t.buffer_sql('SELECT * FROM hub_cells', 1))} FROM (SELECT f.row, f.col, row_number() OVER o AS exceedance_rank, x AS exceedance_count, x::DOUBLE/sum(x) OVER () AS share,
       sum(x) OVER (o ROWS UNBOUNDED PRECEDING)::DOUBLE/sum(x) OVER () AS cumulative_share, s AS total_samples, traffic_rank, bb AS is_backbone_cell, rho_star
       FROM (SELECT *, row_number() OVER (ORDER BY total_points DESC, row, col) AS traffic_rank FROM flag_cells) f, main_break WHERE x > 0 WINDOW o AS (ORDER BY x DESC, f.row, f.col)) z""")
def hotspot_cells(i):
    """C17."""
    hubs = t.hub_cells_of(i)
    return core.hotspot_cells(i.occ, core.rho_star(i.occ), hubs, buffers.buffer_cells(hubs, 1, grid=GRID))


@query("buffer_edge_rules", "edge:s cells:i",
       " UNION ALL ".join(f"SELECT '{e}' AS edge, count(*) AS cells FROM ({t.buffer_sql('SELECT row - (SELECT min(row) FROM cells) AS row, col - (SELECT min(col) FROM cells) AS col FROM cells', 2, e)})"
                          for e in ("clamp", "discard", "unbounded")))
def buffer_edge_rules(i):
    """The three edge rules on cells moved to the grid corner."""
    cells = materialize(i.points.select("row", "col").distinct())
    low = cells.agg(F.min("row").alias("r"), F.min("col").alias("c"))
    moved = materialize(cells.select((F.col("row") - low.select("r").scalar()).alias("row"), (F.col("col") - low.select("c").scalar()).alias("col")))
    out = None
    for edge in ("clamp", "discard", "unbounded"):
        part = buffers.buffer_cells(moved, 2, grid=GRID, edge=edge).agg(F.count(F.lit(1)).alias("cells")).withColumn("edge", F.lit(edge))
        out = part if out is None else out.unionByName(part)
    return out


@query("cell_centroids", "row:i col:i lon:f lat:f",
       f"""SELECT row, col, {GRID.min_lon}::DOUBLE + (col + 0.5::DOUBLE)*{GRID.size_m}::DOUBLE/{q.num(GRID.m_lon)} AS lon, {GRID.min_lat}::DOUBLE + (row + 0.5::DOUBLE)*{GRID.size_m}::DOUBLE/111000.0::DOUBLE AS lat FROM cells""")
def cell_centroids(i):
    """P11."""
    return i.points.select("row", "col").distinct().withColumns({"lon": centroid_lon(F.col("col"), GRID), "lat": centroid_lat(F.col("row"), GRID)})


# --------------------------------------------------------------------- hubs
q.view("hub_areas", "SELECT site_name AS fold, row + dr AS row, col + dc AS col FROM oper_sites, (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-1, 2)) AS dc)")
q.view("hub_folds", "SELECT f.fold, w.* FROM windows w, (SELECT DISTINCT fold FROM hub_areas) f WHERE NOT EXISTS (SELECT 1 FROM hub_areas h WHERE h.fold = f.fold AND h.row = w.row AND h.col = w.col)")
q.view("hub_removed", """SELECT fold, count(DISTINCT (w.row, w.col)) AS removed_active_cells, count(*) AS removed_samples, count(*) FILTER (n_points >= rho_star) AS removed_congested
  FROM windows w JOIN hub_areas h ON h.row = w.row AND h.col = w.col CROSS JOIN main_break GROUP BY fold""")
q.view("hub_summary", f"""SELECT z.*, fold AS site_name, coalesce(removed_active_cells, 0) AS removed_active_cells, coalesce(removed_samples, 0) AS removed_samples, coalesce(removed_congested, 0) AS removed_congested,
  coalesce(removed_congested, 0)::DOUBLE/(SELECT sum(x) FROM cell_x) AS removed_congested_share FROM ({q.summary_sql('SELECT * FROM hub_folds', 'fold')}) z LEFT JOIN hub_removed USING (fold)""")
HUB = "removed_active_cells:i removed_samples:i removed_congested:i removed_congested_share:f "


def hub_folds_of(i):
    return sites.leave_hubs_out(i.occ, inventory_of(i))


@query("leave_one_hub_out", "site_name:s " + HUB + q.SUMMARY_SPEC, "SELECT * FROM hub_summary")
def leave_one_hub_out(i):
    """R16, J8 (unbounded)."""
    return hub_folds_of(i)


q.view("top_hubs", "SELECT fold FROM hub_summary ORDER BY removed_congested_share DESC, removed_samples DESC, fold LIMIT 3")


@query("remove_top_hubs", q.SUMMARY_SPEC, q.summary_sql("SELECT w.* FROM windows w WHERE NOT EXISTS (SELECT 1 FROM hub_areas h WHERE h.fold IN (SELECT fold FROM top_hubs) AND h.row = w.row AND h.col = w.col)"))
def remove_top_hubs(i):
    """R17, W10."""
    areas = sites.hub_cells(inventory_of(i))
    return summarize(i.occ.join(sites.top_hub_cells(hub_folds_of(i), areas), ["row", "col"], "left_anti"))


# --------------------------------------------------------------- monitoring
_BUDGETS = "[0.001::DOUBLE, 0.005::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE]"
q.view("top_budgets", f"""SELECT 'top_traffic_cells' AS strategy, budget_share, count(*) AS budget_cells, sum(x) AS captured_exceedance, sum(x)::DOUBLE/max(tx) AS captured_exceedance_share, sum(total_points)::DOUBLE/max(tp) AS captured_traffic_share,
  sum(x)::DOUBLE/max(tx)/budget_share AS lift_exceedance, sum(total_points)::DOUBLE/max(tp)/budget_share AS lift_traffic FROM (SELECT *, row_number() OVER (ORDER BY total_points DESC, row, col) AS rk, count(*) OVER () AS nn, sum(x) OVER () AS tx,
  sum(total_points) OVER () AS tp FROM flag_cells), (SELECT unnest({_BUDGETS}) AS budget_share) WHERE rk <= greatest(1, floor(nn*budget_share)) GROUP BY budget_share""")
q.view("site_budgets", """SELECT 'station_radius_' || radius::VARCHAR AS strategy, active_share AS budget_share, active_cells_covered AS budget_cells, a AS captured_exceedance, exceedance_share AS captured_exceedance_share,
  NULL::DOUBLE AS captured_traffic_share, CASE WHEN active_share > 0 THEN exceedance_share/active_share END AS lift_exceedance, NULL::DOUBLE AS lift_traffic FROM site_coverage WHERE anchor_set = 'operational_sites'""")


@query("monitoring_payoff", "strategy:s budget_share:f budget_cells:i captured_exceedance:i captured_exceedance_share:f captured_traffic_share:f lift_exceedance:f lift_traffic:f",
       "SELECT * FROM top_budgets UNION ALL SELECT * FROM site_budgets")
def monitoring_payoff(i):
    """W13, C19."""
    return sites.monitoring_payoff(flags_of(i), coverage_of(i))


q.view("mc_ranked", f"SELECT iter, x, row_number() OVER (PARTITION BY iter ORDER BY md5('42|' || iter::VARCHAR || '|' || row::VARCHAR || '|' || col::VARCHAR)) AS rk FROM flag_cells, {r.iters(2000)}")


@query("monitoring_random_baseline", "strategy:s budget_cells:i observed_share:f mean_random_share:f p95_random_share:f observed_over_mean:f4 observed_over_p95:f4",
       """SELECT *, CASE WHEN mean_random_share > 0 THEN observed_share/mean_random_share END AS observed_over_mean, CASE WHEN p95_random_share > 0 THEN observed_share/p95_random_share END AS observed_over_p95 FROM (
       SELECT strategy, budget_cells, observed_share, avg(share) AS mean_random_share, quantile_cont(share, 0.95) AS p95_random_share FROM (
         SELECT strategy, budget_cells, captured_exceedance_share AS observed_share, iter, sum(x)::DOUBLE/(SELECT sum(x) FROM flag_cells) AS share FROM mc_ranked, site_budgets WHERE rk <= budget_cells GROUP BY ALL) GROUP BY ALL)""")
def monitoring_random_baseline(i):
    """R18."""
    flags = flags_of(i)
    budgets = materialize(sites.site_budgets(coverage_of(i)).select("strategy", "budget_cells", F.col("captured_exceedance_share").alias("observed_share")))
    return rs.monitoring_baseline(flags, budgets)


# ----------------------------------------------------------- endpoint heights
q.view("terrain_once", "SELECT median_lat AS lat, median_lon AS lon, ((row*7 + col*3) % 80)::DOUBLE AS terrain_m FROM endpoint_alt WHERE (row + col) % 13 <> 0")
q.view("terrain", "SELECT * FROM terrain_once UNION ALL SELECT lat, lon, terrain_m - 3.5 FROM terrain_once WHERE lat IS NOT NULL AND terrain_m % 5 = 0")
q.view("ep_base", """SELECT e.*, terrain_m, median_altitude - terrain_m AS rel_ground_m FROM endpoint_alt e LEFT JOIN (SELECT printf('%.6f,%.6f', lat, lon) AS key, max(terrain_m) AS terrain_m FROM terrain GROUP BY 1) t
  ON t.key = printf('%.6f,%.6f', median_lat, median_lon)""")
q.view("ep_mid", "SELECT avg(median_lat) AS mid FROM ep_base")
_PLANAR = "sqrt(power((b.lon - e.median_lon)*111320.0::DOUBLE*cos(radians(mid)), 2) + power((b.lat - e.median_lat)*111320.0::DOUBLE, 2))"
q.view("ep_dist", f"SELECT e.row, e.col, e.rel_ground_m, building_height_m AS h, {_PLANAR} AS dist FROM ep_base e, ep_mid, buildings b WHERE building_height_m IS NOT NULL")
q.view("ep_site", f"SELECT e.row, e.col, min({_PLANAR}) AS nearest_station_m FROM ep_base e, ep_mid, oper_sites b GROUP BY 1, 2")
q.view("ep_class", """SELECT *, nearest_station_m <= 150 AS station_adjacent, CASE WHEN rel_ground_m IS NULL THEN 'unknown' WHEN rel_ground_m <= 15 THEN 'ground_like' WHEN best_height_gap <= 20 THEN 'building_compatible' ELSE 'elevated_unresolved' END AS height_class FROM (
  SELECT e.*, nearest_bldg_dist_m, nearest_bldg_height_m, coalesce(bldg_count, 0) AS bldg_count, best_height_gap, best_match_height, best_match_dist, nearest_station_m FROM ep_base e
  JOIN (SELECT row, col, min(dist) AS nearest_bldg_dist_m, arg_min(h, row(dist, h)) AS nearest_bldg_height_m FROM ep_dist GROUP BY 1, 2) n USING (row, col)
  LEFT JOIN (SELECT row, col, count(*) AS bldg_count, min(abs(h - rel_ground_m)) AS best_height_gap, arg_min(h, row(abs(h - rel_ground_m), h, dist)) AS best_match_height,
    arg_min(dist, row(abs(h - rel_ground_m), h, dist)) AS best_match_dist FROM ep_dist WHERE dist <= 150 GROUP BY 1, 2) b USING (row, col) JOIN ep_site USING (row, col))""")


@staged
def endpoint_table(i):
    return trips.endpoint_altitudes(trips.endpoints(t.od_of(i), GRID))


def terrain_of(i, ends):
    """The terrain lookup through its file and reader: cells without a row, and some with an older, lower one beside it."""
    rows = ends.where((F.col("row") + F.col("col")) % 13 != 0).select(F.col("median_lat").alias("lat"), F.col("median_lon").alias("lon"), ((F.col("row") * 7 + F.col("col") * 3) % 80).cast("double").alias("terrain_m"))
    rows = rows.unionByName(rows.where(F.col("lat").isNotNull() & (F.floor(F.col("terrain_m")) % 5 == 0)).withColumn("terrain_m", F.col("terrain_m") - 3.5)).withColumn("source", F.lit("grid"))
    path = table_path(i.spark, "terrain")
    sinks.write_table(rows, path, fmt="csv")
    return tables.read_terrain(i.spark, path)


def buildings_of(i):
    """The building inventory through its file and reader, which drops incomplete rows."""
    path = table_path(i.spark, "buildings")
    sinks.write_table(i.buildings.select("building_height_m", "lon", "lat"), path, fmt="csv")
    return tables.read_buildings(i.spark, path)


def classified_of(i):
    ends = endpoint_table(i)
    return heights.classify(ends, terrain_of(i, ends), buildings_of(i), sites.operational_sites(inventory_of(i)))


@query("endpoint_heights", "row:i col:i terrain_m:f rel_ground_m:f nearest_bldg_dist_m:f4 nearest_bldg_height_m:f bldg_count:i best_height_gap:f best_match_height:f best_match_dist:f4 nearest_station_m:f4 station_adjacent:b height_class:s",
       "SELECT * FROM ep_class")
def endpoint_heights(i):
    """J12, J13, P16, P21, S6, S7."""
    return classified_of(i)


@query("height_class_shares", "scope:s height_class:s cells:i cell_share:f touches:i touch_share:f",
       """SELECT scope, height_class, count(*) AS cells, count(*)::DOUBLE/max(tc) AS cell_share, sum(n) AS touches, sum(n)::DOUBLE/max(tn) AS touch_share FROM (
       SELECT *, count(*) OVER (PARTITION BY scope) AS tc, sum(n) OVER (PARTITION BY scope) AS tn FROM (SELECT unnest(CASE WHEN station_adjacent THEN ['overall', 'station_adjacent'] ELSE ['overall'] END) AS scope, height_class, n FROM ep_class)) GROUP BY 1, 2""")
def height_class_shares(i):
    """A38."""
    return heights.class_shares(classified_of(i))


@query("height_quartiles", "p25_rel_ground_m:f median_rel_ground_m:f p75_rel_ground_m:f median_nearest_station_m:f4",
       """SELECT quantile_cont(rel_ground_m, 0.25) AS p25_rel_ground_m, quantile_cont(rel_ground_m, 0.5) AS median_rel_ground_m, quantile_cont(rel_ground_m, 0.75) AS p75_rel_ground_m, quantile_cont(nearest_station_m, 0.5) AS median_nearest_station_m FROM ep_class""")
def height_quartiles(i):
    """A38."""
    return heights.class_quartiles(classified_of(i))


def _sens(radius, tol):
    gaps = f"SELECT row, col, min(abs(h - rel_ground_m)) AS gap FROM ep_dist WHERE dist <= {radius} GROUP BY 1, 2"
    cls = f"CASE WHEN rel_ground_m IS NULL THEN 'unknown' WHEN rel_ground_m <= 15 THEN 'ground_like' WHEN gap <= {tol} THEN 'building_compatible' ELSE 'elevated_unresolved' END"
    return (f"SELECT {radius} AS search_radius_m, {tol} AS height_tolerance_m, k.class_name, count(z.n)::DOUBLE/(SELECT count(*) FROM ep_base) AS cell_share, coalesce(sum(z.n), 0)::DOUBLE/(SELECT sum(n) FROM ep_base) AS touch_share"
            f" FROM (SELECT unnest(['ground_like', 'building_compatible', 'elevated_unresolved', 'unknown']) AS class_name) k LEFT JOIN (SELECT {cls} AS class_name, n FROM ep_base LEFT JOIN ({gaps}) USING (row, col)) z USING (class_name) GROUP BY k.class_name")


@query("height_sensitivity", "search_radius_m:i height_tolerance_m:i class_name:s cell_share:f touch_share:f", " UNION ALL ".join(_sens(a, b) for a in (100, 150) for b in (15, 20, 25)))
def height_sensitivity(i):
    """C23, J14."""
    ends = endpoint_table(i)
    return heights.sensitivity(heights.with_terrain(ends, terrain_of(i, ends)), buildings_of(i))


# ----------------------------------------------------------------- follow-up
_STEM = "strftime(CASE WHEN k % 50 = 0 THEN timestamp '2024-10-01 00:00:00' ELSE timestamp '2025-10-01 00:00:00' END + to_seconds(k*137), '%Y%m%d-%H%M%S')"
q.view("nav_logs", f"""SELECT 'logs/' || CASE k % 4 WHEN 0 THEN 'A/R' || (k % 3)::VARCHAR || '/' WHEN 1 THEN 'B/R' || (k % 3)::VARCHAR || '/' WHEN 2 THEN 'B-2/R' || (k % 3)::VARCHAR || '/' ELSE '' END || {_STEM} || '.mat' AS path,
  CASE WHEN k % 89 = 0 THEN 0.0::DOUBLE ELSE 22.60::double + 0.05::double*y*y END AS lat, 113.90::double + 0.05::double*x*x*x AS lon, CASE WHEN l_linenumber = 7 AND k % 11 = 0 THEN NULL ELSE (l_linenumber*60 + l_partkey % 60)*1000000::BIGINT END AS logtime,
  0.6::double*least(40.0::double, l_quantity*0.8::double*sqrt((x*x*x + y*y)/2.0::double)) AS vel_x, 0.8::double*least(40.0::double, l_quantity*0.8::double*sqrt((x*x*x + y*y)/2.0::double)) AS vel_y,
  l_extendedprice - 500.0::double*floor(l_extendedprice/500.0::double) AS altitude_agl FROM (SELECT *, l_orderkey AS k, cast(l_partkey % 100 as double)/100.0::double AS x, cast(l_suppkey % 50 as double)/50.0::double AS y
  FROM lineitem)""")
q.view("nav_meta", """SELECT *, source_folder || '__' || route_code || '__' || stem AS flight_id, try_strptime(stem, '%Y%m%d-%H%M%S') AS flight_start_local FROM (
  SELECT *, CASE WHEN len(parts) >= 3 THEN parts[1] ELSE 'root_logs' END AS source_folder, CASE WHEN len(parts) >= 3 THEN parts[2] ELSE 'unassigned' END AS route_code, parts[len(parts)] AS file_name, regexp_replace(parts[len(parts)], '\\.[^.]*$', '') AS stem
  FROM (SELECT *, string_split(replace(path, 'logs/', ''), '/') AS parts FROM nav_logs)) WHERE substr(stem, 1, 4) IN ('2025', '2026')""")
_INSIDE = f"latitude >= {q.num(GRID.min_lat)} AND (latitude - {q.num(GRID.min_lat)}) * {q.num(GRID.m_lat)} / {q.num(float(GRID.size_m))} < {GRID.n_rows} AND longitude >= {q.num(GRID.min_lon)} AND (longitude - {q.num(GRID.min_lon)}) * {q.num(GRID.m_lon)} / {q.num(float(GRID.size_m))} < {GRID.n_cols}"
q.view("nav_points", f"""SELECT *, {_INSIDE} AS is_within_main_grid, {q.row_of('latitude', GRID)} AS row, {q.col_of('longitude', GRID)} AS col, flight_start_local + to_seconds(floor(elapsed_s)::BIGINT) AS datetime FROM (
  SELECT flight_id, source_folder, route_code, file_name, flight_start_local, strftime(flight_start_local, '%Y-%m-%d') AS flight_date_local, logtime, (logtime - min(logtime) OVER (PARTITION BY flight_id))/1e6 AS elapsed_s, lat AS latitude, lon AS longitude,
  sqrt(vel_x*vel_x + vel_y*vel_y) AS ground_speed, altitude_agl FROM nav_meta WHERE lat > 20 AND lat < 25 AND lon > 110 AND lon < 116 AND logtime IS NOT NULL)""")


def nav_points(i):
    return followup.normalize_logs(i.nav_logs, GRID)


@query("flight_log_points", "flight_id:s source_folder:s route_code:s file_name:s flight_date_local:s elapsed_s:f datetime:t longitude:f latitude:f ground_speed:f altitude_agl:f row:i col:i is_within_main_grid:b",
       "SELECT * FROM nav_points")
def flight_log_points(i):
    """S13, S15, P25."""
    return nav_points(i)


_NK = "row(logtime, longitude, latitude, altitude_agl)"
q.view("nav_flights", f"""SELECT flight_id, source_folder, route_code, file_name, flight_date_local, min(flight_start_local) AS flight_start_local, max(datetime) AS flight_end_local, max(elapsed_s) AS duration_s, count(*) AS n_valid_points,
  arg_min(longitude, {_NK}) AS start_lon, arg_min(latitude, {_NK}) AS start_lat, arg_max(longitude, {_NK}) AS end_lon, arg_max(latitude, {_NK}) AS end_lat, arg_min(altitude_agl, {_NK}) AS start_alt_agl, arg_max(altitude_agl, {_NK}) AS end_alt_agl,
  quantile_cont(ground_speed, 0.5) AS median_ground_speed FROM nav_points GROUP BY ALL""")


@query("flight_summary", "flight_id:s flight_date_local:s flight_start_local:t flight_end_local:t duration_s:f n_valid_points:i start_lon:f start_lat:f end_lon:f end_lat:f start_alt_agl:f end_alt_agl:f median_ground_speed:f5",
       "SELECT * FROM nav_flights")
def flight_summary(i):
    """S14."""
    return followup.flight_summary(materialize(nav_points(i)))


@query("flight_date_routes", "flight_date_local:s source_folder:s route_code:s flights:i first_start:t last_end:t",
       "SELECT flight_date_local, source_folder, route_code, count(*) AS flights, min(flight_start_local) AS first_start, max(flight_end_local) AS last_end FROM nav_flights GROUP BY 1, 2, 3")
def flight_date_routes(i):
    """A37."""
    return followup.date_route_summary(followup.flight_summary(materialize(nav_points(i))))


q.view("nav_visits", """SELECT * FROM (SELECT *, lag(row) OVER o AS p_row, lag(col) OVER o AS p_col FROM nav_points WINDOW o AS (PARTITION BY flight_id ORDER BY logtime, longitude, latitude)) WHERE p_row IS NULL OR p_row <> row OR p_col <> col""")


@query("flight_paths", "flight_id:s source_folder:s route_code:s flight_date_local:s seq_index:i row:i col:i lon_center:f lat_center:f",
       f"""SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY logtime, longitude, latitude) AS seq_index, {GRID.min_lon}::DOUBLE + (col + 0.5::DOUBLE)*{GRID.size_m}::DOUBLE/{q.num(GRID.m_lon)} AS lon_center,
       {GRID.min_lat}::DOUBLE + (row + 0.5::DOUBLE)*{GRID.size_m}::DOUBLE/111000.0::DOUBLE AS lat_center FROM nav_visits""")
def flight_paths(i):
    """G22."""
    return followup.flight_paths(nav_points(i), GRID)


# reference sets come from the earlier days
q.view("ref_points", "SELECT * FROM points WHERE day(datetime) < 18")
q.view("ref_windows", "SELECT row, col, window_start, count(*) AS n_points, avg(speed) AS mean_speed FROM ref_points GROUP BY 1, 2, 3")
q.view("ref_backbone", q.top_fraction_sql("SELECT row, col, count(*) AS tp FROM ref_points GROUP BY 1, 2", "tp", "0.10::DOUBLE"))
q.view("ref_hot", f"SELECT DISTINCT row, col FROM ref_windows, ({q.piecewise_sql(q.curve_sql('ref_windows'))}) p WHERE n_points >= p.rho_star")
q.view("ref_moves", """SELECT order_id, least(row(p_row, p_col), row(row, col)) AS a, greatest(row(p_row, p_col), row(row, col)) AS b FROM (SELECT *, lag(row) OVER o AS p_row, lag(col) OVER o AS p_col FROM ref_points
  WINDOW o AS (PARTITION BY order_id ORDER BY datetime, longitude, latitude, speed, altitude)) WHERE p_row IS NOT NULL AND (p_row <> row OR p_col <> col)""")
q.view("ref_skeleton", "SELECT a, b FROM ref_moves GROUP BY a, b HAVING count(DISTINCT order_id) >= 10")
q.view("ref_sites1", _site_buffer_sql(1, _OP))
q.view("nav_ends", """SELECT flight_id, count(*) AS n_sequence_cells, arg_min(row(row, col), row(logtime, longitude, latitude)) AS s, arg_max(row(row, col), row(logtime, longitude, latitude)) AS e FROM nav_visits GROUP BY 1""")


def _at(side, source):
    return f"EXISTS (SELECT 1 FROM {source} m WHERE m.row = {side}[1] AND m.col = {side}[2])::INT"


q.view("nav_metrics", f"""SELECT *, start_in_endpoint_buffer1*end_in_endpoint_buffer1 AS both_in_endpoint_buffer1, start_in_station_buffer1*end_in_station_buffer1 AS both_in_station_buffer1, CASE WHEN n_edges > 0 THEN edge_hits::DOUBLE/n_edges END AS edge_share_on_skeleton,
  CASE WHEN slow_points > 0 THEN slow_points_near_ends::DOUBLE/slow_points END AS slow_share_near_ends, points_near_ends::DOUBLE/n_points AS point_share_near_ends,
  CASE WHEN slow_points > 0 AND points_near_ends > 0 THEN (slow_points_near_ends::DOUBLE/slow_points)/(points_near_ends::DOUBLE/n_points) END AS slow_localization_lift FROM (
  SELECT p.*, n_sequence_cells, n_unique_cells, cell_share_in_backbone, cell_share_in_hotspots, coalesce(n_edges, 0) AS n_edges, coalesce(edge_hits, 0) AS edge_hits, {_at('s', 'hub_cells')} AS start_in_endpoint, {_at('e', 'hub_cells')} AS end_in_endpoint,
   {_at('s', 'hub_buffer1')} AS start_in_endpoint_buffer1, {_at('e', 'hub_buffer1')} AS end_in_endpoint_buffer1, {_at('s', 'ref_sites1')} AS start_in_station_buffer1, {_at('e', 'ref_sites1')} AS end_in_station_buffer1
  FROM (SELECT flight_id, count(*) AS n_points, avg((b.row IS NOT NULL)::INT) AS point_share_in_backbone, count(*) FILTER (ground_speed < 2) AS slow_points, count(*) FILTER (ground_speed < 2 AND own) AS slow_points_near_ends, count(*) FILTER (own) AS points_near_ends
    FROM (SELECT n.*, (abs(row - s[1]) <= 1 AND abs(col - s[2]) <= 1) OR (abs(row - e[1]) <= 1 AND abs(col - e[2]) <= 1) AS own FROM nav_points n JOIN nav_ends USING (flight_id)) x LEFT JOIN ref_backbone b ON b.row = x.row AND b.col = x.col GROUP BY 1) p
  JOIN nav_ends USING (flight_id) JOIN (SELECT flight_id, count(*) AS n_unique_cells, avg((b.row IS NOT NULL)::INT) AS cell_share_in_backbone, avg((h.row IS NOT NULL)::INT) AS cell_share_in_hotspots FROM (SELECT DISTINCT flight_id, row, col FROM nav_visits) v
    LEFT JOIN ref_backbone b ON b.row = v.row AND b.col = v.col LEFT JOIN ref_hot h ON h.row = v.row AND h.col = v.col GROUP BY 1) u USING (flight_id)
  LEFT JOIN (SELECT flight_id, count(*) AS n_edges, count(k.a) AS edge_hits FROM (SELECT flight_id, least(row(p_row, p_col), row(row, col)) AS a, greatest(row(p_row, p_col), row(row, col)) AS b FROM nav_visits WHERE p_row IS NOT NULL) m
    LEFT JOIN ref_skeleton k ON k.a = m.a AND k.b = m.b GROUP BY 1) g USING (flight_id))""")


def nav_metrics(i):
    points = materialize(nav_points(i).where("is_within_main_grid"))
    past = materialize(i.points.where(F.dayofmonth("datetime") < 18).drop("yaw", "vendor"))
    occ = materialize(cells_op.occupancy(cells_op.cell_windows(past, WINDOW)))
    hot = materialize(cells_op.exceedance(occ, core.rho_star(occ)).where(F.col("exceedance_count") > 0).select("row", "col"))
    skeleton = materialize(routes.skeleton(routes.edge_support(transitions(compress_visits(past))), 10))
    hubs = t.hub_cells_of(i)
    site_buffer = sites.site_buffers(tagged_of(i), GRID, (1,)).where(F.col("anchor_set") == "operational_sites").select("row", "col")
    metrics = followup.flight_metrics(points, backbone=materialize(core.backbone_cells(occ)), hotspots=hot, endpoint_cells=hubs,
                                      endpoint_buffer=buffers.buffer_cells(hubs, 1, grid=GRID, edge="clamp"), site_buffer=site_buffer, skeleton_edges=skeleton)
    return points, materialize(metrics)


@query("flight_metrics", "flight_id:s n_points:i n_sequence_cells:i n_unique_cells:i n_edges:i edge_hits:i edge_share_on_skeleton:f point_share_in_backbone:f cell_share_in_backbone:f cell_share_in_hotspots:f start_in_endpoint:i end_in_endpoint:i "
       "start_in_endpoint_buffer1:i end_in_endpoint_buffer1:i start_in_station_buffer1:i end_in_station_buffer1:i both_in_endpoint_buffer1:i both_in_station_buffer1:i slow_points:i slow_points_near_ends:i points_near_ends:i slow_share_near_ends:f "
       "point_share_near_ends:f slow_localization_lift:f", "SELECT * FROM nav_metrics")
def flight_metrics(i):
    """G21."""
    return nav_metrics(i)[1]


@query("flight_archive_summary", "flights:i points:i weighted_edge_share:f median_edge_share:f p25_edge_share:f share_flights_ge_80pct:f point_share_in_backbone:f endpoint_match_share:f both_endpoint_share:f station_match_share:f both_station_share:f "
       "slow_share_near_ends:f point_share_near_ends:f slowing_lift:f",
       """SELECT *, slow_share_near_ends/point_share_near_ends AS slowing_lift FROM (SELECT count(*) AS flights, sum(n_points) AS points, sum(edge_hits)::DOUBLE/sum(n_edges) AS weighted_edge_share, quantile_cont(edge_share_on_skeleton, 0.5) AS median_edge_share,
       quantile_cont(edge_share_on_skeleton, 0.25) AS p25_edge_share, avg(coalesce(edge_share_on_skeleton >= 0.8, false)::INT) AS share_flights_ge_80pct, sum(point_share_in_backbone*n_points)/sum(n_points) AS point_share_in_backbone,
       sum(start_in_endpoint_buffer1 + end_in_endpoint_buffer1)::DOUBLE/(2*count(*)) AS endpoint_match_share, avg(both_in_endpoint_buffer1) AS both_endpoint_share, sum(start_in_station_buffer1 + end_in_station_buffer1)::DOUBLE/(2*count(*)) AS station_match_share,
       avg(both_in_station_buffer1) AS both_station_share, sum(slow_points_near_ends)::DOUBLE/sum(slow_points) AS slow_share_near_ends, sum(points_near_ends)::DOUBLE/sum(n_points) AS point_share_near_ends FROM nav_metrics)""")
def flight_archive_summary(i):
    """G23."""
    return followup.archive_summary(nav_metrics(i)[1])


_RG = """SELECT route_group, count(*) AS flights, sum(edge_hits) AS hits, sum(n_edges) AS edges, CASE WHEN sum(n_edges) > 0 THEN sum(edge_hits)::DOUBLE/sum(n_edges) END AS weighted_edge_share, quantile_cont(edge_share_on_skeleton, 0.5) AS median_edge_share
  FROM (SELECT m.*, {group} AS route_group FROM nav_metrics m JOIN nav_flights USING (flight_id)) GROUP BY 1"""
_RG_SPEC = "route_group:s flights:i hits:i edges:i weighted_edge_share:f median_edge_share:f"


@query("flight_route_groups", _RG_SPEC, _RG.format(group="flight_date_local || ' | ' || source_folder || ' | ' || route_code"))
def flight_route_groups(i):
    """A37, P25 (route group)."""
    points, metrics = nav_metrics(i)
    return followup.route_group_summary(metrics, followup.flight_keys(points), followup.route_group())


@query("flight_years", _RG_SPEC, _RG.format(group="substr(flight_date_local, 1, 4)"))
def flight_years(i):
    """A37, P25 (year)."""
    points, metrics = nav_metrics(i)
    return followup.route_group_summary(metrics, followup.flight_keys(points), followup.flight_year())
