"""Registered queries: cells, curves, critical density, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import sql as q
from airgrid.catalog.inputs import FINE_WINDOW, GRID, WINDOW
from airgrid.catalog.registry import query
from airgrid.functions.time import date_hour
from airgrid.operators import breakpoints as bp
from airgrid.operators import cells as cells_op
from airgrid.operators import curves
from airgrid.operators.ranking import gini, top_fraction
from airgrid.plans import core
from airgrid.spec import MAX_SPLIT_INDEX

PIECEWISE = ("rho_star:f speed_free:f speed_congested:f speed_drop_percent:f objective:f n_bins:i "
             "slope_left:f slope_right:f speed_before:f speed_after:f jump_percent:f")


@query("critical_density", PIECEWISE, "SELECT * FROM main_break")
def critical_density(i):
    """Two-segment breakpoint of the unit-bin curve."""
    return core.critical_density(i.occ)


@query("breakpoint_scan", "density_center:f split:i valid:b rss:f slope_left:f slope_right:f",
       f"SELECT * FROM ({q.scan_sql('SELECT * FROM curve')})")
def breakpoint_scan(i):
    return bp.split_scan(curves.curve_from_occupancy(i.occ))


@query("breakpoint_weighted", PIECEWISE, q.piecewise_sql("SELECT * FROM curve", weight="sample_count"))
def breakpoint_weighted(i):
    """B2: count-weighted fit and objective."""
    return bp.piecewise(curves.curve_from_occupancy(i.occ), weight="sample_count")


@query("breakpoint_split_limit", PIECEWISE, q.piecewise_sql("SELECT * FROM curve", max_split=MAX_SPLIT_INDEX))
def breakpoint_split_limit(i):
    """B1 with the scan ended before bin 50."""
    return bp.piecewise(curves.curve_from_occupancy(i.occ), max_split=MAX_SPLIT_INDEX)


_SPECS = [("main_equal_weight_bins", 1, 10, False), ("count_weighted_bins", 1, 10, True),
          ("equal_weight_bins_min50", 1, 50, False), ("equal_weight_bins_width2", 2, 20, False)]
q.view("spec_curves", " UNION ALL ".join(
    f"SELECT '{n}' AS spec, {'sample_count' if wt else '1'} AS wt, * FROM ({q.curve_sql('windows', width=w, min_samples=m)})"
    for n, w, m, wt in _SPECS))


@query("breakpoint_specifications", "spec:s " + PIECEWISE, q.piecewise_sql("SELECT *  FROM spec_curves", by="spec", weight="wt")
       .replace("density_center, speed_mean, sample_count,", "density_center, speed_mean, sample_count, wt,"))
def breakpoint_specifications(i):
    """Bin width, minimum samples and weighting variants in one plan."""
    return core_specifications(i.occ)


def core_specifications(occ):
    parts = [curves.curve_from_occupancy(occ, bin_width=w, min_samples=m).withColumns(
        {"spec": F.lit(n), "wt": F.col("sample_count") if wt else F.lit(1)}) for n, w, m, wt in _SPECS]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return bp.piecewise(union, ["spec"], weight="wt")


q.view("grad1", """SELECT *, row_number() OVER o - 1 AS gi, count(*) OVER () AS gn,
  CASE WHEN lag(speed_mean) OVER o IS NULL THEN (lead(speed_mean) OVER o - speed_mean)/(lead(density_center) OVER o - density_center)
   WHEN lead(speed_mean) OVER o IS NULL THEN (speed_mean - lag(speed_mean) OVER o)/(density_center - lag(density_center) OVER o)
   ELSE (power(density_center - lag(density_center) OVER o,2)*lead(speed_mean) OVER o
     + (power(lead(density_center) OVER o - density_center,2) - power(density_center - lag(density_center) OVER o,2))*speed_mean
     - power(lead(density_center) OVER o - density_center,2)*lag(speed_mean) OVER o)
     / ((lead(density_center) OVER o - density_center)*(density_center - lag(density_center) OVER o)*(lead(density_center) OVER o - lag(density_center) OVER o)) END AS d1
  FROM curve WINDOW o AS (ORDER BY density_center)""")
q.view("inflection_row", """SELECT density_center AS rho_star, d2 AS curvature, sb AS speed_before, sa AS speed_after,
   CASE WHEN sb > 0 THEN (sb-sa)/sb*100 END AS jump_percent FROM (
  SELECT *, coalesce(lag(speed_mean) OVER o, speed_mean) AS sb, coalesce(lead(speed_mean) OVER o, speed_mean) AS sa,
  CASE WHEN lag(d1) OVER o IS NULL THEN (lead(d1) OVER o - d1)/(lead(density_center) OVER o - density_center)
   WHEN lead(d1) OVER o IS NULL THEN (d1 - lag(d1) OVER o)/(density_center - lag(density_center) OVER o)
   ELSE (power(density_center - lag(density_center) OVER o,2)*lead(d1) OVER o
     + (power(lead(density_center) OVER o - density_center,2) - power(density_center - lag(density_center) OVER o,2))*d1
     - power(lead(density_center) OVER o - density_center,2)*lag(d1) OVER o)
     / ((lead(density_center) OVER o - density_center)*(density_center - lag(density_center) OVER o)*(lead(density_center) OVER o - lag(density_center) OVER o)) END AS d2
  FROM grad1 WINDOW o AS (ORDER BY density_center))
  WHERE gi < CASE WHEN floor(gn*2/3) < 5 THEN gn ELSE floor(gn*2/3) END AND density_center > 0
  ORDER BY d2 DESC, gi LIMIT 1""")


@query("breakpoint_inflection", "rho_star:f curvature:f speed_before:f speed_after:f jump_percent:f",
       "SELECT * FROM inflection_row")
def breakpoint_inflection(i):
    """B5."""
    return bp.inflection(curves.curve_from_occupancy(i.occ))


@query("breakpoint_consensus", "consensus_rho_star:f n_estimates:i min_estimate:f max_estimate:f",
       """SELECT coalesce((SELECT rho_star FROM main_break), (SELECT rho_star FROM inflection_row)) AS consensus_rho_star,
       2 AS n_estimates, least((SELECT rho_star FROM main_break), (SELECT rho_star FROM inflection_row)) AS min_estimate,
       greatest((SELECT rho_star FROM main_break), (SELECT rho_star FROM inflection_row)) AS max_estimate""")
def breakpoint_consensus(i):
    """B6."""
    curve = curves.curve_from_occupancy(i.occ)
    return bp.consensus(bp.piecewise(curve, fallback=False), bp.inflection(curve))


@query("regime_metrics", "free_bins:i free_density_min:f free_density_max:f free_speed_mean:f free_speed_std:f free_slope:f "
       "congested_bins:i congested_density_min:f congested_density_max:f congested_speed_mean:f congested_speed_std:f "
       "congested_slope:f drop_at_rho_percent:f",
       """SELECT count(*) FILTER (f) AS free_bins, min(x) FILTER (f) AS free_density_min, max(x) FILTER (f) AS free_density_max,
       avg(y) FILTER (f) AS free_speed_mean, stddev_samp(y) FILTER (f) AS free_speed_std,
       CASE WHEN count(*) FILTER (f) >= 3 THEN regr_slope(y, x) FILTER (f) ELSE 0.0 END AS free_slope,
       count(*) FILTER (NOT f) AS congested_bins, min(x) FILTER (NOT f) AS congested_density_min, max(x) FILTER (NOT f) AS congested_density_max,
       avg(y) FILTER (NOT f) AS congested_speed_mean, stddev_samp(y) FILTER (NOT f) AS congested_speed_std,
       CASE WHEN count(*) FILTER (NOT f) >= 3 THEN regr_slope(y, x) FILTER (NOT f) ELSE 0.0 END AS congested_slope,
       coalesce((arg_max(y, x) FILTER (f AND x >= rho-1) - arg_min(y, x) FILTER (NOT f AND x <= rho+1))
         / arg_max(y, x) FILTER (f AND x >= rho-1) * 100, 0.0) AS drop_at_rho_percent
       FROM (SELECT density_center AS x, speed_mean AS y, rho_star AS rho, density_center < rho_star AS f FROM curve, main_break)""")
def regime_metrics(i):
    """A21."""
    return bp.regime_metrics(curves.curve_from_occupancy(i.occ), core.rho_star(i.occ))


@query("congestion_metrics", "correlation:f n_samples:i n_congested:i congestion_share_percent:f",
       """SELECT corr(n_points, mean_speed) AS correlation, count(*) AS n_samples, count(*) FILTER (n_points >= rho_star) AS n_congested,
       avg((n_points >= rho_star)::INT)*100 AS congestion_share_percent FROM windows, main_break""")
def congestion_metrics(i):
    """A19 (coefficient), A20."""
    return core.congestion_metrics(i.occ, i.windows, core.rho_star(i.occ))


# p of r with n pairs: incomplete beta at 1 - r^2 as an integral over u = (1 - r^2) exp(-v^2 / a), by Simpson's rule
@query("congestion_correlation_p", "correlation:f p_value:f n_samples:i",
       """SELECT r AS correlation, n AS n_samples, exp(a * ln(x) - lgamma(a) - lgamma(0.5::DOUBLE) + lgamma(a + 0.5::DOUBLE)) / a * sum(w * 2 * v * exp(-v * v) / sqrt(1 - x * exp(-v * v / a))) AS p_value FROM (
       SELECT *, (n - 2) / 2.0::DOUBLE AS a, 1 - r * r AS x FROM (SELECT corr(n_points::DOUBLE, mean_speed) AS r, count(*) AS n FROM windows WHERE n_points > 0 AND mean_speed IS NOT NULL)),
       (SELECT k * 0.001::DOUBLE AS v, CASE WHEN k IN (0, 7000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * 0.001::DOUBLE / 3 AS w FROM (SELECT unnest(range(0, 7001)) AS k)) GROUP BY r, n, a, x""")
def congestion_correlation_p(i):
    """P-value from the t distribution, as an expression of the one result row."""
    return core.congestion_metrics(i.occ, i.windows, core.rho_star(i.occ))


@query("equal_width_curve", "bin:i density:f speed:f position:i",
       """SELECT *, row_number() OVER (ORDER BY bin) - 1 AS position FROM (
         SELECT greatest(0, ceil((n_points - lo)/((hi-lo)/100.0::DOUBLE)) - 1)::INT AS bin, avg(n_points) AS density, avg(mean_speed) AS speed
         FROM windows, (SELECT min(n_points) AS lo, max(n_points) AS hi FROM windows) GROUP BY 1)""")
def equal_width_curve(i):
    """B8."""
    return curves.equal_width_curve(i.windows)


@query("window_drop_breakpoint", "breakpoint:f",
       """SELECT coalesce((SELECT density_center FROM (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER () AS n,
          avg(speed_mean) OVER (ORDER BY density_center ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
          avg(speed_mean) OVER (ORDER BY density_center ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM curve WINDOW o AS (ORDER BY density_center))
         WHERE i >= 5 AND i < n - 5 ORDER BY round(b - a, 9) DESC, i LIMIT 1),
         (SELECT density_center FROM (SELECT *, row_number() OVER (ORDER BY density_center) - 1 AS i, count(*) OVER () AS n FROM curve) WHERE i = n//2)) AS breakpoint""")
def window_drop_breakpoint(i):
    """W14."""
    return bp.window_drop(curves.curve_from_occupancy(i.occ), order="density_center", x="density_center", y="speed_mean")


@query("density_diagram", "density_min:f density_max:f density_center:f sample_count:i density_mean:f speed_mean:f speed_std:f regime:s rho_star:f",
       """SELECT n_points::DOUBLE AS density_min, n_points + 1.0 AS density_max, n_points + 0.5 AS density_center, count(*) AS sample_count,
       avg(n_points) AS density_mean, avg(mean_speed) AS speed_mean, stddev_samp(mean_speed) AS speed_std,
       CASE WHEN n_points + 0.5 >= max(rho_star) THEN 'at_or_above_rho_star' ELSE 'below_rho_star' END AS regime, max(rho_star) AS rho_star
       FROM windows, main_break WHERE mean_speed > 0 GROUP BY n_points HAVING count(*) >= 10""")
def density_diagram(i):
    """A7, P23 (regime label), C17 (binned table)."""
    return curves.with_regime(curves.diagram(i.windows), core.rho_star(i.occ))


CELL_SPEC = ("row:i col:i total_points:i avg_speed:f std_speed:f avg_altitude:f std_altitude:f first_seen:t last_seen:t "
             "active_hours:i active_days:i")


@query("cell_stats", CELL_SPEC, "SELECT * FROM fine_cells")
def cell_stats(i):
    """A3, P10."""
    return cells_op.cell_stats(i.fine_points)


@query("cell_window_stats", "row:i col:i window_start:t n_points:i mean_speed:f std_speed:f min_speed:f max_speed:f "
       "mean_altitude:f hour:i day_of_week:i is_weekend:b",
       """SELECT *, hour(window_start) AS hour, (isodow(window_start)-1) AS day_of_week, isodow(window_start) >= 6 AS is_weekend
       FROM fine_windows""")
def cell_window_stats(i):
    """A4, P12."""
    return i.fine_windows


@query("cell_window_flights", "row:i col:i window_start:t n_unique:i mean_speed:f",
       """SELECT row, col, window_start, count(DISTINCT order_id) AS n_unique, avg(speed) AS mean_speed
       FROM fine_points GROUP BY row, col, window_start""")
def cell_window_flights(i):
    """A5."""
    return cells_op.flight_windows(i.fine_points, FINE_WINDOW)


@query("cell_windows_without_vendor", "row:i col:i window_start:t n_points:i mean_speed:f date:s date_hour:s",
       """SELECT row, col, window_start, count(*) AS n_points, avg(speed) AS mean_speed, window_start::date AS date,
       strftime(window_start, '%Y-%m-%d-%H') AS date_hour FROM points WHERE vendor <> 'SF' GROUP BY row, col, window_start""")
def cell_windows_without_vendor(i):
    """A6."""
    agg = cells_op.cell_windows(i.points.where(F.col("vendor") != "SF"), WINDOW)
    return agg.withColumns({"date": F.to_date("window_start"), "date_hour": date_hour(F.col("window_start"))})


@query("ranked_cells", "rank:i row:i col:i total_points:i share:f cumulative_share:f active_days:i active_hours:i is_backbone_cell:b",
       """SELECT *, row_number() OVER o AS rank, total_points::DOUBLE/sum(total_points) OVER () AS share,
       sum(total_points) OVER (ORDER BY total_points DESC, row, col ROWS UNBOUNDED PRECEDING)::DOUBLE/sum(total_points) OVER () AS cumulative_share,
       row_number() OVER o <= greatest(1, floor(count(*) OVER () * 0.10::DOUBLE)) AS is_backbone_cell FROM fine_cells
       WINDOW o AS (ORDER BY total_points DESC, row, col)""")
def ranked_cells(i):
    """W1, W2, C17."""
    return core.ranked_cells(cells_op.cell_stats(i.fine_points))


@query("backbone_cells", "row:i col:i", "SELECT row, col FROM backbone")
def backbone(i):
    """W3."""
    return core.backbone_cells(i.occ)


@query("backbone_top5_top20", "share:f row:i col:i",
       f"""SELECT 0.05 AS share, row, col FROM ({q.top_fraction_sql('SELECT * FROM fine_cells', 'total_points', '0.05::DOUBLE')})
       UNION ALL SELECT 0.20, row, col FROM ({q.top_fraction_sql('SELECT * FROM fine_cells', 'total_points', '0.20::DOUBLE')})""")
def backbone_top5_top20(i):
    """W3 at other fractions, ties cut by cell."""
    cells = cells_op.cell_stats(i.fine_points).select("row", "col", "total_points")
    parts = [top_fraction(cells, "total_points", f).withColumn("share", F.lit(f)) for f in (0.05, 0.20)]
    return parts[0].unionByName(parts[1])


@query("top_fraction_shares", "s_0_5pct:f s_1pct:f s_10pct:f",
       "SELECT " + ", ".join(f"""(sum(total_points) FILTER (rk <= greatest(1, floor(nn*{f}::DOUBLE))))::DOUBLE/sum(total_points) AS {n}"""
                             for n, f in (("s_0_5pct", 0.005), ("s_1pct", 0.01), ("s_10pct", 0.10))) +
       " FROM (SELECT *, row_number() OVER (ORDER BY total_points DESC, row, col) AS rk, count(*) OVER () AS nn FROM fine_cells)")
def top_fraction_shares(i):
    """W4."""
    return core.top_shares(cells_op.cell_stats(i.fine_points), "total_points",
                           {"s_0_5pct": 0.005, "s_1pct": 0.01, "s_10pct": 0.10})


def _lorenz_sql(direction):
    return f"""SELECT row, col, row_number() OVER o AS rank, row_number() OVER o * 100.0::DOUBLE / count(*) OVER () AS cell_percent,
      sum(total_points) OVER (o ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / sum(total_points) OVER () AS measure_percent
      FROM cells WINDOW o AS (ORDER BY total_points {direction}, row, col)"""


@query("lorenz_curve", "row:i col:i rank:i cell_percent:f measure_percent:f", _lorenz_sql("ASC"))
def lorenz_curve(i):
    """W8, ascending."""
    return core.lorenz_curve(cells_op.traffic(i.occ), "total_points")


@query("concentration_curve", "row:i col:i rank:i cell_percent:f measure_percent:f", _lorenz_sql("DESC"))
def concentration_curve(i):
    """W8, descending."""
    return core.lorenz_curve(cells_op.traffic(i.occ), "total_points", descending=True)


@query("concentration", "active_cells:i total_points:i gini:f top_1pct_share:f top_10pct_share:f",
       """SELECT max(nn) AS active_cells, sum(total_points) AS total_points,
       2.0*sum(up*total_points)/(max(nn)*sum(total_points)::DOUBLE) - (max(nn)+1.0)/max(nn)::DOUBLE AS gini,
       (sum(total_points) FILTER (rk <= greatest(1, floor(nn*0.01::DOUBLE))))::DOUBLE/sum(total_points) AS top_1pct_share,
       (sum(total_points) FILTER (rk <= greatest(1, floor(nn*0.10::DOUBLE))))::DOUBLE/sum(total_points) AS top_10pct_share
       FROM (SELECT *, row_number() OVER (ORDER BY total_points DESC, row, col) AS rk, row_number() OVER (ORDER BY total_points) AS up,
         count(*) OVER () AS nn FROM fine_cells)""")
def concentration(i):
    """A35, C17 metadata."""
    return core.concentration(cells_op.cell_stats(i.fine_points))


@query("grid_summary", "cells:i points:i mean_points_per_cell:f max_points_per_cell:i top10_share_percent:f grid_cells:i cell_windows:i "
       "mean_density:f max_density:i mean_speed:f time_windows:i",
       f"""SELECT (SELECT count(*) FROM fine_cells) AS cells, (SELECT sum(total_points) FROM fine_cells) AS points,
       (SELECT avg(total_points) FROM fine_cells) AS mean_points_per_cell, (SELECT max(total_points) FROM fine_cells) AS max_points_per_cell,
       (SELECT sum(total_points) FILTER (rk <= greatest(1, floor(nn*0.10::DOUBLE)))::DOUBLE/sum(total_points)*100 FROM
         (SELECT *, row_number() OVER (ORDER BY total_points DESC, row, col) AS rk, count(*) OVER () AS nn FROM fine_cells)) AS top10_share_percent,
       {q.FINE_GRID.total_cells} AS grid_cells, count(*) AS cell_windows, avg(n_points) AS mean_density, max(n_points) AS max_density,
       avg(mean_speed) AS mean_speed, count(DISTINCT window_start) AS time_windows FROM fine_windows""")
def grid_summary(i):
    """S11, P9 (grid dimensions)."""
    return core.grid_summary(cells_op.cell_stats(i.fine_points), i.fine_windows, q.FINE_GRID)


@query("cell_exceedance", "row:i col:i exceedance_count:i total_samples:i",
       """SELECT row, col, count(*) FILTER (n_points >= rho_star) AS exceedance_count, count(*) AS total_samples
       FROM windows, main_break GROUP BY row, col""")
def cell_exceedance(i):
    """A14."""
    return cells_op.exceedance(i.occ, core.rho_star(i.occ))


@query("support_ratio", "active_cells:i total_cells:i ratio_percent:f",
       f"""SELECT count(*) AS active_cells, {GRID.total_cells} AS total_cells, count(*)*100.0::DOUBLE/{GRID.total_cells} AS ratio_percent FROM cells""")
def support_ratio(i):
    """C4."""
    n = F.count(F.lit(1))
    return cells_op.traffic(i.occ).agg(n.alias("active_cells"), F.lit(GRID.total_cells).alias("total_cells"),
                                       (n / F.lit(GRID.total_cells) * 100).alias("ratio_percent"))
