"""Registered queries: subset summaries, folds, bootstraps, null models."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import sql as q
from airgrid.catalog import trips as t
from airgrid.catalog.inputs import GRID, WINDOW
from airgrid.catalog.registry import query
from airgrid.functions.risk import fisher_p
from airgrid.operators import buffers, cells as cells_op
from airgrid.operators.sequences import TIME_ORDER
from airgrid.plans import core, resampling as rs, robustness as rb
from airgrid.plans.summary import collection_summary, summarize
from airgrid.session import materialize
from airgrid.spec import GridSpec

S = q.SUMMARY_SPEC
q.view("unique_break", q.piecewise_sql(q.curve_sql("flight_cw", density="n_unique", center="mean")))
q.view("main_summary", q.summary_sql("SELECT * FROM windows"))
q.view("fixed_rows", """SELECT w.*, k.row IS NOT NULL AS exposed, n_points >= rho_star AS outcome, rho_star,
  strftime(window_start, '%Y-%m-%d-%H') AS block FROM windows w CROSS JOIN main_break LEFT JOIN backbone k ON w.row = k.row AND w.col = k.col""")


def _log_choose(n: str, k: str) -> str:
    return f"(lgamma(({n}+1)::DOUBLE) - lgamma(({k}+1)::DOUBLE) - lgamma((({n})-({k})+1)::DOUBLE))"


_LOG_P = f"{_log_choose('a+c', '{x}')} + {_log_choose('b+d', 'a+b-({x})')} - {_log_choose('a+b+c+d', 'a+b')}"


def fisher_sql(name: str, tables: str) -> str:
    """Two-sided Fisher p of each row (name, a, b, c, d)."""
    return f"""SELECT {name}, a, b, c, d, least(1.0, sum(exp(lp)) FILTER (lp <= lobs + 1e-7)) AS fisher_p FROM (SELECT *, {_LOG_P.format(x='x')} AS lp, {_LOG_P.format(x='a')} AS lobs FROM (
       SELECT {name}, a, b, c, d, unnest(range(greatest(0, a-d), least(a+c, a+b)+1)) AS x FROM (SELECT {name}, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d FROM ({tables})))) GROUP BY {name}, a, b, c, d"""


def with_fisher(summary: str, key: str) -> str:
    """A summary's rows with the Fisher p of their 2x2 tables."""
    return f"SELECT z.*, fisher_p FROM ({summary}) z JOIN ({fisher_sql('k', f'SELECT {key} AS k, a, b, c, d FROM ({summary})')}) f ON f.k = {key.replace('fold', 'z.fold')}"


@query("subset_summary", S + " fisher_p:f", with_fisher("SELECT * FROM main_summary", "1"))
def subset_summary(i):
    """Everything re-estimated."""
    return summarize(i.occ)


@query("subset_summary_fixed", S + " fisher_p:f", with_fisher(q.summary_sql("SELECT * FROM windows", backbone="SELECT * FROM backbone", rho="(SELECT rho_star FROM main_break)"), "1"))
def subset_summary_fixed(i):
    """C1 with given backbone and critical density."""
    return summarize(i.occ, backbone=core.backbone_cells(i.occ), rho=core.rho_star(i.occ))


q.view("halves", """SELECT d, CASE WHEN dense_rank() OVER (ORDER BY d) <= floor((SELECT count(DISTINCT window_start::date) FROM windows)/2) THEN 'first' ELSE 'second' END AS half
  FROM (SELECT DISTINCT window_start::date AS d FROM windows)""")
q.view("half_windows", "SELECT w.*, half FROM windows w JOIN halves ON window_start::date = d")
q.view("half_backbone", q.top_fraction_sql("SELECT half, row, col, sum(n_points) AS tp FROM half_windows GROUP BY ALL", "tp", "0.10::DOUBLE", "half"))


@query("chronological_holdout", "split:s test_days:i backbone_cells_train:i " + q.RR_SPEC,
       f"""SELECT CASE WHEN half = 'second' THEN 'forward' ELSE 'reverse' END AS split, (SELECT count(*) FROM halves h WHERE h.half = z.half) AS test_days,
       (SELECT count(*) FROM half_backbone h WHERE h.half <> z.half) AS backbone_cells_train, {q.rr_columns()} FROM (
       SELECT w.half, {q.ABCD} FROM (SELECT w.*, n_points >= rho_star AS outcome, k.row IS NOT NULL AS exposed FROM half_windows w CROSS JOIN main_break
         LEFT JOIN half_backbone k ON w.row = k.row AND w.col = k.col AND w.half <> k.half) w GROUP BY w.half) z""")
def chronological_holdout(i):
    """R1."""
    return rb.chronological_holdout(i.windows)


@query("unique_flight_occupancy", "samples:i rho_star:f correlation:f congestion_share_percent:f speed_free:f speed_congested:f speed_drop_percent:f " + q.RR_SPEC,
       f"""SELECT {q.rr_columns()}, a+b+c+d AS samples, (a+c)*100.0::DOUBLE/(a+b+c+d) AS congestion_share_percent, p.rho_star, p.speed_free, p.speed_congested, p.speed_drop_percent,
       (SELECT corr(n_unique, mean_speed) FROM flight_cw) AS correlation FROM (SELECT {q.ABCD} FROM (SELECT n_unique >= rho_star AS outcome, k.row IS NOT NULL AS exposed
         FROM flight_cw w CROSS JOIN unique_break LEFT JOIN backbone k ON w.row = k.row AND w.col = k.col)), unique_break p""")
def unique_flight_occupancy(i):
    """C2."""
    return rb.unique_flight_occupancy(cells_op.flight_windows(i.points, WINDOW), core.backbone_cells(i.occ))


q.view("median_n", "SELECT quantile_cont(n_points, 0.5) AS m FROM windows")
q.view("interface_windows", "SELECT w.*, (mean_speed < 2.0 AND n_points > m) AS like_ FROM windows w, median_n")
q.view("interface_cells", "SELECT DISTINCT row, col FROM interface_windows WHERE like_")
q.view("masked", """SELECT w.*, k.row IS NOT NULL AS in_cell FROM interface_windows w LEFT JOIN interface_cells k ON w.row = k.row AND w.col = k.col""")


@query("terminal_zone_exclusion", "terminal_cells:i samples_after_exclusion:i exclusion_ratio:f rho_star_excluded:f rho_star_original:f",
       f"""SELECT (SELECT count(*) FROM interface_cells) AS terminal_cells, (SELECT count(*) FROM masked WHERE NOT in_cell) AS samples_after_exclusion,
       1 - (SELECT count(*) FROM masked WHERE NOT in_cell)::DOUBLE/(SELECT count(*) FROM masked) AS exclusion_ratio,
       (SELECT rho_star FROM ({q.piecewise_sql(q.curve_sql("(SELECT * FROM masked WHERE NOT in_cell)"))})) AS rho_star_excluded, (SELECT rho_star FROM main_break) AS rho_star_original""")
def terminal_zone_exclusion(i):
    """C3."""
    return rb.terminal_zone_exclusion(i.windows)


q.view("cell_x", "SELECT row, col, count(*) FILTER (n_points >= rho_star) AS x, count(*) AS s FROM windows, main_break GROUP BY row, col")
q.view("cell_x_flags", """SELECT c.*, b.row IS NOT NULL AS bb, f.row IS NOT NULL AS itf, row_number() OVER (ORDER BY x DESC, c.row, c.col) AS rk, count(*) OVER () AS nn
  FROM cell_x c LEFT JOIN backbone b ON c.row = b.row AND c.col = b.col LEFT JOIN interface_cells f ON c.row = f.row AND c.col = f.col""")


@query("hotspot_localization", "hotspot_cells:i hotspot_share_active_cells:f hotspot_share_full_grid:f top_0_5pct_share:f top_1pct_share:f congested_in_backbone_share:f "
       "interface_cells:i interface_share_active_cells:f interface_in_backbone_share:f congested_in_interface_share:f congested_in_overlap_share:f",
       f"""SELECT count(*) FILTER (x > 0) AS hotspot_cells, count(*) FILTER (x > 0)::DOUBLE/count(*) AS hotspot_share_active_cells,
       count(*) FILTER (x > 0)::DOUBLE/{GRID.total_cells} AS hotspot_share_full_grid, sum(x) FILTER (rk <= greatest(1, floor(nn*0.005::DOUBLE)))::DOUBLE/sum(x) AS top_0_5pct_share,
       sum(x) FILTER (rk <= greatest(1, floor(nn*0.01::DOUBLE)))::DOUBLE/sum(x) AS top_1pct_share, coalesce(sum(x) FILTER (bb), 0)::DOUBLE/sum(x) AS congested_in_backbone_share,
       count(*) FILTER (itf) AS interface_cells, count(*) FILTER (itf)::DOUBLE/count(*) AS interface_share_active_cells,
       CASE WHEN count(*) FILTER (itf) > 0 THEN count(*) FILTER (itf AND bb)::DOUBLE/count(*) FILTER (itf) END AS interface_in_backbone_share,
       coalesce(sum(x) FILTER (itf), 0)::DOUBLE/sum(x) AS congested_in_interface_share, coalesce(sum(x) FILTER (itf AND bb), 0)::DOUBLE/sum(x) AS congested_in_overlap_share FROM cell_x_flags""")
def hotspot_localization(i):
    """C5."""
    return rb.hotspot_localization(i.windows, GRID)


q.view("hub_counts", "SELECT row, col, sum(endpoint_count) AS endpoint_count FROM endpoint_cells WHERE (row, col) IN (SELECT row, col FROM hub_cells) GROUP BY row, col")


def hub_counts(i):
    return t.endpoint_cells_of(i).join(t.hub_cells_of(i), ["row", "col"], "left_semi")


def _in(name, cells):
    return f"(SELECT DISTINCT row, col FROM ({cells})) {name} ON c.row = {name}.row AND c.col = {name}.col"


@query("endpoint_anchoring", "active_cells:i endpoint_cells:i endpoint_share_active_cells:f endpoint_backbone_overlap:f hotspots_in_endpoints:i hotspot_overlap_share:f "
       "congested_in_endpoint_share:f top_endpoint_cells:i congested_in_top_endpoint_share:f congested_within_1_share:f congested_within_2_share:f",
       f"""SELECT count(*) AS active_cells, (SELECT count(*) FROM hub_counts) AS endpoint_cells, (SELECT count(*) FROM hub_counts)::DOUBLE/count(*) AS endpoint_share_active_cells,
       (SELECT avg((b.row IS NOT NULL)::INT) FROM hub_counts c LEFT JOIN {_in('b', 'SELECT * FROM backbone')}) AS endpoint_backbone_overlap,
       count(*) FILTER (x > 0 AND e.row IS NOT NULL) AS hotspots_in_endpoints, count(*) FILTER (x > 0 AND e.row IS NOT NULL)::DOUBLE/count(*) FILTER (x > 0) AS hotspot_overlap_share,
       coalesce(sum(x) FILTER (e.row IS NOT NULL), 0)::DOUBLE/sum(x) AS congested_in_endpoint_share, (SELECT count(*) FROM ({q.top_fraction_sql('SELECT * FROM hub_counts', 'endpoint_count', '0.10::DOUBLE')})) AS top_endpoint_cells,
       coalesce(sum(x) FILTER (tp.row IS NOT NULL), 0)::DOUBLE/sum(x) AS congested_in_top_endpoint_share, coalesce(sum(x) FILTER (b1.row IS NOT NULL), 0)::DOUBLE/sum(x) AS congested_within_1_share,
       coalesce(sum(x) FILTER (b2.row IS NOT NULL), 0)::DOUBLE/sum(x) AS congested_within_2_share FROM cell_x c
       LEFT JOIN {_in('e', 'SELECT * FROM hub_counts')} LEFT JOIN {_in('tp', q.top_fraction_sql('SELECT * FROM hub_counts', 'endpoint_count', '0.10::DOUBLE'))}
       LEFT JOIN {_in('b1', t.buffer_sql('SELECT row, col FROM hub_counts', 1))} LEFT JOIN {_in('b2', t.buffer_sql('SELECT row, col FROM hub_counts', 2))}""")
def endpoint_anchoring(i):
    """C6, J9."""
    return rb.endpoint_anchoring(i.windows, hub_counts(i), GRID)


q.view("alt_backbone", q.top_fraction_sql("SELECT row, col, sum(n_unique) AS f FROM flight_cw GROUP BY row, col", "f", "0.10::DOUBLE"))


@query("alternative_backbone", "alternative_cells:i jaccard:f point_count_only:i flights_only:i " + q.RR_SPEC,
       f"""SELECT {q.rr_columns()}, (SELECT count(*) FROM alt_backbone) AS alternative_cells, inter::DOUBLE/uni AS jaccard, (SELECT count(*) FROM backbone) - inter AS point_count_only,
       (SELECT count(*) FROM alt_backbone) - inter AS flights_only FROM (SELECT {q.ABCD} FROM (SELECT n_points >= rho_star AS outcome, k.row IS NOT NULL AS exposed
         FROM windows w CROSS JOIN main_break LEFT JOIN alt_backbone k ON w.row = k.row AND w.col = k.col)),
       (SELECT (SELECT count(*) FROM (SELECT row, col FROM backbone INTERSECT SELECT row, col FROM alt_backbone)) AS inter,
               (SELECT count(*) FROM (SELECT row, col FROM backbone UNION SELECT row, col FROM alt_backbone)) AS uni)""")
def alternative_backbone(i):
    """C7, J17."""
    return rb.alternative_backbone(i.windows, cells_op.flight_windows(i.points, WINDOW))


q.view("masked_subsets", """SELECT 'full_sample' AS subset, * FROM masked UNION ALL SELECT 'excluding_interface_windows', * FROM masked WHERE NOT like_
  UNION ALL SELECT 'interface_windows_only', * FROM masked WHERE like_ UNION ALL SELECT 'excluding_interface_cells', * FROM masked WHERE NOT in_cell""")
q.view("masked_summary", q.summary_sql("SELECT * FROM masked_subsets", "subset", backbone="SELECT * FROM backbone"))


@query("interface_masking", "subset:s " + S, "SELECT * FROM masked_summary")
def interface_masking(i):
    """C8, P23."""
    return rb.interface_masking(i.windows)


q.view("excluded_subsets", """SELECT 'exact' AS subset, w.* FROM windows w ANTI JOIN hub_cells h ON w.row = h.row AND w.col = h.col
  UNION ALL SELECT 'buffer', w.* FROM windows w ANTI JOIN hub_buffer1 h ON w.row = h.row AND w.col = h.col""")
q.view("excluded_summary", q.summary_sql("SELECT * FROM excluded_subsets", "subset"))


def hub_buffer(i):
    return buffers.buffer_cells(t.hub_cells_of(i), 1, grid=GRID, edge="clamp")


@query("endpoint_exclusion", "subset:s " + S, "SELECT * FROM excluded_summary")
def endpoint_exclusion(i):
    """C9, J6."""
    return rb.cell_exclusion(i.windows, {"exact": t.hub_cells_of(i), "buffer": hub_buffer(i)})


q.view("busy_excluded_subsets", f"""SELECT 'exact' AS subset, w.* FROM windows w ANTI JOIN top_hub_cells h ON w.row = h.row AND w.col = h.col
  UNION ALL SELECT 'buffer', w.* FROM windows w ANTI JOIN ({t.buffer_sql('SELECT row, col FROM top_hub_cells', 1, 'clamp')}) h ON w.row = h.row AND w.col = h.col""")


@query("endpoint_exclusion_busiest", "subset:s " + S, q.summary_sql("SELECT * FROM busy_excluded_subsets", "subset"))
def endpoint_exclusion_busiest(i):
    """C9 with the busiest tenth of the endpoint cells."""
    busiest = t.top_hub_cells_of(i)
    return rb.cell_exclusion(i.windows, {"exact": busiest, "buffer": buffers.buffer_cells(busiest, 1, grid=GRID, edge="clamp")})


@query("endpoint_exclusion_footprint", "endpoint_cells:i buffer_cells_grid:i buffer_cells_active:i buffer_share_active:f removed_exact_share:f removed_buffer_share:f",
       f"""SELECT (SELECT count(*) FROM hub_cells) AS endpoint_cells, (SELECT count(*) FROM hub_buffer1) AS buffer_cells_grid, count(b1.row) AS buffer_cells_active,
       count(b1.row)::DOUBLE/count(*) AS buffer_share_active, coalesce(sum(x) FILTER (e.row IS NOT NULL), 0)::DOUBLE/sum(x) AS removed_exact_share,
       coalesce(sum(x) FILTER (b1.row IS NOT NULL), 0)::DOUBLE/sum(x) AS removed_buffer_share FROM cell_x c LEFT JOIN {_in('e', 'SELECT * FROM hub_cells')} LEFT JOIN {_in('b1', 'SELECT * FROM hub_buffer1')}""")
def endpoint_exclusion_footprint(i):
    """C9 sizes, J8 (clamp)."""
    return rb.exclusion_footprint(i.windows, t.hub_cells_of(i), GRID)


q.view("near_windows", "SELECT w.*, h.row IS NOT NULL AS near FROM windows w LEFT JOIN hub_buffer1 h ON w.row = h.row AND w.col = h.col")
q.view("phase_subsets", """SELECT 'near_endpoint_buffer' AS subset, * FROM near_windows WHERE near UNION ALL SELECT 'away_from_endpoint_buffer', * FROM near_windows WHERE NOT near
  UNION ALL SELECT 'low_altitude_lt_120m', * FROM near_windows WHERE mean_altitude < 120 UNION ALL SELECT 'cruise_like_altitude_ge_180m', * FROM near_windows WHERE mean_altitude >= 180
  UNION ALL SELECT 'away_from_endpoint_and_cruise_like', * FROM near_windows WHERE NOT near AND mean_altitude >= 180""")
q.view("phase_summary", q.summary_sql("SELECT * FROM phase_subsets", "subset"))


@query("phase_altitude", "subset:s " + S, "SELECT * FROM phase_summary")
def phase_altitude(i):
    """C10."""
    return rb.phase_altitude(i.windows, hub_buffer(i))


@query("window_altitude_quartiles", "p25:f p50:f p75:f",
       "SELECT quantile_cont(mean_altitude, 0.25) AS p25, quantile_cont(mean_altitude, 0.5) AS p50, quantile_cont(mean_altitude, 0.75) AS p75 FROM windows")
def window_altitude_quartiles(i):
    """A41."""
    from airgrid.operators.percentiles import exact_percentiles
    return exact_percentiles(i.windows, "mean_altitude", {"p25": .25, "p50": .5, "p75": .75}, width=0.5)


q.view("band_subsets", " UNION ALL ".join(f"SELECT '{rb.band_label(lo, hi)}' AS subset, * FROM windows WHERE {f'mean_altitude >= {lo}' if lo is not None else 'true'}"
       f" AND {f'mean_altitude < {hi}' if hi is not None else 'true'}" for lo, hi in rb.ALTITUDE_BANDS))
q.view("band_backbone", q.top_fraction_sql("SELECT subset, row, col, sum(n_points) AS tp FROM band_subsets GROUP BY ALL", "tp", "0.10::DOUBLE", "subset"))


q.view("band_summary", q.summary_sql("SELECT * FROM band_subsets", "subset"))


@query("altitude_bands", "subset:s sample_share_percent:f backbone_overlap_share:f altitude_p25:f altitude_p50:f altitude_p75:f " + S,
       f"""SELECT z.*, z.samples*100.0::DOUBLE/(SELECT count(*) FROM windows) AS sample_share_percent, o.ov AS backbone_overlap_share, altitude_p25, altitude_p50, altitude_p75
       FROM ({q.summary_sql('SELECT * FROM band_subsets', 'subset')}) z
       JOIN (SELECT c.subset, avg((b.row IS NOT NULL)::INT) AS ov FROM band_backbone c LEFT JOIN backbone b ON c.row = b.row AND c.col = b.col GROUP BY 1) o ON z.subset = o.subset
       JOIN (SELECT subset, quantile_cont(mean_altitude, 0.25) AS altitude_p25, quantile_cont(mean_altitude, 0.5) AS altitude_p50, quantile_cont(mean_altitude, 0.75) AS altitude_p75 FROM band_subsets GROUP BY 1) a ON a.subset = z.subset""")
def altitude_bands(i):
    """C11, P22."""
    return rb.altitude_bands(i.windows)


@query("fisher_exact", "subset:s a:i b:i c:i d:i fisher_p:f", fisher_sql("subset", "SELECT * FROM band_summary"))
def fisher_exact(i):
    """Fisher p on the fold tables of the altitude bands."""
    return rb.altitude_bands(i.windows).withColumn("fisher_p", fisher_p("a", "b", "c", "d"))


_SIZES = (250.0, 400.0, 500.0, 750.0, 1000.0, 1500.0)
q.view("sized_windows", " UNION ALL ".join(
    f"SELECT {int(s)} AS grid_size_m, {q.row_of('latitude', GridSpec(s))} AS row, {q.col_of('longitude', GridSpec(s))} AS col, window_start, count(*) AS n_points, avg(speed) AS mean_speed, "
    f"{GridSpec(s).total_cells} AS total_cells FROM (SELECT latitude, longitude, speed, {q.window_of('datetime', WINDOW.seconds)} AS window_start FROM telemetry) GROUP BY ALL" for s in _SIZES))
_SIZE_CELLS = "SELECT grid_size_m, row, col, sum(n_points) AS tp FROM sized_windows GROUP BY ALL"


@query("grid_size_sensitivity", "grid_size_m:i total_cells:i active_share_full_grid:f top10_traffic_share:f hotspot_cells:i " + S,
       f"""SELECT z.*, tc AS total_cells, active_cells::DOUBLE/tc AS active_share_full_grid, topp::DOUBLE/allp AS top10_traffic_share, coalesce(hc, 0) AS hotspot_cells FROM (
         {q.summary_sql('SELECT grid_size_m, row, col, window_start, n_points, greatest(mean_speed, 1e-300) AS mean_speed FROM sized_windows', 'grid_size_m')}) z
       JOIN (SELECT grid_size_m, max(total_cells) AS tc, sum(n_points) AS allp FROM sized_windows GROUP BY 1) a USING (grid_size_m)
       JOIN (SELECT grid_size_m, sum(tp) AS topp FROM ({q.top_fraction_sql(_SIZE_CELLS, 'tp', '0.10::DOUBLE', 'grid_size_m')}) GROUP BY 1) b USING (grid_size_m)
       LEFT JOIN (SELECT w.grid_size_m, count(DISTINCT (row, col)) AS hc FROM sized_windows w JOIN ({q.piecewise_sql(q.curve_sql('(SELECT * REPLACE (greatest(mean_speed, 1e-300) AS mean_speed) FROM sized_windows)', 'grid_size_m'), 'grid_size_m')}) p
         ON w.grid_size_m = p.grid_size_m WHERE n_points >= rho_star GROUP BY 1) h USING (grid_size_m)""")
def grid_size_sensitivity(i):
    """C12."""
    return rb.grid_size_sensitivity(i.telemetry, _SIZES, WINDOW)


_CUTOFFS = (0.05, 0.10, 0.20)
q.view("cut_cells", """SELECT row, col, total_points AS tp, x, s, row_number() OVER (ORDER BY total_points DESC, row, col) AS rk, count(*) OVER () AS nn FROM cells JOIN cell_x USING (row, col)""")
q.view("cutoffs", f"""SELECT {q.rr_columns()}, cutoff, active_cells, backbone_cells, backbone_cells::DOUBLE/active_cells AS backbone_cell_share, backbone_points, bp_share AS traffic_share,
  hotspot_cells, hotspot_cells_covered, hotspot_cells_covered::DOUBLE/hotspot_cells AS hotspot_share, a::DOUBLE/(a+c) AS exceedance_share FROM (
  SELECT cutoff, count(*) AS active_cells, count(*) FILTER (ins) AS backbone_cells, sum(tp) FILTER (ins) AS backbone_points, sum(tp) FILTER (ins)::DOUBLE/sum(tp) AS bp_share,
    count(*) FILTER (x > 0) AS hotspot_cells, count(*) FILTER (x > 0 AND ins) AS hotspot_cells_covered, coalesce(sum(x) FILTER (ins), 0) AS a, coalesce(sum(s-x) FILTER (ins), 0) AS b,
    coalesce(sum(x) FILTER (NOT ins), 0) AS c, coalesce(sum(s-x) FILTER (NOT ins), 0) AS d FROM (
    SELECT *, rk <= greatest(1, floor(nn*cutoff)) AS ins FROM cut_cells, (SELECT unnest([0.05::DOUBLE, 0.10::DOUBLE, 0.20::DOUBLE]) AS cutoff)) GROUP BY cutoff)""")


@query("backbone_cutoffs", "cutoff:f active_cells:i backbone_cells:i backbone_cell_share:f backbone_points:i traffic_share:f hotspot_cells:i hotspot_cells_covered:i hotspot_share:f exceedance_share:f " + q.RR_SPEC,
       "SELECT * FROM cutoffs")
def backbone_cutoffs(i):
    """C13."""
    return rb.backbone_cutoffs(i.occ, _CUTOFFS)


def _contrast(lo, hi):
    g = lambda c: f"h.{c} - l.{c}"
    r = lambda c: f"h.{c}/l.{c}"
    return (f"SELECT '{lo:g} vs {hi:g}' AS contrast, {r('backbone_cell_share')} AS footprint_ratio, {g('traffic_share')} AS traffic_gain, {g('hotspot_share')} AS hotspot_gain,"
            f" {g('exceedance_share')} AS exceedance_gain, {r('rr')} AS rr_ratio, {r('odds_ratio')} AS or_ratio FROM cutoffs l, cutoffs h WHERE l.cutoff = {lo}::DOUBLE AND h.cutoff = {hi}::DOUBLE")


@query("backbone_cutoff_contrasts", "contrast:s footprint_ratio:f traffic_gain:f hotspot_gain:f exceedance_gain:f rr_ratio:f or_ratio:f",
       _contrast(0.05, 0.10) + " UNION ALL " + _contrast(0.10, 0.20))
def backbone_cutoff_contrasts(i):
    """C13 contrasts."""
    return rb.cutoff_contrasts(rb.backbone_cutoffs(i.occ, _CUTOFFS), [(0.05, 0.10), (0.10, 0.20)])


_PICK = "rho_star, speed_drop_percent, rr, rr_lo, rr_hi, samples"


@query("threshold_subsets", "subset:s rho_star:f speed_drop_percent:f rr:f4 rr_lo:f4 rr_hi:f4 samples:i",
       f"""SELECT 'Full sample' AS subset, {_PICK} FROM masked_summary WHERE subset = 'full_sample' UNION ALL SELECT 'Exclude interface-like windows', {_PICK} FROM masked_summary WHERE subset = 'excluding_interface_windows'
       UNION ALL SELECT 'Exclude endpoint +1 buffer', {_PICK} FROM excluded_summary WHERE subset = 'buffer' UNION ALL SELECT 'Away-from-endpoint, altitude >=180 m', {_PICK} FROM phase_summary WHERE subset = 'away_from_endpoint_and_cruise_like'""")
def threshold_subsets(i):
    """C18."""
    return rb.threshold_subsets(i.windows, hub_buffer(i))


# ------------------------------------------------------------------- folds
q.view("day_folds", "SELECT f.d AS fold, w.* FROM windows w, (SELECT DISTINCT strftime(window_start, '%Y-%m-%d') AS d FROM windows) f WHERE strftime(w.window_start, '%Y-%m-%d') <> f.d")
q.view("day_fold_summary", q.summary_sql("SELECT * FROM day_folds", "fold"))


@query("leave_one_day_out", "fold:s " + S + " fisher_p:f", with_fisher("SELECT * FROM day_fold_summary", "fold"))
def leave_one_day_out(i):
    """R9 (days)."""
    return rb.leave_one_day_out(i.windows)


COLLECTION = "n_runs:i rr_min:f4 rr_median:f4 rr_max:f4 rho_star_min:f rho_star_median:f rho_star_max:f or_min:f4 or_median:f4 or_max:f4"


def collection_sql(source):
    return "SELECT count(*) AS n_runs, " + ", ".join(f"min({c}) AS {n}_min, quantile_cont({c}, 0.5) AS {n}_median, max({c}) AS {n}_max"
                                                   for c, n in (("rr", "rr"), ("rho_star", "rho_star"), ("odds_ratio", "or"))) + f" FROM {source}"


@query("leave_one_day_out_range", COLLECTION, collection_sql("day_fold_summary"))
def leave_one_day_out_range(i):
    """A39."""
    return collection_summary(rb.leave_one_day_out(i.windows))


def fold_windows_sql(points: str, group: str) -> str:
    return (f"SELECT f.fold, row, col, window_start, count(*) AS n_points, avg(speed) AS mean_speed FROM ({points}) p, (SELECT DISTINCT {group} AS fold FROM ({points})) f"
            f" WHERE {group} <> f.fold GROUP BY ALL")


_REMOVED = "removed_point_rows:i removed_cell_windows:i "


def removed_sql(points: str, group: str) -> str:
    return f"SELECT g, sum(n) AS removed_point_rows, count(*) AS removed_cell_windows FROM (SELECT {group} AS g, row, col, window_start, count(*) AS n FROM ({points}) GROUP BY ALL) GROUP BY g"


def group_fold_sql(points: str, group: str, out: str) -> str:
    return (f"SELECT z.*, z.fold AS {out}, r.removed_point_rows, r.removed_cell_windows FROM ({q.summary_sql(fold_windows_sql(points, group), 'fold')}) z"
            f" JOIN ({removed_sql(points, group)}) r ON r.g = z.fold")


@query("leave_one_vendor_out", "vendor:s " + _REMOVED + S, group_fold_sql("SELECT * FROM points", "vendor", "vendor"))
def leave_one_vendor_out(i):
    """R9 (vendors)."""
    return rb.leave_one_group_out(cells_op.contributions(i.points, WINDOW, "vendor"), "vendor")


def vendor_days(i):
    return i.points.withColumn("vendor_day", F.concat_ws("_", "vendor", F.date_format("datetime", "yyyy-MM-dd")))


q.view("vendor_day_points", "SELECT *, vendor || '_' || strftime(window_start, '%Y-%m-%d') AS vendor_day FROM points")


@query("vendor_day_contributions", "vendor_day:s row:i col:i window_start:t n_points:i speed_sum:f",
       "SELECT vendor_day, row, col, window_start, count(*) AS n_points, sum(speed) AS speed_sum FROM vendor_day_points GROUP BY ALL")
def vendor_day_contributions(i):
    """A36."""
    return cells_op.contributions(vendor_days(i), WINDOW, "vendor_day")


@query("leave_one_vendor_day_out", "vendor_day:s " + _REMOVED + S, group_fold_sql("SELECT * FROM vendor_day_points", "vendor_day", "vendor_day"))
def leave_one_vendor_day_out(i):
    """R12."""
    return rb.leave_one_group_out(cells_op.contributions(vendor_days(i), WINDOW, "vendor_day"), "vendor_day")


q.view("top_hub_out", """SELECT w.* FROM windows w ANTI JOIN top_hub_cells h ON w.row = h.row AND w.col = h.col""")


@query("leave_top_endpoints_out", S, q.summary_sql("SELECT * FROM top_hub_out"))
def leave_top_endpoints_out(i):
    """R10."""
    return summarize(i.occ.join(t.top_hub_cells_of(i), ["row", "col"], "left_anti"))


# ------------------------------------------------------- bootstraps and nulls
def draw_sql(n: str, *parts: str) -> str:
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 15))::BIGINT % {n})"


def iters(n: int) -> str:
    return f"(SELECT unnest(range({n})) AS iter)"


q.view("blocks", f"SELECT block, row_number() OVER (ORDER BY block) - 1 AS j, a, b, c, d, count(*) OVER () AS nb FROM (SELECT block, {q.ABCD} FROM fixed_rows GROUP BY block)")
q.view("block_draws", f"SELECT iter, {draw_sql('nb', '42', 'iter', 'j')} AS r FROM blocks, {iters(1000)}")
q.view("block_boot", f"""SELECT {q.rr_columns()}, iter FROM (SELECT iter, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM block_draws JOIN blocks ON j = r GROUP BY iter)""")


def boot_summary_sql(source, columns):
    parts = ["count(*) AS n_bootstraps"]
    for name, expr in columns.items():
        parts += [f"count({expr}) AS {name}_finite", f"avg({expr}) AS {name}_mean", f"quantile_cont({expr}, 0.5) AS {name}_median",
                  f"quantile_cont({expr}, 0.025) AS {name}_lo", f"quantile_cont({expr}, 0.975) AS {name}_hi"]
    return f"SELECT {', '.join(parts)} FROM {source}"


def _boot_spec(*names):
    return "n_bootstraps:i " + " ".join(f"{n}_finite:i {n}_mean:f4 {n}_median:f4 {n}_lo:f4 {n}_hi:f4" for n in names)


@query("date_hour_bootstrap", _boot_spec("rr", "odds_ratio", "log_or"),
       boot_summary_sql("block_boot", {"rr": "rr", "odds_ratio": "odds_ratio", "log_or": "ln(odds_ratio)"}))
def date_hour_bootstrap(i):
    """R2."""
    return rs.bootstrap_summary(rs.date_hour_bootstrap(i.windows), ["rr", "odds_ratio", "log_or"])


q.view("wide_curve", """SELECT *, row_number() OVER (ORDER BY bin) - 1 AS position, count(*) OVER () AS nb FROM (
  SELECT greatest(0, ceil((n_points - lo)/((hi-lo)/100.0::DOUBLE)) - 1)::INT AS bin, avg(n_points) AS density, avg(mean_speed) AS speed
  FROM windows, (SELECT min(n_points) AS lo, max(n_points) AS hi FROM windows) GROUP BY 1)""")


def rho_boot_sql(order):
    return f"""SELECT count(bp) AS n_bootstraps, avg(bp) AS mean, stddev_pop(bp) AS std, quantile_cont(bp, 0.5) AS median, quantile_cont(bp, 0.025) AS lo, quantile_cont(bp, 0.975) AS hi FROM (
      SELECT iter, coalesce(arg_max(density, row(round(b-a, 9), -k)) FILTER (k >= 5 AND k < nb-5), max(density) FILTER (k = nb//2)) AS bp FROM (
       SELECT *, row_number() OVER w - 1 AS k, avg(speed) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(speed) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a
       FROM (SELECT iter, x.position AS j, c.density, c.speed, c.nb FROM (SELECT position, iter, {draw_sql('nb', '2', 'iter', 'position')} AS r FROM wide_curve, {iters(1000)}) x JOIN wide_curve c ON c.position = x.r)
       WINDOW w AS (PARTITION BY iter ORDER BY {order})) GROUP BY iter)"""


RHO_BOOT = "n_bootstraps:i mean:f std:f median:f lo:f hi:f"


@query("rho_bootstrap", RHO_BOOT, rho_boot_sql("j"))
def rho_bootstrap(i):
    """R3 in draw order."""
    return rs.rho_bootstrap_summary(rs.rho_bootstrap(i.windows))


@query("rho_bootstrap_sorted", RHO_BOOT, rho_boot_sql("density, j"))
def rho_bootstrap_sorted(i):
    """R3 with re-sorted resamples."""
    return rs.rho_bootstrap_summary(rs.rho_bootstrap(i.windows, resort=True))


q.view("shuffle_values", "SELECT block, row_number() OVER (PARTITION BY block ORDER BY row, col, window_start) AS rk, n_points FROM fixed_rows")
q.view("shuffle_labels", f"""SELECT iter, block, row, col, row_number() OVER (PARTITION BY iter, block ORDER BY md5('42|' || iter::VARCHAR || '|' || row::VARCHAR || '|' || col::VARCHAR || '|' || epoch(window_start)::BIGINT::VARCHAR)) AS rk
  FROM fixed_rows, {iters(50)}""")
q.view("shuffled", "SELECT iter, l.row, l.col, v.n_points FROM shuffle_labels l JOIN shuffle_values v ON l.block = v.block AND l.rk = v.rk")
q.view("shuffled_bb", q.top_fraction_sql("SELECT iter, row, col, sum(n_points) AS tp FROM shuffled GROUP BY ALL", "tp", "0.10::DOUBLE", "iter"))
q.view("shuffle_null", f"""SELECT {q.rr_columns()}, iter FROM (SELECT iter, {q.ABCD} FROM (SELECT s.iter, n_points >= rho_star AS outcome, k.row IS NOT NULL AS exposed FROM shuffled s CROSS JOIN main_break
  LEFT JOIN shuffled_bb k ON s.iter = k.iter AND s.row = k.row AND s.col = k.col) GROUP BY iter)""")
q.view("fixed_risk", f"SELECT {q.rr_columns()} FROM (SELECT {q.ABCD} FROM fixed_rows)")


def null_sql(source, value, observed):
    return (f"SELECT count(*) AS n_values, count(v) AS n_finite, max(o) AS observed, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.025) AS lo,"
            f" quantile_cont(v, 0.975) AS hi, max(v) AS max, (sum((v >= o)::INT) + 1.0::DOUBLE)/(count(v) + 1) AS p_ge,"
            f" (sum((v <= o)::INT) + 1.0::DOUBLE)/(count(v) + 1) AS p_le FROM (SELECT {value} AS v, {observed} AS o FROM {source})")


NULL = "n_values:i n_finite:i observed:f4 mean:f4 median:f4 lo:f4 hi:f4 max:f4 p_ge:f p_le:f"


def observed_coupling(i):
    table = summarize(i.occ, backbone=core.backbone_cells(i.occ), rho=core.rho_star(i.occ))
    return table


@query("time_shuffle_null", NULL, null_sql("shuffle_null", "odds_ratio", "(SELECT odds_ratio FROM fixed_risk)"))
def time_shuffle_null(i):
    """R4, R8."""
    return rs.null_summary(rs.time_shuffle_null(i.windows), "odds_ratio", observed_coupling(i).select("odds_ratio").scalar())


q.view("random_bb", f"""SELECT iter, x, s FROM (SELECT iter, x, s, row_number() OVER (PARTITION BY iter ORDER BY md5('42|' || iter::VARCHAR || '|' || row::VARCHAR || '|' || col::VARCHAR)) AS rk FROM cell_x, {iters(50)})
  WHERE rk <= (SELECT count(*) FROM backbone)""")
q.view("random_null", f"""SELECT {q.rr_columns()}, iter FROM (SELECT iter, sum(x) AS a, sum(s-x) AS b, (SELECT sum(x) FROM cell_x) - sum(x) AS c, (SELECT sum(s-x) FROM cell_x) - sum(s-x) AS d FROM random_bb GROUP BY iter)""")


@query("random_backbone_null", NULL, null_sql("random_null", "odds_ratio", "(SELECT odds_ratio FROM fixed_risk)"))
def random_backbone_null(i):
    """R5, R8."""
    return rs.null_summary(rs.random_backbone_null(i.windows), "odds_ratio", observed_coupling(i).select("odds_ratio").scalar())


q.view("od_line", "SELECT kind, row, col, row_number() OVER (PARTITION BY kind ORDER BY row, col) - 1 AS j, count(*) OVER (PARTITION BY kind) AS nb FROM ends")
q.view("od_synth", f"""SELECT DISTINCT iter, l.row, l.col FROM (SELECT kind, iter, {draw_sql('nb', '42', 'kind', 'iter', 'j')} AS r FROM od_line, {iters(50)}) x JOIN od_line l ON l.kind = x.kind AND l.j = x.r""")
q.view("od_synth_near", f"""SELECT DISTINCT iter, greatest(0, least({GRID.n_rows - 1}, row + dr)) AS row, greatest(0, least({GRID.n_cols - 1}, col + dc)) AS col FROM od_synth,
  (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-1, 2)) AS dc)""")


@query("od_reassignment_null", "iter:i exact_share:f buffer_share:f",
       """SELECT iter, max(e) AS exact_share, max(n) AS buffer_share FROM (
         SELECT iter, sum(x)::DOUBLE/(SELECT sum(x) FROM cell_x) AS e, NULL AS n FROM od_synth JOIN cell_x USING (row, col) GROUP BY iter
         UNION ALL SELECT iter, NULL, sum(x)::DOUBLE/(SELECT sum(x) FROM cell_x) FROM od_synth_near JOIN cell_x USING (row, col) GROUP BY iter) GROUP BY iter""")
def od_reassignment_null(i):
    """R6."""
    return rs.od_reassignment_null(t.trips.endpoints(t.od_of(i), GRID), i.windows, GRID)


_OD_NULL = """SELECT iter, max(e) AS exact_share, max(n) AS buffer_share FROM (
         SELECT iter, sum(x)::DOUBLE/(SELECT sum(x) FROM cell_x) AS e, NULL AS n FROM od_synth JOIN cell_x USING (row, col) GROUP BY iter
         UNION ALL SELECT iter, NULL, sum(x)::DOUBLE/(SELECT sum(x) FROM cell_x) FROM od_synth_near JOIN cell_x USING (row, col) GROUP BY iter) GROUP BY iter"""
q.view("end_cells", "SELECT DISTINCT row, col FROM ends")
q.view("end_cells_near", f"""SELECT DISTINCT greatest(0, least({GRID.n_rows - 1}, row + dr)) AS row, greatest(0, least({GRID.n_cols - 1}, col + dc)) AS col FROM end_cells,
  (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-1, 2)) AS dc)""")


OD_NULLS = {m: null_sql(f"({_OD_NULL})", m, f"(SELECT sum(x)::DOUBLE/(SELECT sum(x) FROM cell_x) FROM {v} JOIN cell_x USING (row, col))")
            for m, v in (("exact_share", "end_cells"), ("buffer_share", "end_cells_near"))}


@query("od_reassignment_null_summary", "measure:s " + NULL, " UNION ALL ".join(f"SELECT '{m}' AS measure, * FROM ({v})" for m, v in OD_NULLS.items()))
def od_reassignment_null_summary(i):
    """Drawn against real endpoints."""
    ends = materialize(t.trips.endpoints(t.od_of(i), GRID))
    draws = materialize(rs.od_reassignment_null(ends, i.windows, GRID))
    return rs.null_summaries(draws, rs.endpoint_shares(ends, i.occ, GRID))


def cluster_sql(points: str, group: str, n: int, seed: int) -> str:
    return f"""SELECT {q.rr_columns()}, iter FROM (SELECT iter, {q.ABCD} FROM (
      SELECT z.iter, z.n >= rho_star AS outcome, k.row IS NOT NULL AS exposed FROM (
        SELECT iter, row, col, window_start, sum(m*n) AS n FROM (SELECT {group} AS g, row, col, window_start, count(*) AS n FROM ({points}) GROUP BY ALL) p JOIN (
          SELECT iter, c.g, count(*) AS m FROM (SELECT iter, {draw_sql('nb', str(seed), 'iter', 'j')} AS r FROM ids, {iters(n)}) d JOIN ids c ON c.j = d.r GROUP BY ALL) w USING (g) GROUP BY ALL) z
      CROSS JOIN main_break LEFT JOIN backbone k ON z.row = k.row AND z.col = k.col) GROUP BY iter)""".replace(
        " ids", f" (SELECT g, row_number() OVER (ORDER BY substr(md5(g), 1, 2), g) - 1 AS j, count(*) OVER () AS nb FROM (SELECT DISTINCT {group} AS g FROM ({points})))")


@query("vendor_day_bootstrap", _boot_spec("rr", "odds_ratio"),
       boot_summary_sql("(" + cluster_sql("SELECT * FROM vendor_day_points", "vendor_day", 300, 20260405) + ")", {"rr": "rr", "odds_ratio": "odds_ratio"}))
def vendor_day_bootstrap(i):
    """R13."""
    parts = cells_op.contributions(vendor_days(i), WINDOW, "vendor_day")
    draws = rs.cluster_bootstrap(parts, "vendor_day", core.backbone_cells(i.occ), core.rho_star(i.occ), 300, 20260405)
    return rs.bootstrap_summary(draws, ["rr", "odds_ratio"])
