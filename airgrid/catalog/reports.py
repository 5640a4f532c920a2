"""Registered queries: CSV and parquet round trips, flattened result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid import sinks
from airgrid.catalog import core as c
from airgrid.catalog import robustness as r
from airgrid.catalog import routes as g
from airgrid.catalog import sites as s
from airgrid.catalog import sql as q
from airgrid.catalog import trips as t
from airgrid.catalog.inputs import GRID, WINDOW
from airgrid.catalog.registry import query
from airgrid.operators import cells as cells_op, clean, trips
from airgrid.plans import core, reports, resampling as rs, robustness as rb
from airgrid.plans.summary import collection_summary, summarize
from airgrid.session import materialize, table_path
from airgrid.sources import tables


@query("csv_round_trip", "vendor:s rows:i with_time:i numeric_altitude:i",
       """SELECT vendor, count(*) AS rows, count(time) AS with_time, count(try_cast(altitude AS DOUBLE)) AS numeric_altitude FROM raw_telemetry GROUP BY vendor""")
def csv_round_trip(i):
    """Raw text written as CSV and scanned again with the fixed schema."""
    path = table_path(i.spark, "csv")
    sinks.write_table(i.raw_telemetry.select(*tables.RAW_COLUMNS), path, fmt="csv")
    raw = tables.read_raw_csv(i.spark, path)
    return raw.groupBy("vendor").agg(F.count(F.lit(1)).alias("rows"), F.count("time").alias("with_time"),
                                     F.count(F.col("altitude").try_cast("double")).alias("numeric_altitude"))


@query("landed_points_scan", "date:s n:i mean_speed:f",
       "SELECT datetime::date AS date, count(*) AS n, avg(speed) AS mean_speed FROM cleaned WHERE datetime::date >= date '2023-10-10' GROUP BY 1")
def landed_points_scan(i):
    """Cleaned points landed by date, then scanned with partition and column pruning."""
    path = table_path(i.spark, "points")
    sinks.write_table(clean.clean_points(i.raw_telemetry), path, partition_by="date")
    points = tables.read_points(i.spark, path, ["date", "speed"], F.col("date") >= F.lit("2023-10-10").cast("date"))
    return points.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("mean_speed"))


@query("site_csv_round_trip", "site_name:s platform:s note:s lon:s lat:s", "SELECT site_name, platform, note, lon, lat FROM sites")
def site_csv_round_trip(i):
    """Site table through a GB18030 file."""
    path = table_path(i.spark, "sites")
    sinks.write_table(i.sites.select(*[F.col(c) for c in ("site_name", "platform", "city", "note", "open_time", "lon", "lat")]), path, fmt="csv", encoding="GB18030")
    return tables.read_sites(i.spark, path, encoding="GB18030")


@query("metric_round_trip", "rho_star:f speed_free:f n_bins:i", "SELECT rho_star, speed_free, n_bins FROM main_break")
def metric_round_trip(i):
    """Metric rows through JSON."""
    path = table_path(i.spark, "metrics")
    sinks.write_metrics(core.critical_density(i.occ), path)
    return i.spark.read.schema("rho_star double, speed_free double, n_bins bigint").json(path)


# ------------------------------------------------------------------- tables
_FIELDS = "rho_star, samples, a, b, c, d, rr, rr_lo, rr_hi, odds_ratio, or_lo, or_hi"
_FOR = {"endpoint_cells_only_exclusion": "exact", "endpoint_cells_buffer1_exclusion": "buffer"}
q.view("holdout_rows", f"""SELECT half, {q.rr_columns()} FROM (SELECT w.half, {q.ABCD} FROM (SELECT w.*, n_points >= rho_star AS outcome, k.row IS NOT NULL AS exposed FROM half_windows w CROSS JOIN main_break
  LEFT JOIN half_backbone k ON w.row = k.row AND w.col = k.col AND w.half <> k.half) w GROUP BY w.half)""")
q.view("alt_rows", f"SELECT {q.rr_columns()} FROM (SELECT {q.ABCD} FROM (SELECT n_points >= rho_star AS outcome, k.row IS NOT NULL AS exposed FROM windows w CROSS JOIN main_break LEFT JOIN alt_backbone k ON w.row = k.row AND w.col = k.col))")
q.view("unique_rows", f"SELECT {q.rr_columns()}, (SELECT rho_star FROM unique_break) AS rho_star FROM (SELECT {q.ABCD} FROM (SELECT n_unique >= rho_star AS outcome, k.row IS NOT NULL AS exposed FROM flight_cw w CROSS JOIN unique_break LEFT JOIN backbone k ON w.row = k.row AND w.col = k.col))")


def _crow(i, group, source, where="", rho="rho_star", samples="samples"):
    return f"SELECT '{i}' AS analysis_id, '{group}' AS analysis_group, {_FIELDS.replace('rho_star', rho, 1).replace('samples', samples, 1)} FROM {source} {where}"


_T = "a+b+c+d"
_MAIN = "(SELECT rho_star FROM main_break)"
_CONT = [_crow("main_full_sample", "main", "main_summary"), _crow("out_of_sample_forward", "out_of_sample", "holdout_rows", "WHERE half = 'second'", _MAIN, _T),
         _crow("out_of_sample_reverse", "out_of_sample", "holdout_rows", "WHERE half = 'first'", _MAIN, _T), _crow("unique_flight_occupancy", "measurement_alternative", "unique_rows", samples=_T),
         _crow("alternative_corridor_definition", "structure_alternative", "alt_rows", rho=_MAIN, samples=_T)]
_CONT += [_crow("leave_top_endpoint_out", "leave_group_out", f"({q.summary_sql('SELECT * FROM top_hub_out')})"),
          _crow("leave_largest_backbone_cluster_out", "leave_group_out", f"({q.summary_sql('SELECT * FROM without_largest')})")]
_CONT += [_crow(k, "endpoint_exclusion", "excluded_summary", f"WHERE subset = '{v}'") for k, v in _FOR.items()]
_PHASES = ("near_endpoint_buffer", "away_from_endpoint_buffer", "low_altitude_lt_120m", "cruise_like_altitude_ge_180m", "away_from_endpoint_and_cruise_like")
_CONT += [_crow(f"phase_{p}", "phase_altitude", "phase_summary", f"WHERE subset = '{p}'") for p in _PHASES]


@query("report_contingency", "analysis_id:s analysis_group:s rho_star:f samples:i a:i b:i c:i d:i rr:f4 rr_lo:f4 rr_hi:f4 odds_ratio:f4 or_lo:f4 or_hi:f4", " UNION ALL ".join(_CONT))
def report_contingency(i):
    """S12 (2x2 tables)."""
    main = core.critical_density(i.occ).select("rho_star").scalar()
    hold = materialize(rb.chronological_holdout(i.windows).withColumn("rho_star", main))
    excluded = materialize(rb.cell_exclusion(i.windows, {"exact": t.hub_cells_of(i), "buffer": r.hub_buffer(i)}))
    phases = materialize(rb.phase_altitude(i.windows, r.hub_buffer(i)))
    flights = materialize(cells_op.flight_windows(i.points, WINDOW))
    parts = [("main_full_sample", "main", summarize(i.occ)), ("out_of_sample_forward", "out_of_sample", hold.where(F.col("split") == "forward")),
             ("out_of_sample_reverse", "out_of_sample", hold.where(F.col("split") == "reverse")),
             ("unique_flight_occupancy", "measurement_alternative", rb.unique_flight_occupancy(flights, core.backbone_cells(i.occ))),
             ("alternative_corridor_definition", "structure_alternative", rb.alternative_backbone(i.windows, flights).withColumn("rho_star", main)),
             ("leave_top_endpoint_out", "leave_group_out", r.leave_top_endpoints_out(i)),
             ("leave_largest_backbone_cluster_out", "leave_group_out", g.leave_largest_component_out(i))]
    parts += [(k, "endpoint_exclusion", excluded.where(F.col("subset") == v)) for k, v in _FOR.items()]
    parts += [(f"phase_{p}", "phase_altitude", phases.where(F.col("subset") == p)) for p in _PHASES]
    return reports.contingency_table(parts)


@query("report_contingency_p", "analysis_id:s a:i b:i c:i d:i fisher_p:f", r.fisher_sql("analysis_id", " UNION ALL ".join(_CONT)))
def report_contingency_p(i):
    """Fisher p of every reported 2x2 table."""
    return report_contingency(i).withColumn("fisher_p", r.fisher_p("a", "b", "c", "d"))


_SHORT = "rho_star, rr, odds_ratio, speed_drop_percent, samples, NULL AS n_runs, NULL AS rr_min, NULL AS rr_max"
_RANGE = "NULL AS rho_star, NULL AS rr, NULL AS odds_ratio, NULL AS speed_drop_percent, NULL AS samples, count(*) AS n_runs, min(rr) AS rr_min, max(rr) AS rr_max"
_MASKS = {"interface_mask_excluding_windows": "excluding_interface_windows", "interface_mask_excluding_cells": "excluding_interface_cells"}


def _check(name: str, category: str, source: str, columns: str = _SHORT) -> str:
    return f"SELECT '{name}' AS check_id, '{category}' AS category, {columns} FROM {source}"


_CHECKS = [_check(k, "interface_masking", f"masked_summary WHERE subset = '{v}'") for k, v in _MASKS.items()]
_CHECKS += [_check(k, "endpoint_exclusion", f"excluded_summary WHERE subset = '{v}'") for k, v in _FOR.items()]
_CHECKS += [_check(f"phase_{p}", "phase_altitude", f"phase_summary WHERE subset = '{p}'") for p in _PHASES]
_CHECKS += [_check("leave_top_endpoint_out", "leave_group_out", f"({q.summary_sql('SELECT * FROM top_hub_out')})"),
            _check("leave_largest_backbone_cluster_out", "leave_group_out", f"({q.summary_sql('SELECT * FROM without_largest')})"),
            _check("unique_flight_occupancy", "measurement_alternative", "unique_rows", "rho_star, rr, odds_ratio, NULL AS speed_drop_percent, a+b+c+d AS samples, NULL AS n_runs, NULL AS rr_min, NULL AS rr_max"),
            _check("leave_one_day_out_range", "leave_one_group_out", "day_fold_summary", _RANGE),
            _check("leave_one_vendor_out_range", "leave_one_group_out", f"({r.group_fold_sql('SELECT * FROM points', 'vendor', 'vendor')})", _RANGE)]


@query("report_robustness", "check_id:s category:s rho_star:f rr:f4 odds_ratio:f4 speed_drop_percent:f samples:i n_runs:i rr_min:f4 rr_max:f4", " UNION ALL ".join(_CHECKS))
def report_robustness(i):
    """S12 (checks of different shapes)."""
    short = ["rho_star", "rr", "odds_ratio", "speed_drop_percent", "samples"]
    masked = materialize(rb.interface_masking(i.windows))
    excluded = materialize(rb.cell_exclusion(i.windows, {"exact": t.hub_cells_of(i), "buffer": r.hub_buffer(i)}))
    phases = materialize(rb.phase_altitude(i.windows, r.hub_buffer(i)))
    parts = [(k, "interface_masking", masked.where(F.col("subset") == v).select(*short)) for k, v in _MASKS.items()]
    parts += [(k, "endpoint_exclusion", excluded.where(F.col("subset") == v).select(*short)) for k, v in _FOR.items()]
    parts += [(f"phase_{p}", "phase_altitude", phases.where(F.col("subset") == p).select(*short)) for p in _PHASES]
    unique = rb.unique_flight_occupancy(cells_op.flight_windows(i.points, WINDOW), core.backbone_cells(i.occ))
    span = lambda folds: collection_summary(folds).select("n_runs", "rr_min", "rr_max")
    parts += [("leave_top_endpoint_out", "leave_group_out", r.leave_top_endpoints_out(i).select(*short)),
              ("leave_largest_backbone_cluster_out", "leave_group_out", g.leave_largest_component_out(i).select(*short)),
              ("unique_flight_occupancy", "measurement_alternative", unique.select("rho_star", "rr", "odds_ratio", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("samples"))),
              ("leave_one_day_out_range", "leave_one_group_out", span(rb.leave_one_day_out(i.windows))),
              ("leave_one_vendor_out_range", "leave_one_group_out", span(r.leave_one_vendor_out(i)))]
    return reports.robustness_table(parts)


@query("report_breakpoints", "specification_id:s rho_star:f speed_drop_percent:f n_bins:i weighting:s",
       "SELECT spec AS specification_id, rho_star, speed_drop_percent, n_bins, CASE WHEN contains(spec, 'count_weighted') THEN 'count_weighted' ELSE 'equal_weight_bins' END AS weighting FROM ("
       + q.piecewise_sql("SELECT *  FROM spec_curves", by="spec", weight="wt").replace("density_center, speed_mean, sample_count,", "density_center, speed_mean, sample_count, wt,") + ")")
def report_breakpoints(i):
    """S12 (breakpoint specifications)."""
    return reports.breakpoint_table(c.core_specifications(i.occ))


_DRAWN = "SELECT '{id}' AS summary_id, '{kind}' AS category, {cols} FROM ({source})"
_BOOT = "count(*) AS n_draws, avg({v}) AS mean, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.025) AS lo, quantile_cont({v}, 0.975) AS hi, NULL AS p_ge"
_NULLED = "n_values AS n_draws, mean, median, lo, hi, p_ge"
_FIXED = "(SELECT odds_ratio FROM fixed_risk)"
_RESAMPLED = [_DRAWN.format(id=f"cluster_bootstrap_{n}", kind="cluster_bootstrap", cols=_BOOT.format(v=f"(CASE WHEN isfinite({v}) THEN {v} END)"), source="SELECT * FROM block_boot")
              for n, v in (("or_adj", "odds_ratio"), ("rr", "rr"))]
_RESAMPLED += [_DRAWN.format(id="rho_star_bootstrap", kind="rho_star_bootstrap", cols="n_bootstraps AS n_draws, mean, median, lo, hi, NULL AS p_ge", source=r.rho_boot_sql("j")),
               _DRAWN.format(id="null_random_backbone_or_adj", kind="null_model", cols=_NULLED, source=r.null_sql("random_null", "odds_ratio", _FIXED)),
               _DRAWN.format(id="null_time_shuffle_or_adj", kind="null_model", cols=_NULLED, source=r.null_sql("shuffle_null", "odds_ratio", _FIXED))]
_RESAMPLED += [_DRAWN.format(id=f"null_od_reassignment_{m}", kind="null_model", cols=_NULLED, source=source) for m, source in r.OD_NULLS.items()]
_RESAMPLED += [_DRAWN.format(id=f"null_morphology_{m}", kind="null_model", cols=_NULLED, source=source) for m, source in g.MORPHOLOGY_NULLS.items()]


@query("report_resampling", "summary_id:s category:s n_draws:i mean:f4 median:f4 lo:f4 hi:f4 p_ge:f", " UNION ALL ".join(_RESAMPLED))
def report_resampling(i):
    """S12 (bootstraps and nulls)."""
    drawn = ("mean", "median", "lo", "hi")
    nulled = [F.col("n_values").alias("n_draws"), *drawn, "p_ge"]
    boots = materialize(rs.bootstrap_summary(rs.date_hour_bootstrap(i.windows), ["odds_ratio", "rr"]))
    rho = rs.rho_bootstrap_summary(rs.rho_bootstrap(i.windows)).select(F.col("n_bootstraps").alias("n_draws"), *drawn)
    parts = [(f"cluster_bootstrap_{n}", "cluster_bootstrap", boots.select(F.col("n_bootstraps").alias("n_draws"), *[F.col(f"{v}_{k}").alias(k) for k in drawn]))
             for n, v in (("or_adj", "odds_ratio"), ("rr", "rr"))]
    parts += [("rho_star_bootstrap", "rho_star_bootstrap", rho), ("null_random_backbone_or_adj", "null_model", r.random_backbone_null(i).select(*nulled)),
              ("null_time_shuffle_or_adj", "null_model", r.time_shuffle_null(i).select(*nulled))]
    for name, table, measures in (("od_reassignment", r.od_reassignment_null_summary(i), r.OD_NULLS), ("morphology", g.morphology_null_summary(i), g.MORPHOLOGY_NULLS)):
        table = materialize(table)
        parts += [(f"null_{name}_{m}", "null_model", table.where(F.col("measure") == m).select(*nulled)) for m in measures]
    return reports.resampling_table(parts)
