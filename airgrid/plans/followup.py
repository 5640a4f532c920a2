"""Follow-up flights: log normalisation, per-flight metrics against reference sets, archive summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.geo import centroid_lat, centroid_lon, raw_col, raw_row, with_cell
from airgrid.operators.buffers import buffer_cells
from airgrid.operators.cells import in_set
from airgrid.operators.percentiles import bounded_percentiles, exact_percentiles
from airgrid.operators.sequences import compress_visits, with_visit_index
from airgrid.session import materialize
from airgrid.spec import SLOW_SPEED, GridSpec


def path_metadata(df: DataFrame, path: str = "path", root: str = "logs/") -> DataFrame:
    """Folder, route, file, flight id and local start time from a log path; other years are dropped."""
    parts = F.split(F.replace(F.col(path), F.lit(root), F.lit("")), "/")
    nested = F.size(parts) >= 3
    file_name = F.element_at(parts, -1)
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    out = df.withColumns({
        "source_folder": F.when(nested, F.get(parts, F.lit(0))).otherwise(F.lit("root_logs")),
        "route_code": F.when(nested, F.get(parts, F.lit(1))).otherwise(F.lit("unassigned")), "file_name": file_name, "_stem": stem})
    out = out.where(F.substring("_stem", 1, 4).isin("2025", "2026"))
    return out.withColumns({
        "flight_id": F.concat_ws("__", "source_folder", "route_code", "_stem"),
        "flight_start_local": F.try_to_timestamp("_stem", F.lit("yyyyMMdd-HHmmss"))}).drop("_stem")


def normalize_logs(logs: DataFrame, grid: GridSpec) -> DataFrame:
    """Valid log points with elapsed seconds, local time, ground speed, clamped cell and in-grid flag.

    Paths are taken apart once per path, not per point, and the points travel with their path and measures only.
    """
    valid = (F.col("lat") > 20) & (F.col("lat") < 25) & (F.col("lon") > 110) & (F.col("lon") < 116) & F.col("logtime").isNotNull()
    logs = logs.where(valid & F.col("path").isNotNull())
    files = path_metadata(logs.groupBy("path").agg(F.min("logtime").alias("_first")))
    # several paths can belong to one flight
    files = files.withColumns({"_first": F.min("_first").over(Window.partitionBy("flight_id")),
                               "flight_date_local": F.date_format("flight_start_local", "yyyy-MM-dd")})
    points = logs.join(files, "path").withColumn("elapsed_s", (F.col("logtime") - F.col("_first")) / 1e6)
    row, col = raw_row(F.col("lat"), grid), raw_col(F.col("lon"), grid)
    inside = row.between(0, grid.n_rows - 1) & col.between(0, grid.n_cols - 1)
    return with_cell(points.withColumns({
        "ground_speed": F.hypot("vel_x", "vel_y"), "is_within_main_grid": inside,
        "datetime": F.timestamp_seconds(F.unix_timestamp("flight_start_local") + F.floor("elapsed_s"))}), grid, "lon", "lat").withColumnsRenamed(
        {"lon": "longitude", "lat": "latitude"}).drop("_first")


def flight_keys(points: DataFrame) -> DataFrame:
    """The flights of ``flight_summary`` without their measures."""
    return points.select("flight_id", "source_folder", "route_code", "file_name", "flight_date_local").distinct()


def flight_summary(points: DataFrame) -> DataFrame:
    """Start, end, duration, points, first and last position and median ground speed per flight."""
    here, when = F.struct("longitude", "latitude", "altitude_agl"), F.struct("logtime", "longitude", "latitude", "altitude_agl")
    out = points.groupBy("flight_id", "source_folder", "route_code", "file_name", "flight_date_local").agg(
        F.min("flight_start_local").alias("flight_start_local"), F.max("datetime").alias("flight_end_local"), F.max("elapsed_s").alias("duration_s"),
        F.count(F.lit(1)).alias("n_valid_points"), F.min_by(here, when).alias("s"), F.max_by(here, when).alias("e"))
    out = out.select(*[c for c in out.columns if c not in ("s", "e")], F.col("s.longitude").alias("start_lon"), F.col("s.latitude").alias("start_lat"),
                     F.col("e.longitude").alias("end_lon"), F.col("e.latitude").alias("end_lat"), F.col("s.altitude_agl").alias("start_alt_agl"),
                     F.col("e.altitude_agl").alias("end_alt_agl"))
    return out.join(exact_percentiles(points, "ground_speed", {"median_ground_speed": .5}, width=0.05, by=["flight_id"]), "flight_id", "left")


def date_route_summary(flights: DataFrame) -> DataFrame:
    return flights.groupBy("flight_date_local", "source_folder", "route_code").agg(
        F.count(F.lit(1)).alias("flights"), F.min("flight_start_local").alias("first_start"), F.max("flight_end_local").alias("last_end"))


FLIGHT_ORDER = ("logtime", "longitude", "latitude")


def flight_visits(points: DataFrame) -> DataFrame:
    return compress_visits(points, key="flight_id", order=FLIGHT_ORDER)


def flight_paths(points: DataFrame, grid: GridSpec) -> DataFrame:
    """Compressed cell path of each flight with cell centres."""
    indexed = with_visit_index(flight_visits(points), key="flight_id", order=FLIGHT_ORDER)
    return indexed.withColumns({"lon_center": centroid_lon(F.col("col"), grid), "lat_center": centroid_lat(F.col("row"), grid)})


def flight_metrics(points: DataFrame, *, backbone: DataFrame, hotspots: DataFrame, endpoint_cells: DataFrame, endpoint_buffer: DataFrame,
                   site_buffer: DataFrame, skeleton_edges: DataFrame) -> DataFrame:
    """Per flight: path reuse, cell-set shares, endpoint flags and how local its slow points are.

    ``points`` are read several times, so they should be a written table.
    """
    key = ["flight_id"]
    visits = materialize(flight_visits(points).select("flight_id", "logtime", "longitude", "latitude", "row", "col", "previous"))
    here, there = F.struct(F.col("previous.row"), F.col("previous.col")), F.struct("row", "col")
    moves = visits.where(F.col("previous").isNotNull()).select("flight_id", F.least(here, there).alias("node_a"), F.greatest(here, there).alias("node_b"))
    known = skeleton_edges.select("node_a", "node_b", F.lit(1).alias("hit"))
    edges = moves.join(known, ["node_a", "node_b"], "left").groupBy(*key).agg(F.count(F.lit(1)).alias("n_edges"), F.count("hit").alias("edge_hits"))

    ends = visits.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_sequence_cells"), F.min_by(F.struct("row", "col"), F.struct(*FLIGHT_ORDER)).alias("s"),
        F.max_by(F.struct("row", "col"), F.struct(*FLIGHT_ORDER)).alias("e"))
    cells = in_set(in_set(visits.select("flight_id", "row", "col").distinct(), backbone, "b"), hotspots, "h")
    unique = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n_unique_cells"), F.avg(F.col("b").cast("int")).alias("cell_share_in_backbone"),
                                     F.avg(F.col("h").cast("int")).alias("cell_share_in_hotspots"))
    sides = ends.select("flight_id", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("s.row"), F.col("s.col")),
                                                       F.struct(F.lit("end").alias("side"), F.col("e.row"), F.col("e.col")))).alias("p")).select("flight_id", "p.*")
    own = buffer_cells(sides, 1, edge="unbounded", by=key).withColumn("own", F.lit(True))
    for name, members in (("endpoint", endpoint_cells), ("endpoint_buffer1", endpoint_buffer), ("station_buffer1", site_buffer)):
        sides = in_set(sides, members, name)
    flags = []
    for name in ("endpoint", "endpoint_buffer1", "station_buffer1"):
        flags += [F.max(F.when(F.col("side") == side, F.col(name).cast("int"))).alias(f"{side}_in_{name}") for side in ("start", "end")]
    sides = sides.groupBy(*key).agg(*flags)
    both = lambda n: F.col(f"start_in_{n}") * F.col(f"end_in_{n}")

    slow = F.col("ground_speed") < SLOW_SPEED
    tagged = in_set(points.select("flight_id", "row", "col", "ground_speed"), backbone, "b").join(own, ["flight_id", "row", "col"], "left")
    stats = tagged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(F.col("b").cast("int")).alias("point_share_in_backbone"), F.count_if(slow).alias("slow_points"),
        F.count_if(slow & F.col("own").isNotNull()).alias("slow_points_near_ends"), F.count("own").alias("points_near_ends"))
    out = stats.join(ends.select("flight_id", "n_sequence_cells"), key).join(unique, key).join(sides, key).join(edges, key, "left").na.fill(0, ["n_edges", "edge_hits"])
    return out.withColumns({
        "edge_share_on_skeleton": F.try_divide(F.col("edge_hits"), F.col("n_edges")), "both_in_endpoint_buffer1": both("endpoint_buffer1"),
        "both_in_station_buffer1": both("station_buffer1"), "slow_share_near_ends": F.try_divide(F.col("slow_points_near_ends"), F.col("slow_points")),
        "point_share_near_ends": F.col("points_near_ends") / F.col("n_points"),
        "slow_localization_lift": F.try_divide(F.try_divide(F.col("slow_points_near_ends"), F.col("slow_points")), F.col("points_near_ends") / F.col("n_points"))})


def archive_summary(metrics: DataFrame) -> DataFrame:
    """Path, interface and slowing persistence over all flights."""
    s = lambda c: F.sum(c)
    share = lambda a, b: F.try_divide(s(a), s(b))
    row = exact_percentiles(metrics, "edge_share_on_skeleton", {"median_edge_share": .5, "p25_edge_share": .25}, width=0.001)
    out = metrics.agg(
        F.count(F.lit(1)).alias("flights"), s("n_points").alias("points"), share("edge_hits", "n_edges").alias("weighted_edge_share"),
        F.avg(F.coalesce(F.col("edge_share_on_skeleton") >= 0.8, F.lit(False)).cast("int")).alias("share_flights_ge_80pct"),
        (s(F.col("point_share_in_backbone") * F.col("n_points")) / s("n_points")).alias("point_share_in_backbone"),
        (s(F.col("start_in_endpoint_buffer1") + F.col("end_in_endpoint_buffer1")) / (2 * F.count(F.lit(1)))).alias("endpoint_match_share"),
        F.avg("both_in_endpoint_buffer1").alias("both_endpoint_share"),
        (s(F.col("start_in_station_buffer1") + F.col("end_in_station_buffer1")) / (2 * F.count(F.lit(1)))).alias("station_match_share"),
        F.avg("both_in_station_buffer1").alias("both_station_share"), share("slow_points_near_ends", "slow_points").alias("slow_share_near_ends"),
        share("points_near_ends", "n_points").alias("point_share_near_ends"))
    return out.select("*", F.try_divide(F.col("slow_share_near_ends"), F.col("point_share_near_ends")).alias("slowing_lift"),
                      *[row.select(c).scalar().alias(c) for c in row.columns])


def route_group_summary(metrics: DataFrame, flights: DataFrame, by: Column) -> DataFrame:
    """Flights, weighted and median skeleton share per route group (or year)."""
    joined = metrics.join(flights.select("flight_id", "flight_date_local", "source_folder", "route_code"), "flight_id").withColumn("route_group", by)
    base = joined.groupBy("route_group").agg(F.count(F.lit(1)).alias("flights"), F.sum("edge_hits").alias("hits"), F.sum("n_edges").alias("edges"),
                                             F.try_divide(F.sum("edge_hits"), F.sum("n_edges")).alias("weighted_edge_share"))
    return base.join(exact_percentiles(joined, "edge_share_on_skeleton", {"median_edge_share": .5}, width=0.001, by=["route_group"]), "route_group", "left")


def route_group() -> Column:
    return F.concat_ws(" | ", F.substring("flight_date_local", 1, 10), "source_folder", "route_code")


def flight_year() -> Column:
    return F.substring("flight_date_local", 1, 4)


def truthy(value: Column) -> Column:
    """Text flag as written by several tools."""
    return value.isin("1", "True", "true")
