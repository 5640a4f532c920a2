"""Registered queries: cleaning, trajectories, OD pairs, lengths, day profiles, flow (P, A1-A2, A8-A13, A22-A32, W5-W7, W12, C21, S1, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import sql as q
from airgrid.catalog.inputs import GRID, WINDOW, staged
from airgrid.catalog.registry import query
from airgrid.operators import buffers, clean, sequences, temporal, trips
from airgrid.operators.cells import in_set
from airgrid.operators.ranking import top_fraction
from airgrid.plans import flow
from airgrid.spec import DURATION_EDGES_MIN, LENGTH_EDGES_KM

# ---------------------------------------------------------------- cleaning
q.view("typed", """SELECT * EXCLUDE (speed, altitude, yaw, flight_time, longitude, latitude), try_cast(speed AS DOUBLE) AS speed,
  try_cast(altitude AS DOUBLE) AS altitude, try_cast(yaw AS DOUBLE) AS yaw, try_cast(flight_time AS DOUBLE) AS flight_time,
  try_cast(longitude AS DOUBLE) AS longitude, try_cast(latitude AS DOUBLE) AS latitude,
  try_strptime(lpad(split_part(trim(time), '.', 1), 14, '0'), '%Y%m%d%H%M%S') AS datetime,
  try_strptime(CASE WHEN length(time) <= 14 THEN lpad(time, 14, '0') END, '%Y%m%d%H%M%S') AS strict_datetime
  FROM raw_telemetry WHERE order_id IS NOT NULL""")
_VALID = ("speed BETWEEN 0 AND 40 AND altitude BETWEEN 0 AND 500 AND longitude BETWEEN 113.31::DOUBLE AND 114.25::DOUBLE"
          " AND latitude BETWEEN 22.31::DOUBLE AND 22.87::DOUBLE")
q.view("cleaned", f"SELECT * FROM typed WHERE datetime IS NOT NULL AND {_VALID} AND flight_time >= 0")
CLEAN_SPEC = ("order_id:s sn:s vendor:s datetime:t date:s hour:i minute:i second:i day_of_week:i is_weekend:b speed:f altitude:f "
              "yaw_clean:f yaw_valid:b flight_time:f longitude:f latitude:f")
_CLEAN_SQL = """SELECT *, datetime::date AS date, hour(datetime) AS hour, minute(datetime) AS minute, second(datetime) AS second,
  isodow(datetime) - 1 AS day_of_week, isodow(datetime) >= 6 AS is_weekend, nullif(yaw, 999.0) AS yaw_clean, yaw <> 999.0 AS yaw_valid FROM """


@query("clean_points", CLEAN_SPEC, _CLEAN_SQL + "cleaned")
def clean_points(i):
    """P1-P7 with the fractional suffix of times removed."""
    return clean.clean_points(i.raw_telemetry)


@query("clean_points_strict_time", CLEAN_SPEC,
       _CLEAN_SQL + f"(SELECT * EXCLUDE (datetime), strict_datetime AS datetime FROM typed WHERE strict_datetime IS NOT NULL AND {_VALID} AND flight_time >= 0)")
def clean_points_strict_time(i):
    """Times with a suffix are unreadable and dropped."""
    return clean.clean_points(i.raw_telemetry, strip=False)


@query("clean_points_without_flight_time", "order_id:s datetime:t speed:f altitude:f flight_time:f",
       f"SELECT * FROM typed WHERE datetime IS NOT NULL AND {_VALID}")
def clean_points_without_flight_time(i):
    """P6 without the flight-time condition."""
    return clean.clean_points(i.raw_telemetry, flight_time=False)


@query("long_orders", "order_id:s datetime:t longitude:f latitude:f speed:f altitude:f",
       "SELECT * FROM cleaned WHERE order_id IN (SELECT order_id FROM cleaned GROUP BY order_id HAVING count(*) >= 3)")
def long_orders(i):
    """P8."""
    return clean.keep_long_orders(clean.clean_points(i.raw_telemetry))


@query("window_keys", "window_key:s n:i",
       "SELECT strftime(time_bucket(to_seconds(120), datetime), '%Y%m%d%H%M%S') AS window_key, count(*) AS n FROM typed WHERE datetime IS NOT NULL GROUP BY 1")
def window_keys(i):
    """P3."""
    return clean.window_key(clean.drop_empty(i.raw_telemetry), 120).groupBy("window_key").agg(F.count(F.lit(1)).alias("n"))


q.view("traj", """SELECT order_id, count(*) AS num_points, min(datetime) AS start_time, max(datetime) AS end_time, avg(speed) AS avg_speed,
  avg(altitude) AS avg_altitude, min(vendor) AS vendor, epoch(max(datetime)) - epoch(min(datetime)) AS duration_seconds
  FROM telemetry GROUP BY order_id HAVING count(*) >= 3""")


@query("trajectory_stats", "order_id:s num_points:i start_time:t end_time:t avg_speed:f avg_altitude:f vendor:s duration_seconds:f",
       "SELECT * FROM traj")
def trajectory_stats(i):
    """A1."""
    return trips.trajectory_stats(i.telemetry)


@query("trajectory_segments", "order_id:s segment:i n:i seconds:s",
       """SELECT order_id, floor(epoch(datetime)/600) AS segment, count(*) AS n,
       string_agg(epoch(datetime)::BIGINT::VARCHAR, ',' ORDER BY datetime) AS seconds FROM telemetry GROUP BY 1, 2""")
def trajectory_segments(i):
    """A2: nested points per order and time slice."""
    nested = trips.trajectory_segments(i.telemetry)
    seconds = F.transform("points", lambda p: F.unix_timestamp(p["datetime"]).cast("string"))
    return nested.select("order_id", "segment", F.size("points").alias("n"), F.array_join(seconds, ",").alias("seconds"))


@query("data_summary", "rows:i first_time:t last_time:t days:i trips:i mean_points:f mean_duration_s:f mean_speed:f mean_altitude:f",
       """SELECT (SELECT count(*) FROM telemetry) AS rows, (SELECT min(datetime) FROM telemetry) AS first_time, (SELECT max(datetime) FROM telemetry) AS last_time,
       (SELECT floor((epoch(max(datetime)) - epoch(min(datetime)))/86400) + 1 FROM telemetry) AS days, count(*) AS trips, avg(num_points) AS mean_points,
       avg(duration_seconds) AS mean_duration_s, avg(avg_speed) AS mean_speed, avg(avg_altitude) AS mean_altitude FROM traj""")
def data_summary(i):
    """S10 (totals)."""
    return clean.data_summary(i.telemetry, trips.trajectory_stats(i.telemetry))


@query("hour_distribution", "hour:i rows:i percent:f",
       """SELECT h.hour, coalesce(n, 0) AS rows, coalesce(n, 0)*100.0::DOUBLE/(SELECT count(*) FROM telemetry) AS percent
       FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN (SELECT hour(datetime) AS hour, count(*) AS n FROM telemetry GROUP BY 1) USING (hour)""")
def hour_distribution(i):
    """S10 (hours)."""
    return clean.hour_distribution(i.telemetry)


# ------------------------------------------------------- refined grid and OD
_TK = "row(datetime, longitude, latitude, speed, altitude)"
q.view("rounded_pts", """SELECT *, round_even(longitude*10000.0::DOUBLE, 0)/10000.0::DOUBLE AS lon_r,
  round_even(latitude*10000.0::DOUBLE, 0)/10000.0::DOUBLE AS lat_r FROM telemetry""")
q.view("refined_extent", "SELECT min(lon_r) AS lo, max(lon_r) AS hi, min(lat_r) AS la, max(lat_r) AS ha FROM rounded_pts")
q.view("refined", f"""SELECT p.*, floor((lat_r - la)*111000.0::DOUBLE/{GRID.size_m}::DOUBLE)::INT AS row,
  floor((lon_r - lo)*111000.0::DOUBLE*cos(radians((la+ha)/2.0::DOUBLE))/{GRID.size_m}::DOUBLE)::INT AS col FROM rounded_pts p, refined_extent""")
q.view("od_all", f"""SELECT order_id, min(vendor) AS vendor, count(*) AS n, arg_min(row, {_TK}) AS start_row, arg_min(col, {_TK}) AS start_col,
  arg_min(lon_r, {_TK}) AS start_lon, arg_min(lat_r, {_TK}) AS start_lat, arg_min(altitude, {_TK}) AS start_altitude, min(datetime) AS start_time,
  arg_max(row, {_TK}) AS end_row, arg_max(col, {_TK}) AS end_col, arg_max(lon_r, {_TK}) AS end_lon, arg_max(lat_r, {_TK}) AS end_lat,
  arg_max(altitude, {_TK}) AS end_altitude, max(datetime) AS end_time, epoch(max(datetime)) - epoch(min(datetime)) AS duration
  FROM refined GROUP BY order_id""")
q.view("od", "SELECT * FROM od_all WHERE n >= 2 AND (start_row <> end_row OR start_col <> end_col)")
q.view("ends", f"""SELECT *, {q.row_of('lat', GRID)} AS row, {q.col_of('lon', GRID)} AS col FROM (
  SELECT order_id, 'start' AS kind, start_row AS r_row, start_col AS r_col, start_lon AS lon, start_lat AS lat, start_altitude AS altitude FROM od
  UNION ALL SELECT order_id, 'end', end_row, end_col, end_lon, end_lat, end_altitude FROM od)""")
q.view("endpoint_cells", "SELECT row, col, count(*) AS endpoint_count FROM ends GROUP BY row, col")


def buffer_sql(cells: str, radius: int, edge: str = "discard") -> str:
    r, c = "row + dr", "col + dc"
    if edge == "clamp":
        r, c = f"greatest(0, least({GRID.n_rows - 1}, {r}))", f"greatest(0, least({GRID.n_cols - 1}, {c}))"
    keep = f"WHERE row BETWEEN 0 AND {GRID.n_rows - 1} AND col BETWEEN 0 AND {GRID.n_cols - 1}" if edge == "discard" else ""
    span = f"range(-{radius}, {radius + 1})"
    return (f"SELECT DISTINCT row, col FROM (SELECT {r} AS row, {c} AS col FROM ({cells}), (SELECT unnest({span}) AS dr),"
            f" (SELECT unnest({span}) AS dc)) {keep}")


# In the derived telemetry nearly every cell is an endpoint; the busiest tenth serves as the anchor set.
q.view("hub_cells", "SELECT DISTINCT row, col FROM endpoint_cells")
q.view("top_hub_cells", "SELECT row, col FROM (" + q.top_fraction_sql("SELECT * FROM endpoint_cells", "endpoint_count", "0.10::DOUBLE") + ")")
q.view("hub_buffer1", buffer_sql("SELECT row, col FROM hub_cells", 1, "clamp"))

OD_SPEC = ("order_id:s vendor:s start_row:i start_col:i start_lon:f start_lat:f start_time:t end_row:i end_col:i end_lon:f "
           "end_lat:f end_time:t duration:f")


def refined_points(i):
    return trips.refined_points(i.telemetry, GRID.size_m)


@staged
def paths_of(i):
    """Both ends and the length of every order: the OD pairs and the trips are read from this one table."""
    return trips.order_paths(i.telemetry)


@staged
def refined_extent_of(i):
    return trips.refined_extent(i.telemetry)


def od_of(i):
    return trips.refined_pairs(paths_of(i), refined_extent_of(i), GRID.size_m)


@staged
def endpoint_cells_of(i):
    return trips.endpoint_counts(trips.endpoints(od_of(i), GRID))


@staged
def hub_cells_of(i):
    """All endpoint cells."""
    return endpoint_cells_of(i).select("row", "col").distinct()


@staged
def top_hub_cells_of(i):
    return top_fraction(endpoint_cells_of(i), "endpoint_count", 0.10).select("row", "col")


@query("refined_grid_summary", "min_lon:f max_lon:f min_lat:f max_lat:f n_rows:i n_cols:i total_cells:i used_cells:i",
       f"""SELECT *, n_rows*n_cols AS total_cells, (SELECT count(*) FROM (SELECT DISTINCT row, col FROM refined)) AS used_cells FROM (
       SELECT lo AS min_lon, hi AS max_lon, la AS min_lat, ha AS max_lat, ceil((ha-la)*111000.0::DOUBLE/{GRID.size_m}::DOUBLE) AS n_rows,
       ceil((hi-lo)*111000.0::DOUBLE*cos(radians((la+ha)/2.0::DOUBLE))/{GRID.size_m}::DOUBLE) AS n_cols FROM refined_extent)""")
def refined_grid_summary(i):
    """P13, P14."""
    return trips.refined_summary(refined_points(i), GRID.size_m)


@query("refined_cells", "row:i col:i n:i", "SELECT row, col, count(*) AS n FROM refined GROUP BY row, col")
def refined_cells(i):
    return refined_points(i).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query("od_pairs", OD_SPEC, "SELECT * FROM od")
def od_pairs(i):
    """A10."""
    return od_of(i)


@query("od_flow", "start_row:i start_col:i end_row:i end_col:i flow:i",
       "SELECT start_row, start_col, end_row, end_col, count(*) AS flow FROM od GROUP BY ALL")
def od_flow(i):
    """A11."""
    return trips.od_flow(od_of(i))


@query("od_flow_summary", "total_flow:i unique_pairs:i mean_flow:f",
       "SELECT sum(flow) AS total_flow, count(*) AS unique_pairs, avg(flow) AS mean_flow FROM (SELECT count(*) AS flow FROM od GROUP BY start_row, start_col, end_row, end_col)")
def od_flow_summary(i):
    """A11 totals."""
    return trips.od_flow(od_of(i)).agg(F.sum("flow").alias("total_flow"), F.count(F.lit(1)).alias("unique_pairs"), F.avg("flow").alias("mean_flow"))


@query("od_flow_top10", "start_row:i start_col:i end_row:i end_col:i flow:i",
       """SELECT start_row, start_col, end_row, end_col, count(*) AS flow FROM od GROUP BY ALL
       ORDER BY flow DESC, start_row, start_col, end_row, end_col LIMIT 10""")
def od_flow_top10(i):
    """W10."""
    return trips.od_flow(od_of(i)).orderBy(F.desc("flow"), "start_row", "start_col", "end_row", "end_col").limit(10)


@query("endpoint_cells", "row:i col:i endpoint_count:i", "SELECT * FROM endpoint_cells")
def endpoint_cells(i):
    """A12, J18."""
    return endpoint_cells_of(i)


@query("endpoint_cells_raw_coordinates", "row:i col:i endpoint_count:i",
       f"""SELECT row, col, count(*) AS endpoint_count FROM (SELECT arg_min(row, {_TK}) AS row, arg_min(col, {_TK}) AS col FROM points GROUP BY order_id HAVING count(*) >= 3
       UNION ALL SELECT arg_max(row, {_TK}), arg_max(col, {_TK}) FROM points GROUP BY order_id HAVING count(*) >= 3) GROUP BY row, col""")
def endpoint_cells_raw_coordinates(i):
    """First and last cell of valid orders from unrounded coordinates, same-cell orders kept."""
    od = trips.od_pairs(i.points, minimum=3, distinct_ends=False, lon="longitude", lat="latitude")
    return trips.endpoint_counts(trips.endpoints(od))


q.view("endpoint_alt", """SELECT row, col, count(*) AS n, count(*) FILTER (kind = 'start') AS starts, count(*) FILTER (kind = 'end') AS ends_,
  avg(altitude) AS mean_altitude, quantile_cont(altitude, 0.5) AS median_altitude, quantile_cont(altitude, 0.25) AS p25, quantile_cont(altitude, 0.75) AS p75,
  quantile_cont(lon, 0.5) AS median_lon, quantile_cont(lat, 0.5) AS median_lat FROM ends GROUP BY row, col""")


@query("endpoint_altitudes", "row:i col:i n:i starts:i ends:i mean_altitude:f median_altitude:f p25:f p75:f median_lon:f median_lat:f",
       "SELECT *, ends_ AS ends FROM endpoint_alt")
def endpoint_altitudes(i):
    """A13."""
    return trips.endpoint_altitudes(trips.endpoints(od_of(i), GRID))


# ---------------------------------------------------------------- lengths
def trips_of(i):
    return trips.lengths_of(paths_of(i))


q.view("steps", f"""SELECT *, lag(latitude) OVER o AS p_lat, lag(longitude) OVER o AS p_lon FROM telemetry
  WINDOW o AS (PARTITION BY order_id ORDER BY datetime, longitude, latitude, speed, altitude)""")
q.view("trips_m", f"""SELECT order_id, min(vendor) AS vendor, count(*) AS num_points, min(datetime) AS start_time, max(datetime) AS end_time,
  coalesce(sum({q.haversine('p_lat', 'p_lon', 'latitude', 'longitude')}), 0.0) AS path_m,
  {q.haversine(f'arg_min(latitude, {_TK})', f'arg_min(longitude, {_TK})', f'arg_max(latitude, {_TK})', f'arg_max(longitude, {_TK})')} AS od_m
  FROM steps GROUP BY order_id HAVING count(*) >= 3""")
q.view("trips", """SELECT order_id, vendor, num_points, (epoch(end_time)-epoch(start_time))/60.0::DOUBLE AS duration_minutes,
  path_m/1000.0::DOUBLE AS path_length_km, od_m/1000.0::DOUBLE AS od_distance_km,
  CASE WHEN od_m > 0 THEN path_m/od_m ELSE 0.0 END AS circuity_ratio, start_time, end_time FROM trips_m""")


@query("trip_lengths", "order_id:s vendor:s num_points:i duration_minutes:f path_length_km:f od_distance_km:f circuity_ratio:f start_time:t end_time:t",
       "SELECT * FROM trips")
def trip_lengths(i):
    """A24, P15."""
    return trips.trip_lengths(i.telemetry)


@query("length_summary", "scope:s metric:s n:i mean:f5 max:f5 median:f5 p25:f5 p75:f5 p90:f5 p95:f5",
       """SELECT scope, metric, count(*) AS n, avg(value) AS mean, max(value) AS max, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25,
       quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95 FROM (
       SELECT unnest(['all', 'vendor ' || vendor]) AS scope, metric, value FROM (
         UNPIVOT (SELECT vendor, path_length_km, od_distance_km, duration_minutes FROM trips) ON path_length_km, od_distance_km, duration_minutes INTO NAME metric VALUE value))
       GROUP BY scope, metric""")
def length_summary(i):
    """A25."""
    return trips.length_summary(trips_of(i))


@query("length_bins", "length_bin:s n:i share:f",
       """SELECT l.length_bin, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE/(SELECT count(*) FROM trips) AS share
       FROM (SELECT unnest(['lt_2km','2_5km','5_10km','10_15km','15_20km','ge_20km']) AS length_bin) l LEFT JOIN (
       SELECT CASE WHEN path_length_km < 2 THEN 'lt_2km' WHEN path_length_km < 5 THEN '2_5km' WHEN path_length_km < 10 THEN '5_10km'
         WHEN path_length_km < 15 THEN '10_15km' WHEN path_length_km < 20 THEN '15_20km' ELSE 'ge_20km' END AS length_bin, count(*) AS n FROM trips GROUP BY 1) USING (length_bin)""")
def length_bins(i):
    """A26, P18."""
    return trips.length_bins(trips_of(i))


def bin_sql(value: str) -> str:
    edges = (1, 3, 5, 10, 20, 80)
    labels = ("0-1", "1-3", "3-5", "5-10", "10-20", "20-80")
    whens = " ".join(f"WHEN {value} < {e} THEN '{label}'" for e, label in zip(edges, labels))
    return f"CASE WHEN {value} < 0 THEN NULL {whens} END"


q.view("trips_binned", f"SELECT *, {bin_sql('path_length_km')} AS dist_bin, CASE WHEN duration_minutes <> 0 THEN path_length_km/(duration_minutes/60.0::DOUBLE) END AS speed_kmh FROM trips")


@query("duration_bins", "dist_bin:s n:i median_dist_km:f5 q25_dist_km:f5 q75_dist_km:f5 median_duration_min:f5 q25_duration_min:f5 q75_duration_min:f5 "
       "median_effective_speed_kmh:f4 faster_than_20kph_ref:b faster_than_25kph_ref:b faster_than_30kph_ref:b",
       """SELECT *, median_effective_speed_kmh > 20 AS faster_than_20kph_ref, median_effective_speed_kmh > 25 AS faster_than_25kph_ref, median_effective_speed_kmh > 30 AS faster_than_30kph_ref
       FROM (SELECT dist_bin, count(*) AS n, quantile_cont(path_length_km, 0.5) AS median_dist_km, quantile_cont(path_length_km, 0.25) AS q25_dist_km, quantile_cont(path_length_km, 0.75) AS q75_dist_km,
       quantile_cont(duration_minutes, 0.5) AS median_duration_min, quantile_cont(duration_minutes, 0.25) AS q25_duration_min, quantile_cont(duration_minutes, 0.75) AS q75_duration_min,
       quantile_cont(speed_kmh, 0.5) AS median_effective_speed_kmh FROM trips_binned WHERE dist_bin IS NOT NULL GROUP BY dist_bin)""")
def duration_bins(i):
    """A29, P19."""
    return trips.duration_bins(trips_of(i))


_DETOUR = 1.4
q.view("break_even", f"""SELECT *, (od_distance_km*{_DETOUR}::DOUBLE)/(duration_minutes/60.0::DOUBLE) AS be FROM trips_binned
  WHERE duration_minutes > 0 AND od_distance_km > 0 AND dist_bin IS NOT NULL""")


@query("ground_speed_advantage", "dist_bin:s ground_speed_kmh:i n:i share_aerial_faster:f",
       "SELECT dist_bin, g AS ground_speed_kmh, count(*) AS n, avg((be > g)::INT) AS share_aerial_faster FROM break_even, (SELECT unnest(range(10, 71)) AS g) GROUP BY dist_bin, g")
def ground_speed_advantage(i):
    """A32, J14."""
    return trips.advantage_grid(trips_of(i), _DETOUR)


@query("ground_speed_advantage_pivot", "dist_bin:s kmh_20:f kmh_40:f kmh_60:f",
       "SELECT dist_bin, avg((be > 20)::INT) AS kmh_20, avg((be > 40)::INT) AS kmh_40, avg((be > 60)::INT) AS kmh_60 FROM break_even GROUP BY dist_bin")
def ground_speed_advantage_pivot(i):
    """A32 as a pivoted grid."""
    return trips.advantage_pivot(trips.advantage_grid(trips_of(i), _DETOUR), (20, 40, 60))


@query("break_even_quartiles", "dist_bin:s n:i median_break_even_speed_kmh:f4 q25_break_even_speed_kmh:f4 q75_break_even_speed_kmh:f4",
       """SELECT dist_bin, count(*) AS n, quantile_cont(be, 0.5) AS median_break_even_speed_kmh, quantile_cont(be, 0.25) AS q25_break_even_speed_kmh,
       quantile_cont(be, 0.75) AS q75_break_even_speed_kmh FROM break_even GROUP BY dist_bin""")
def break_even_quartiles(i):
    """A32 break-even speeds."""
    return trips.break_even_quartiles(trips_of(i), _DETOUR)


# ----------------------------------------------------------- day profiles
def slots_sql(minutes: int) -> str:
    return f"SELECT datetime::date AS date, (hour(datetime)*60 + minute(datetime))//{minutes} AS slot_index, count(*) AS points, count(DISTINCT order_id) AS active_flights FROM event_points GROUP BY 1, 2"


def label_sql(slot: str, minutes: int) -> str:
    return (f"printf('%02d:%02d-%02d:%02d', ({slot}*{minutes})//60, ({slot}*{minutes})%60, ({slot}*{minutes}+{minutes - 1})//60, ({slot}*{minutes}+{minutes - 1})%60)")


def profile_sql(minutes: int) -> str:
    return f"""SELECT s.slot_index, {label_sql('s.slot_index', minutes)} AS slot_label, coalesce(sum(points), 0) AS total_points,
      coalesce(sum(points), 0)::DOUBLE/(SELECT count(*) FROM event_points) AS share_of_points,
      coalesce(sum(active_flights), 0)::DOUBLE/(SELECT count(DISTINCT datetime::date) FROM event_points) AS mean_active_flights_per_day,
      coalesce(quantile_cont(active_flights, 0.5), 0) AS median_active_flights_per_day, coalesce(max(active_flights), 0) AS peak_active_flights_in_any_day,
      count(points) AS days_with_activity FROM (SELECT unnest(range({24 * 60 // minutes})) AS slot_index) s LEFT JOIN ({slots_sql(minutes)}) USING (slot_index) GROUP BY s.slot_index"""


PROFILE = ("slot_index:i slot_label:s total_points:i share_of_points:f mean_active_flights_per_day:f median_active_flights_per_day:f "
           "peak_active_flights_in_any_day:i days_with_activity:i")


@query("hourly_profile", PROFILE, profile_sql(60))
def hourly_profile(i):
    """A22, P17."""
    return temporal.slot_profile(i.events, 60)


@query("halfhour_profile", PROFILE, profile_sql(30))
def halfhour_profile(i):
    """A22."""
    return temporal.slot_profile(i.events, 30)


@query("peak_slots", "peak_slot_by_points:s peak_slot_by_mean_active_flights:s",
       f"""SELECT arg_max(slot_label, row(total_points, -slot_index)) AS peak_slot_by_points,
       arg_max(slot_label, row(mean_active_flights_per_day, -slot_index)) AS peak_slot_by_mean_active_flights FROM ({profile_sql(60)})""")
def peak_slots(i):
    """W12."""
    return temporal.peak_slots(temporal.slot_profile(i.events, 60))


q.view("dense_slots", f"""SELECT d.date, s.slot_index, {label_sql('s.slot_index', 30)} AS slot_label, coalesce(points, 0) AS points,
  coalesce(active_flights, 0) AS active_flights, coalesce(points, 0)::DOUBLE/day_points AS share_of_day
  FROM (SELECT datetime::date AS date, count(*) AS day_points FROM event_points GROUP BY 1) d, (SELECT unnest(range(48)) AS slot_index) s
  LEFT JOIN ({slots_sql(30)}) x ON x.date = d.date AND x.slot_index = s.slot_index""")


@query("dense_halfhours", "date:s slot_index:i slot_label:s points:i active_flights:i share_of_day:f", "SELECT * FROM dense_slots")
def dense_halfhours(i):
    """A23."""
    return temporal.dense_slots(i.events, 30)


@query("activity_bands", "slot_index:i slot_label:s q25:f q75:f",
       "SELECT slot_index, slot_label, quantile_cont(active_flights, 0.25) AS q25, quantile_cont(active_flights, 0.75) AS q75 FROM dense_slots GROUP BY 1, 2")
def activity_bands(i):
    """A31."""
    return temporal.activity_bands(i.events)


@query("altitude_histogram", "bin_index:i bin_start_m:i bin_end_m:i n:i share_of_points:f",
       """SELECT b.bin_index, b.bin_index*20 AS bin_start_m, b.bin_index*20+20 AS bin_end_m, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE/(SELECT count(*) FROM telemetry) AS share_of_points
       FROM (SELECT unnest(range(20)) AS bin_index) b LEFT JOIN (SELECT least(19, floor(altitude/20.0::DOUBLE))::INT AS bin_index, count(*) AS n FROM telemetry GROUP BY 1) USING (bin_index)""")
def altitude_histogram(i):
    """A27."""
    return temporal.altitude_histogram(i.telemetry)


@query("altitude_summary", "n:i mean:f min:f max:f share_lt_60m:f share_60_120m:f share_120_180m:f share_180_240m:f share_ge_240m:f median:f p25:f p75:f p90:f p95:f p99:f",
       "SELECT count(*) AS n, avg(altitude) AS mean, min(altitude) AS min, max(altitude) AS max, avg((altitude < 60)::INT) AS share_lt_60m, "
       + ", ".join(f"avg((altitude >= {lo} AND altitude < {lo + 60})::INT) AS share_{lo}_{lo + 60}m" for lo in (60, 120, 180))
       + ", avg((altitude >= 240)::INT) AS share_ge_240m, "
       + ", ".join(f"quantile_cont(altitude, {p}) AS {n}" for n, p in (("median", .5), ("p25", .25), ("p75", .75), ("p90", .9), ("p95", .95), ("p99", .99)))
       + " FROM telemetry")
def altitude_summary(i):
    """A28."""
    return temporal.altitude_summary(i.telemetry)


def bands_sql(source: str, day: str, index: str, bins: int) -> str:
    return f"""SELECT bin, avg(share) AS mean_share, quantile_cont(share, 0.25) AS q25_share, quantile_cont(share, 0.75) AS q75_share FROM (
      SELECT b.bin, coalesce(n, 0)*100.0::DOUBLE/total AS share FROM (SELECT {day} AS day, count(*) AS total FROM {source} WHERE ({index}) IS NOT NULL GROUP BY 1) d,
      (SELECT unnest(range({bins})) AS bin) b LEFT JOIN (SELECT {day} AS day, ({index}) AS bin, count(*) AS n FROM {source} GROUP BY 1, 2) c ON c.day = d.day AND c.bin = b.bin) GROUP BY bin"""


def edge_sql(value: str, edges) -> str:
    whens = " ".join(f"WHEN {value} < {hi} THEN {k}" for k, hi in enumerate(edges[1:]))
    return f"CASE WHEN {value} < {edges[0]} THEN {len(edges) - 2} {whens} ELSE {len(edges) - 2} END"


BANDS = "bin:i mean_share:f q25_share:f q75_share:f"


@query("altitude_daily_bands", BANDS,
       bands_sql("telemetry", "datetime::date", "CASE WHEN altitude >= 0 AND altitude < 400 THEN floor(altitude/20.0::DOUBLE)::INT WHEN altitude = 400 THEN 19 END", 20))
def altitude_daily_bands(i):
    """Altitude (values above the last edge are dropped)."""
    index = temporal.edge_bin(F.col("altitude"), tuple(range(0, 401, 20)), overflow_last=False)
    return temporal.daily_share_bands(i.telemetry, F.to_date("datetime"), index, 20)


@query("length_daily_bands", BANDS, bands_sql("trips", "start_time::date", edge_sql("path_length_km", LENGTH_EDGES_KM), 10))
def length_daily_bands(i):
    """Path length (overflow goes to the last bin)."""
    index = temporal.edge_bin(F.col("path_length_km"), LENGTH_EDGES_KM, overflow_last=True)
    return temporal.daily_share_bands(trips_of(i), F.to_date("start_time"), index, 10)


@query("duration_daily_bands", BANDS, bands_sql("trips", "start_time::date", edge_sql("duration_minutes", DURATION_EDGES_MIN), 8))
def duration_daily_bands(i):
    """Duration."""
    index = temporal.edge_bin(F.col("duration_minutes"), DURATION_EDGES_MIN, overflow_last=True)
    return temporal.daily_share_bands(trips_of(i), F.to_date("start_time"), index, 8)


# ------------------------------------------------------------- visits and flow
q.view("visits", """SELECT * FROM (SELECT *, lag(row) OVER o AS p_row, lag(col) OVER o AS p_col FROM points
  WINDOW o AS (PARTITION BY order_id ORDER BY datetime, longitude, latitude, speed, altitude)) WHERE p_row IS NULL OR p_row <> row OR p_col <> col""")
q.view("visit_seq", """SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY datetime, longitude, latitude, speed, altitude) AS seq_index FROM visits""")


@query("cell_visits", "order_id:s seq_index:i row:i col:i datetime:t", "SELECT * FROM visit_seq")
def cell_visits(i):
    """W5."""
    return sequences.with_visit_index(sequences.compress_visits(i.points))


@query("cell_entries", "row:i col:i window_start:t flow_entries:i",
       "SELECT row, col, window_start, count(DISTINCT order_id) AS flow_entries FROM visits GROUP BY row, col, window_start")
def cell_entries(i):
    """W6."""
    return flow.entries(i.points, WINDOW)


q.view("oper", f"""SELECT f.row, f.col, f.window_start, n_unique AS density_unique_flights, mean_speed AS speed_mean, n_points, coalesce(flow_entries, 0) AS flow_entries,
  coalesce(flow_entries, 0)*{3600.0 / WINDOW.seconds}::DOUBLE AS flow_entries_per_hour, 100.0::DOUBLE/greatest(n_unique, 1) AS spacing_surrogate_m
  FROM flight_cw f LEFT JOIN (SELECT row, col, window_start, count(DISTINCT order_id) AS flow_entries FROM visits GROUP BY ALL) USING (row, col, window_start)
  WHERE n_unique > 0 AND mean_speed > 0""")


@query("operational_table", "row:i col:i window_start:t density_unique_flights:i speed_mean:f n_points:i flow_entries:i flow_entries_per_hour:f spacing_surrogate_m:f",
       "SELECT * FROM oper")
def operational_table(i):
    """C21, J4, P19."""
    return flow.operational_table(i.points, WINDOW)


_REL = "sample_count:i x_mean:f y_mean:f y_median:f y_q25:f y_q75:f"


def relation_sql(name, x, y, width, origin="0", extra="", where=""):
    return (f"SELECT {extra}'{name}' AS relation, floor(({x} - {origin})/{width}::DOUBLE) AS bin, count({y}) AS sample_count, avg({x}) AS x_mean, avg({y}) AS y_mean,"
            f" quantile_cont({y}, 0.5) AS y_median, quantile_cont({y}, 0.25) AS y_q25, quantile_cont({y}, 0.75) AS y_q75 FROM oper_near {where} GROUP BY ALL HAVING count({y}) >= 30")


q.view("oper_near", """SELECT o.*, b.row IS NOT NULL AS near FROM oper o LEFT JOIN hub_buffer1 b ON o.row = b.row AND o.col = b.col""")


@query("binned_relations", "relation:s bin:i " + _REL,
       " UNION ALL ".join([relation_sql("v_k", "density_unique_flights", "speed_mean", 1.0), relation_sql("q_k", "density_unique_flights", "flow_entries_per_hour", 1.0),
                           relation_sql("q_v", "speed_mean", "flow_entries_per_hour", 0.5)]))
def binned_relations(i):
    """A8."""
    return flow.zero_based_relations(flow.operational_table(i.points, WINDOW))


_ANCHORED = [("speed_vs_density", "density_unique_flights", "speed_mean", 1.0), ("speed_vs_flow", "flow_entries_per_hour", "speed_mean", 6.0),
             ("flow_vs_density", "density_unique_flights", "flow_entries_per_hour", 1.0), ("speed_vs_spacing", "spacing_surrogate_m", "speed_mean", 4.0)]


@query("anchored_relations", "subset:s relation:s bin:i " + _REL,
       " UNION ALL ".join(relation_sql(n, x, y, w, f"(SELECT min({x}) FROM oper_near {wh})", f"'{s}' AS subset, ", wh)
                          for n, x, y, w in _ANCHORED for s, wh in (("all_windows", ""), ("away_from_endpoint", "WHERE NOT near"))))
def anchored_relations(i):
    """A9."""
    buffer = buffers.buffer_cells(hub_cells_of(i), 1, grid=GRID, edge="clamp")
    return flow.anchored_relations(flow.operational_table(i.points, WINDOW), buffer)


@query("speed_by_phase", "phase:s dist_bin:s n:i mean_speed:f median_speed:f5",
       """SELECT CASE WHEN b.row IS NOT NULL THEN 'Endpoint-adjacent' ELSE 'Away from endpoint' END AS phase, dist_bin, count(*) AS n,
       avg(speed) AS mean_speed, quantile_cont(speed, 0.5) AS median_speed FROM points p JOIN trips_binned t USING (order_id)
       LEFT JOIN hub_buffer1 b ON p.row = b.row AND p.col = b.col WHERE dist_bin IS NOT NULL GROUP BY 1, 2""")
def speed_by_phase(i):
    """C22, J7, P23."""
    buffer = buffers.buffer_cells(hub_cells_of(i), 1, grid=GRID, edge="clamp")
    return flow.speed_by_phase_summary(i.points, trips_of(i), buffer)


@query("hub_membership", "row:i col:i near:b",
       "SELECT c.row, c.col, b.row IS NOT NULL AS near FROM cells c LEFT JOIN hub_cells b ON c.row = b.row AND c.col = b.col")
def hub_membership(i):
    """Membership flag."""
    return in_set(i.points.select("row", "col").distinct(), hub_cells_of(i), "near")
