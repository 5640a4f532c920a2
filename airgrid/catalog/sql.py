"""SQL building blocks for the oracle twins: named views composed on demand."""

from __future__ import annotations

import re

from airgrid.catalog.inputs import GRID, WINDOW
from airgrid.spec import FINE_GRID, FINE_WINDOW, GridSpec

VIEWS: dict[str, str] = {}


def view(name: str, text: str) -> str:
    assert name not in VIEWS, name
    VIEWS[name] = text
    return name


def compose(body: str) -> str:
    """Prefix ``body`` with the WITH clauses it needs, in dependency order."""
    ordered: list[str] = []
    active: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if word in VIEWS and word not in ordered and word not in active:
                active.add(word)
                visit(VIEWS[word])
                ordered.append(word)

    visit(body)
    if not ordered:
        return body
    parts = [f"{name} AS {'' if 'UNION SELECT r.' in VIEWS[name] else 'MATERIALIZED '}({VIEWS[name]})" for name in ordered]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def num(value: float) -> str:
    return f"{value!r}::DOUBLE"


def row_of(lat: str, grid: GridSpec) -> str:
    return (f"greatest(0, least({grid.n_rows - 1}, CAST(floor(({lat} - {num(grid.min_lat)}) * {num(grid.m_lat)}"
            f" / {num(float(grid.size_m))}) AS INTEGER)))")


def col_of(lon: str, grid: GridSpec) -> str:
    return (f"greatest(0, least({grid.n_cols - 1}, CAST(floor(({lon} - {num(grid.min_lon)}) * {num(grid.m_lon)}"
            f" / {num(float(grid.size_m))}) AS INTEGER)))")


def window_of(ts: str, seconds: int) -> str:
    return f"time_bucket(to_seconds({seconds}), {ts})"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2.0*6371008.8 * asin(sqrt(power(sin(radians({lat2}-{lat1})/2.0),2)"
            f" + cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lon2}-{lon1})/2.0),2))))")


def rr_columns(extra: str = "") -> str:
    """Risk measures from columns a, b, c, d (same names as the Spark functions)."""
    return f"""a, b, c, d,
      CASE WHEN a+b > 0 THEN a::DOUBLE/(a+b) END AS risk_exposed,
      CASE WHEN c+d > 0 THEN c::DOUBLE/(c+d) END AS risk_unexposed,
      CASE WHEN a>0 AND c>0 THEN (a::DOUBLE/(a+b))/(c::DOUBLE/(c+d)) END AS rr,
      CASE WHEN a>0 AND c>0 THEN exp(ln((a::DOUBLE/(a+b))/(c::DOUBLE/(c+d))) - 1.96*sqrt(1.0/a::DOUBLE-1.0/(a+b)::DOUBLE+1.0/c::DOUBLE-1.0/(c+d)::DOUBLE)) END AS rr_lo,
      CASE WHEN a>0 AND c>0 THEN exp(ln((a::DOUBLE/(a+b))/(c::DOUBLE/(c+d))) + 1.96*sqrt(1.0/a::DOUBLE-1.0/(a+b)::DOUBLE+1.0/c::DOUBLE-1.0/(c+d)::DOUBLE)) END AS rr_hi,
      ((a+0.5::DOUBLE)*(d+0.5::DOUBLE))/((b+0.5::DOUBLE)*(c+0.5::DOUBLE)) AS odds_ratio,
      exp(ln(((a+0.5::DOUBLE)*(d+0.5::DOUBLE))/((b+0.5::DOUBLE)*(c+0.5::DOUBLE))) - 1.96*sqrt(1/(a+0.5::DOUBLE)+1/(b+0.5::DOUBLE)+1/(c+0.5::DOUBLE)+1/(d+0.5::DOUBLE))) AS or_lo,
      exp(ln(((a+0.5::DOUBLE)*(d+0.5::DOUBLE))/((b+0.5::DOUBLE)*(c+0.5::DOUBLE))) + 1.96*sqrt(1/(a+0.5::DOUBLE)+1/(b+0.5::DOUBLE)+1/(c+0.5::DOUBLE)+1/(d+0.5::DOUBLE))) AS or_hi{extra}"""


RR_SPEC = "a:i b:i c:i d:i risk_exposed:f risk_unexposed:f rr:f4 rr_lo:f4 rr_hi:f4 odds_ratio:f4 or_lo:f4 or_hi:f4"

ABCD = ("count(*) FILTER (exposed AND outcome) AS a, count(*) FILTER (exposed AND NOT outcome) AS b,"
        " count(*) FILTER (NOT exposed AND outcome) AS c, count(*) FILTER (NOT exposed AND NOT outcome) AS d")


def components_view(name: str, nodes: str, edges: str) -> str:
    """Views ``name`` (g, node, label) from nodes (g, node) and directed edges (g, s, d), by reachability."""
    view(f"{name}_reach", f"SELECT g, node, node AS label FROM ({nodes}) UNION SELECT r.g, e.d AS node, r.label FROM {name}_reach r JOIN ({edges}) e ON e.g = r.g AND e.s = r.node")
    return view(name, f"SELECT g, node, min(label) AS label FROM {name}_reach GROUP BY g, node")


def betweenness_view(name: str, edges: str, nodes: str, rounds: int = 16) -> str:
    """View ``name`` (g, node, bc): pair dependencies from distances and path counts, rounds written out.

    ``edges`` are undirected (g, src, dst, cost); shortest paths may have up to ``rounds`` steps.
    """
    view(f"{name}_sym", f"SELECT g, src AS s, dst AS d, cost FROM ({edges}) UNION ALL SELECT g, dst, src, cost FROM ({edges})")
    view(f"{name}_d0", f"SELECT g, node AS s, node AS v, 0.0::DOUBLE AS dist FROM ({nodes})")
    view(f"{name}_w0", f"SELECT g, node AS s, node AS v, 1.0::DOUBLE AS x FROM ({nodes})")
    for k in range(1, rounds + 1):
        before = f"{name}_d{k - 1}"
        view(f"{name}_d{k}", f"SELECT g, s, v, min(dist) AS dist FROM (SELECT * FROM {before} UNION ALL SELECT z.g, z.s, e.d, z.dist + e.cost FROM {before} z"
             f" JOIN {name}_sym e ON e.g = z.g AND e.s = z.v) GROUP BY g, s, v")
    last = f"{name}_d{rounds}"
    view(f"{name}_dag", f"SELECT z.g, z.s, z.v AS u, e.d AS v FROM {last} z JOIN {name}_sym e ON e.g = z.g AND e.s = z.v JOIN {last} b ON b.g = z.g AND b.s = z.s AND b.v = e.d"
         " WHERE abs(z.dist + e.cost - b.dist) <= 1e-12 AND e.d <> z.s")
    for k in range(1, rounds + 1):
        view(f"{name}_w{k}", f"SELECT w.g, w.s, k.v, sum(w.x) AS x FROM {name}_w{k - 1} w JOIN {name}_dag k ON k.g = w.g AND k.s = w.s AND k.u = w.v GROUP BY w.g, w.s, k.v")
    waves = " UNION ALL ".join(f"SELECT * FROM {name}_w{k}" for k in range(rounds + 1))
    view(f"{name}_sp", f"SELECT * FROM (SELECT g, s, v, sum(x) AS x FROM ({waves}) GROUP BY g, s, v) JOIN {last} USING (g, s, v)")
    return view(name, f"""SELECT n.g, n.node, coalesce(t.bc, 0) AS bc FROM ({nodes}) n LEFT JOIN (
      SELECT a.g, a.v AS node, sum(a.x*b.x/c.x)/2 AS bc FROM {name}_sp a JOIN {name}_sp b ON b.g = a.g AND b.s = a.v JOIN {name}_sp c ON c.g = a.g AND c.s = a.s AND c.v = b.v
      WHERE a.s <> a.v AND b.s <> b.v AND a.s <> b.v AND abs(a.dist + b.dist - c.dist) <= 1e-9 GROUP BY 1, 2) t ON t.g = n.g AND t.node = n.node""")


def curve_sql(windows: str, by: str = "", width: int = 1, min_samples: int = 10, density: str = "n_points",
              center: str = "mid") -> str:
    g = f"{by}, " if by else ""
    low = f"floor({density}/{width}.0)*{width}"
    c = f"{low} + {width / 2.0}" if center == "mid" else f"avg({density})"
    return (f"SELECT {g}{low} AS density_min, count(*) AS sample_count, avg({density}) AS density_mean,"
            f" avg(mean_speed) AS speed_mean, ({c})::DOUBLE AS density_center FROM {windows}"
            f" WHERE {density} > 0 AND mean_speed > 0 GROUP BY {g}{low} HAVING count(*) >= {min_samples}")


def scan_sql(curve: str, by: str = "", weight: str = "1.0", max_split: int | None = None) -> str:
    """All splits with RSS by prefix sums, columns like the Spark scan."""
    p = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    keys = ["w", "x", "y", "xx", "xy", "yy"]
    expr = {"w": "w_", "x": "w_*x_", "y": "w_*y_", "xx": "w_*x_*x_", "xy": "w_*x_*y_", "yy": "w_*y_*y_"}
    sums = ", ".join(
        f"sum({expr[k]}) OVER ({p} ORDER BY density_center ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l{k},"
        f" sum({expr[k]}) OVER ({p}) AS t{k}" for k in keys)

    def rss(side):
        s = (lambda k: f"l{k}") if side == "l" else (lambda k: f"(t{k}-l{k})")
        return (f"greatest(0.0, ({s('yy')}-{s('y')}*{s('y')}/{s('w')}) - power({s('xy')}-{s('x')}*{s('y')}/{s('w')},2)"
                f"/({s('xx')}-{s('x')}*{s('x')}/{s('w')}))")

    def slope(side):
        s = (lambda k: f"l{k}") if side == "l" else (lambda k: f"(t{k}-l{k})")
        return f"(({s('xy')}-{s('x')}*{s('y')}/{s('w')})/({s('xx')}-{s('x')}*{s('x')}/{s('w')}))"

    upper = "n_bins-6" if max_split is None else f"least(n_bins-5, {max_split})-1"
    valid = f"split >= 3 AND split <= {upper} AND n_bins-split >= 3"
    return f"""SELECT *, ({valid}) AS valid,
        CASE WHEN {valid} THEN {rss('l')} + {rss('r')} END AS rss,
        CASE WHEN {valid} THEN {slope('l')} END AS slope_left, CASE WHEN {valid} THEN {slope('r')} END AS slope_right
      FROM (SELECT *, {sums} FROM (
        SELECT {g}density_center, speed_mean, sample_count,
          row_number() OVER ({p} ORDER BY density_center) - 1 AS split, count(*) OVER ({p}) AS n_bins,
          lag(speed_mean) OVER ({p} ORDER BY density_center) AS speed_before,
          ({weight})::DOUBLE AS w_, density_center - avg(density_center) OVER ({p}) AS x_,
          speed_mean - avg(speed_mean) OVER ({p}) AS y_ FROM ({curve})))"""


def piecewise_sql(curve: str, by: str = "", weight: str = "1.0", fallback: bool = True, max_split: int | None = None) -> str:
    g = f"{by}, " if by else ""
    p = f"PARTITION BY {by}" if by else ""
    fb = "" if fallback else " WHERE b_valid"
    grp = f"GROUP BY {by}" if by else ""
    hav = "" if fallback else "HAVING max(b_rss) IS NOT NULL"
    return f"""SELECT *, CASE WHEN speed_free > 0 THEN (speed_free-speed_congested)/speed_free*100 END AS speed_drop_percent,
        CASE WHEN speed_before > 0 THEN (speed_before-speed_after)/speed_before*100 END AS jump_percent FROM (
      SELECT {g}max(density_center) FILTER (split = b_split) AS rho_star,
        avg(speed_mean) FILTER (split < b_split) AS speed_free, avg(speed_mean) FILTER (split >= b_split) AS speed_congested,
        max(b_rss) AS objective, max(n_bins) AS n_bins,
        max(slope_left) FILTER (split = b_split) AS slope_left, max(slope_right) FILTER (split = b_split) AS slope_right,
        max(speed_before) FILTER (split = b_split) AS speed_before, max(speed_mean) FILTER (split = b_split) AS speed_after
      FROM (SELECT *, coalesce(first_split, n_bins // 2) AS b_split FROM (
        SELECT *, min(split) FILTER (rss = b_rss) OVER ({p}) AS first_split FROM (
          SELECT *, min(rss) OVER ({p}) AS b_rss FROM ({scan_sql(curve, by, weight, max_split)})))) {grp} {hav})"""


def top_fraction_sql(cells: str, measure: str, fraction: str, by: str = "", ties: str = "row, col") -> str:
    p = f"PARTITION BY {by}" if by else ""
    return (f"SELECT * FROM (SELECT *, row_number() OVER ({p} ORDER BY {measure} DESC, {ties}) AS rk,"
            f" count(*) OVER ({p}) AS nn FROM ({cells})) WHERE rk <= greatest(1, floor(nn*{fraction}))")


def summary_sql(windows: str, by: str = "", backbone: str | None = None, rho: str | None = None) -> str:
    """Subset summary: counts, breakpoint, 2x2 table and risk measures per group."""
    g = f"{by}, " if by else ""
    join_by = (lambda l, r: " AND ".join([f"{l}.{k.strip()} = {r}.{k.strip()}" for k in by.split(",")] if by else ["true"]))
    grp = f"GROUP BY {by}" if by else ""
    cells = f"SELECT {g}row, col, sum(n_points) AS total_points FROM ({windows}) GROUP BY {g}row, col"
    bb = backbone or top_fraction_sql(cells, "total_points", "0.10::DOUBLE", by)
    bb_keys = f"{g}row, col" if backbone is None else "row, col"
    bb_join = ("w.row = k.row AND w.col = k.col" + (f" AND {join_by('w', 'k')}" if by and backbone is None else ""))
    if rho is None:
        pw = piecewise_sql(curve_sql(f"({windows})", by), by)
        bp = f"SELECT {g}rho_star, speed_free AS sf, speed_congested AS sc FROM ({pw})"
    else:
        bp = (f"SELECT DISTINCT {g}{rho} AS rho_star, NULL::DOUBLE AS sf, NULL::DOUBLE AS sc FROM ({windows})")
    bb_count = (f"SELECT {g}count(*) AS backbone_cells FROM ({bb}) {grp}" if backbone is None
                else f"SELECT DISTINCT {g}(SELECT count(*) FROM ({bb})) AS backbone_cells FROM ({windows})")
    measures = rr_columns(""", samples, active_cells, rho_star,
        speed_free, speed_congested, CASE WHEN speed_free > 0 THEN (speed_free-speed_congested)/speed_free*100 END AS speed_drop_percent,
        (a+c)::DOUBLE/samples*100 AS congestion_share_percent""")
    return f"""SELECT z.*, bc.backbone_cells FROM (SELECT {g}{measures} FROM (
      SELECT {g}count(*) AS samples, count(DISTINCT (row, col)) AS active_cells, max(rho_star) AS rho_star,
        coalesce(max(sf), avg(mean_speed) FILTER (NOT outcome)) AS speed_free,
        coalesce(max(sc), avg(mean_speed) FILTER (outcome)) AS speed_congested, {ABCD}
      FROM (SELECT w.*, k.row IS NOT NULL AS exposed, w.n_points >= b.rho_star AS outcome, b.rho_star, b.sf, b.sc
        FROM ({windows}) w JOIN ({bp}) b ON {join_by('w', 'b')}
        LEFT JOIN (SELECT DISTINCT {bb_keys} FROM ({bb})) k ON {bb_join}) {grp})) z
      JOIN ({bb_count}) bc ON {join_by('z', 'bc')}"""


SUMMARY_SPEC = ("samples:i active_cells:i backbone_cells:i rho_star:f speed_free:f speed_congested:f "
                "speed_drop_percent:f congestion_share_percent:f " + RR_SPEC)

# --------------------------------------------------------------------------
# input views
# --------------------------------------------------------------------------
_X = "cast(l_partkey % 100 as double)/100.0::double"
_Y = "cast(l_suppkey % 50 as double)/50.0::double"
_SEC = "(l_orderkey % 22)*86400 + 28800 + (l_orderkey*37) % 28800 + l_linenumber*60 + l_partkey % 60"
_LON, _LAT = "113.90::double + 0.05::double*x*x*x", "22.60::double + 0.05::double*y*y"
_SPEED = "least(40.0::double, l_quantity*0.8::double*sqrt((x*x*x + y*y)/2.0::double))"
_ALT = "l_extendedprice - 500.0::double*floor(l_extendedprice/500.0::double)"
_YAW = "cast((l_suppkey*7 + l_linenumber*13) % 360 as double)"
_TS = "timestamp '2023-10-01 00:00:00' + to_seconds(sec::bigint)"
_BASE = f"SELECT *, {_X} AS x, {_Y} AS y, {_SEC} AS sec FROM lineitem"

view("telemetry", f"""SELECT cast(l_orderkey as varchar) AS order_id, {_TS} AS datetime, {_LON} AS longitude,
  {_LAT} AS latitude, {_SPEED} AS speed, {_ALT} AS altitude, {_YAW} AS yaw,
  CASE WHEN l_orderkey % 3 = 0 THEN 'SF' ELSE 'MT' END AS vendor FROM ({_BASE})""")

view("raw_telemetry", f"""SELECT CASE WHEN keep THEN order_id END AS order_id, CASE WHEN keep THEN sn END AS sn,
  CASE WHEN keep THEN vendor END AS vendor, CASE WHEN keep THEN time_ END AS time, CASE WHEN keep THEN speed END AS speed,
  CASE WHEN keep THEN altitude END AS altitude, CASE WHEN keep THEN yaw END AS yaw, CASE WHEN keep THEN flight_time END AS flight_time,
  CASE WHEN keep THEN longitude END AS longitude, CASE WHEN keep THEN latitude END AS latitude FROM (
  SELECT k % 109 <> 0 AS keep, k::varchar AS order_id, 'sn' || (k % 40)::varchar AS sn, CASE WHEN k % 3 = 0 THEN 'SF' ELSE 'MT' END AS vendor,
  CASE WHEN k % 107 = 0 THEN '20231345000000' ELSE strftime({_TS}, '%Y%m%d%H%M%S') || CASE WHEN k % 5 = 0 THEN '.0' ELSE '' END END AS time_,
  (CASE WHEN k % 97 = 0 THEN -1.0::double ELSE {_SPEED} END)::varchar AS speed,
  CASE WHEN k % 103 = 0 THEN 'n/a' ELSE ({_ALT})::varchar END AS altitude,
  (CASE WHEN k % 101 = 0 THEN 999.0::double ELSE {_YAW} END)::varchar AS yaw,
  (l_linenumber*60 - CASE WHEN k % 113 = 0 THEN 1000 ELSE 0 END)::varchar AS flight_time,
  ({_LON} + CASE WHEN k % 127 = 0 THEN 5.0::double ELSE 0.0::double END)::varchar AS longitude, ({_LAT})::varchar AS latitude
  FROM (SELECT *, l_orderkey AS k FROM ({_BASE})))""")

view("event_points", "SELECT user_id::varchar AS order_id, ts AS datetime, value FROM events")

view("sites", f"""SELECT s_name AS site_name, 'platform' || (s_nationkey % 2)::varchar AS platform,
  CASE WHEN s_suppkey % 10 = 0 THEN 'other' ELSE 'main' END AS city, CASE WHEN s_suppkey % 17 = 0 THEN 'test pad 试飞 é' END AS note,
  '2023-0' || (1 + s_suppkey % 9)::varchar AS open_time,
  CASE WHEN s_suppkey % 23 = 0 THEN 'unknown' ELSE ({_LON})::varchar END AS lon, ({_LAT})::varchar AS lat
  FROM (SELECT *, cast((s_suppkey*7) % 100 as double)/100.0::double AS x, cast(s_suppkey % 50 as double)/50.0::double AS y FROM supplier)""")

view("buildings", """SELECT p_partkey AS building_id, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE 5.0::double + 2.0::double*p_size END AS building_height_m,
  113.9003::double + 0.05::double*x*x*x AS lon, 22.6002::double + 0.05::double*y*y AS lat
  FROM (SELECT *, cast(p_partkey % 100 as double)/100.0::double AS x, cast((p_partkey*3) % 50 as double)/50.0::double AS y FROM part)""")

for _name, _grid, _win in (("", GRID, WINDOW), ("fine_", FINE_GRID, FINE_WINDOW)):
    view(f"{_name}points", f"SELECT *, {row_of('latitude', _grid)} AS row, {col_of('longitude', _grid)} AS col,"
         f" {window_of('datetime', _win.seconds)} AS window_start FROM telemetry")
    view(f"{_name}windows", f"""SELECT row, col, window_start, count(*) AS n_points, avg(speed) AS mean_speed, stddev_samp(speed) AS std_speed,
      min(speed) AS min_speed, max(speed) AS max_speed, avg(altitude) AS mean_altitude FROM {_name}points GROUP BY row, col, window_start""")
    view(f"{_name}cells", f"""SELECT row, col, count(*) AS total_points, avg(speed) AS avg_speed, stddev_samp(speed) AS std_speed,
      avg(altitude) AS avg_altitude, stddev_samp(altitude) AS std_altitude, min(datetime) AS first_seen, max(datetime) AS last_seen,
      count(DISTINCT hour(datetime)) AS active_hours, count(DISTINCT datetime::date) AS active_days
      FROM {_name}points GROUP BY row, col""")

view("backbone", top_fraction_sql("SELECT * FROM cells", "total_points", "0.10::DOUBLE"))
view("curve", curve_sql("windows"))
view("main_break", piecewise_sql("SELECT * FROM curve"))
view("flight_cw", "SELECT row, col, window_start, count(DISTINCT order_id) AS n_unique, avg(speed) AS mean_speed, count(*) AS n_points"
     " FROM points GROUP BY row, col, window_start")
