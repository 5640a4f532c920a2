"""How often the points move: shared shuffles and tables that are written once."""

import pytest
from pyspark.sql import functions as F

from airgrid.catalog import QUERIES
from airgrid.catalog import routes as g
from airgrid.catalog import trips as t
from airgrid.catalog.inputs import GRID, Inputs
from airgrid.operators import trips
from airgrid.operators.sequences import compress_visits


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return Inputs(spark, sf_dir)


def test_trips_move_the_points_once(inputs):
    """One shuffle of the points, one of what the slices come to."""
    assert plan_of(trips.trip_lengths(inputs.telemetry)).count("Exchange hashpartitioning") == 2


def test_pairs_and_trips_share_one_table(inputs):
    assert "l_orderkey" not in plan_of(t.trips_of(inputs)) and "l_orderkey" not in plan_of(t.od_of(inputs))
    direct = trips.od_pairs(trips.refined_points(inputs.telemetry, GRID.size_m))
    assert sorted(map(str, t.od_of(inputs).select(direct.columns).collect())) == sorted(map(str, direct.collect()))


def test_pairs_with_lengths_need_no_join(inputs):
    """Pair and trip of an order are read off one row; the rows are those of the join by order."""
    got = g.od_trips(inputs)
    assert "Join" not in plan_of(got) and "Exchange hashpartitioning" not in plan_of(got)
    info = t.trips_of(inputs).select("order_id", "path_length_km", "duration_minutes", "od_distance_km")
    joined = t.od_of(inputs).join(info, "order_id").where("duration_minutes > 0 and od_distance_km > 0")
    assert sorted(map(str, got.select(joined.columns).collect())) == sorted(map(str, joined.collect())) != []


def test_pairs_with_lengths_drop_rows_without_order(spark):
    rows = [(o, 1_700_000_000 + 60 * k, 113.9 + k / 100, 22.6 + k / 100, 5.0, 100.0, "MT") for o in ("a", None) for k in range(3)]
    points = spark.createDataFrame(rows, "order_id string, t bigint, longitude double, latitude double, speed double, altitude double, vendor string")
    points = points.withColumn("datetime", F.timestamp_seconds("t")).drop("t")
    got = trips.pairs_with_lengths(trips.order_paths(points), trips.refined_extent(points), 500.0).collect()
    assert [r.order_id for r in got] == ["a"] and got[0].od_distance_km > 0


def test_orders_over_several_slices(spark):
    """Orders that begin, end and pause anywhere: the slices add up to the whole order, in any slicing."""
    rows = [(f"o{k % 7}", 1_700_000_000 + (k * 7919) % 5000, 113.9 + (k * 37 % 100) / 1000, 22.6 + (k * 53 % 100) / 1000, float(k % 9), float(k % 300))
            for k in range(400)]
    points = spark.createDataFrame(rows, "order_id string, t bigint, longitude double, latitude double, speed double, altitude double").withColumns(
        {"datetime": F.timestamp_seconds("t"), "vendor": F.lit("MT")}).drop("t")
    whole, cut = ({r.order_id: r for r in trips.order_paths(points, s).collect()} for s in (10 ** 7, 60))
    assert len(whole) == 7 and sum(r.num_points for r in whole.values()) == 400
    for key, r in whole.items():
        assert (r.num_points, r.vendor, r.s, r.e) == (cut[key].num_points, cut[key].vendor, cut[key].s, cut[key].e)
        assert r.path_m == pytest.approx(cut[key].path_m)


def test_visits_share_the_shuffle_with_the_carried_points(inputs):
    visits = compress_visits(inputs.points).select("order_id", "datetime", "longitude", "latitude", "speed", "altitude", "row", "col", "previous")
    visits.collect()
    assert "ReusedExchange" in plan_of(visits)


@pytest.mark.parametrize("name", ["speed_by_phase", "anchored_relations", "binned_relations"])
def test_summaries_read_a_written_table(spark, sf_dir, name):
    """Means and percentiles of one table read it from disk and don't each derive it from the points."""
    assert "l_orderkey" not in plan_of(QUERIES[name](spark, sf_dir))


def test_paths_are_taken_apart_once_per_path(inputs):
    """Folder, route, file and start time come from a table of paths that the points join, not from every point."""
    from airgrid.plans import followup
    points = followup.normalize_logs(inputs.nav_logs, GRID)
    shuffled = [p for p in points._jdf.queryExecution().optimizedPlan().toString().split("\n") if "as source_folder" in p.lower()]
    assert len(shuffled) == 1 and "l_orderkey" not in shuffled[0]
    assert points.select("flight_id", "source_folder", "file_name").distinct().count() == followup.flight_keys(points).count()


def test_paths_of_one_flight_share_their_start(spark):
    from airgrid.plans import followup
    rows = [("logs/20251001-080000.mat", 5_000_000), ("logs/20251001-080000.txt", 2_000_000), (None, 0), ("logs/20241001-080000.mat", 0)]
    logs = spark.createDataFrame(rows, "path string, logtime bigint").selectExpr(
        "*", "22.6D as lat", "113.9D as lon", "1.0D as vel_x", "1.0D as vel_y", "10.0D as altitude_agl")
    got = followup.normalize_logs(logs, GRID).select("file_name", "elapsed_s").collect()
    assert sorted((r.file_name, r.elapsed_s) for r in got) == [("20251001-080000.mat", 3.0), ("20251001-080000.txt", 0.0)]


def test_years_need_no_percentile_per_flight(spark, sf_dir, monkeypatch):
    from airgrid.plans import followup
    monkeypatch.setattr(followup, "flight_summary", lambda points: pytest.fail("summary of every flight"))
    assert QUERIES["flight_years"](spark, sf_dir).count() > 0


def test_folds_read_written_contributions(spark, sf_dir):
    """Total, deltas, fold names and what is removed come from one written table, not each from the points."""
    assert "l_orderkey" not in plan_of(QUERIES["leave_one_vendor_out"](spark, sf_dir))
