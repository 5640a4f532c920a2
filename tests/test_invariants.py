"""Properties that hold on any data, skewed data included."""

import random

import pytest
from pyspark.sql import functions as F

from airgrid.catalog import QUERIES
from airgrid.catalog.inputs import GRID, WINDOW, Inputs
from airgrid.functions.geo import with_cell
from airgrid.operators import cells as cells_op
from airgrid.operators.sequences import compress_visits
from airgrid.operators.trips import trip_lengths
from airgrid.plans import core, resampling as rs, robustness as rb, sites
from airgrid.plans.folds import summarize_folds
from airgrid.plans.summary import negated, summarize
from airgrid.session import materialize


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return Inputs(spark, sf_dir)


def close(a, b):
    for k, v in a.asDict().items():
        assert b[k] == (pytest.approx(v) if isinstance(v, float) else v), k


def test_totals(inputs):
    n = inputs.telemetry.count()
    assert inputs.windows.agg(F.sum("n_points")).first()[0] == n
    assert inputs.occ.agg(F.sum(F.col("n_points") * F.col("windows"))).first()[0] == n
    s = summarize(inputs.occ).first()
    assert s.a + s.b + s.c + s.d == s.samples == inputs.windows.count()
    ranked = core.ranked_cells(cells_op.traffic(inputs.occ))
    assert ranked.agg(F.max("cumulative_share")).first()[0] == pytest.approx(1)


def test_removing_nothing_changes_nothing(spark, inputs):
    nothing = negated(inputs.occ.limit(0)).withColumn("fold", F.lit("x"))
    folds = summarize_folds(inputs.occ, nothing, spark.createDataFrame([("x",)], "fold string"), "fold")
    close(summarize(inputs.occ).first(), folds.drop("fold").first())


def test_folds_equal_one_by_one_summaries(spark, inputs):
    """Folds without some cells, down to a fold that loses most of the backbone, against a summary of what each leaves; ten times as
    many folds of the same cells give the same rows."""
    occ = materialize(inputs.occ)
    cells = [(r.row, r.col) for r in core.ranked_cells(cells_op.traffic(occ)).orderBy("rank").collect()]
    taken = {"first": cells[:1], "busiest": cells[:len(cells) // 9], "second": cells[1::2], "quiet": cells[-len(cells) // 3:], "none": [], "all": cells}
    groups = spark.createDataFrame([(f"{k}{i}", *c) for k, v in taken.items() for c in v for i in range(10)], "fold string, row int, col int")
    names = spark.createDataFrame([(f"{k}{i}",) for k in taken for i in range(10)], "fold string")
    deltas = negated(occ.join(groups, ["row", "col"]).select("fold", "row", "col", "n_points", *cells_op.OCCUPANCY_SUMS))
    got = {r.fold: r for r in summarize_folds(occ, deltas, names, "fold").collect()}
    assert len(got) == 10 * (len(taken) - 1)
    for k, v in taken.items():
        if k != "all":
            gone = spark.createDataFrame(v or [(-9, -9)], "row int, col int")
            want = summarize(occ.join(gone, ["row", "col"], "left_anti")).first()
            for i in range(10):
                close(want, got[f"{k}{i}"])


def test_leave_out_equals_recomputation(inputs):
    fold = rb.leave_one_group_out(cells_op.contributions(inputs.points, WINDOW, "vendor"), "vendor").where("vendor = 'SF'").first()
    again = summarize(cells_op.occupancy(cells_op.cell_windows(inputs.points.where("vendor <> 'SF'"), WINDOW))).first()
    for k in ("samples", "rho_star", "a", "b", "c", "d", "speed_free"):
        assert fold[k] == pytest.approx(again[k])


def test_compositions_equal_direct_bootstrap(spark, inputs):
    """The composition shortcut gives every iteration the same table as resampling all windows."""
    parts = materialize(cells_op.contributions(inputs.points.withColumn(
        "g", F.concat_ws("_", "vendor", F.to_date("datetime").cast("string"))), WINDOW, "g"))
    backbone = materialize(core.backbone_cells(inputs.occ))
    fast = {r.iter: (r.a, r.b, r.c, r.d) for r in rs.cluster_bootstrap(parts, "g", backbone, F.lit(3.0), 5, 7).collect()}
    import hashlib
    groups = sorted((r[0] for r in parts.select("g").distinct().collect()), key=lambda g: (hashlib.md5(g.encode()).hexdigest()[:2], g))
    data, inside = parts.collect(), {(r.row, r.col) for r in backbone.collect()}
    for it in range(5):
        weight = dict.fromkeys(groups, 0)
        for j in range(len(groups)):
            weight[groups[int(hashlib.md5(f"7|{it}|{j}".encode()).hexdigest()[:15], 16) % len(groups)]] += 1
        density = {}
        for r in data:
            if weight[r.g]:
                key = (r.row, r.col, r.window_start)
                density[key] = density.get(key, 0) + weight[r.g] * r.n_points
        cells = [0, 0, 0, 0]
        for (row, col, _), n in density.items():
            cells[(0 if (row, col) in inside else 2) + (0 if n >= 3.0 else 1)] += 1
        assert fast[it] == tuple(cells)


@pytest.mark.parametrize("name", ["ranked_cells", "backbone_components", "trip_lengths", "random_backbone_null"])
def test_same_result_at_any_partitioning(spark, sf_dir, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            seen.append(sorted(map(str, QUERIES[name](spark, sf_dir).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all points belong to one order that circles for hours, mostly in one cell."""
    rng = random.Random(4)
    data = []
    for k in range(1500):
        hot_one = k % 3 == 0
        order = "hot" if hot_one else f"o{k % 200}"
        lon = 113.9 + (0.0 if rng.random() < 0.6 else rng.random() * 0.03)
        data.append((order, 1696150000 + k * 11, lon, 22.6 + (0.0 if hot_one else rng.random() * 0.02), rng.random() * 20, rng.random() * 300))
    df = spark.createDataFrame(data, "order_id string, t bigint, longitude double, latitude double, speed double, altitude double")
    return materialize(with_cell(df.withColumns({"datetime": F.timestamp_seconds("t"), "vendor": F.lit("MT")}).drop("t"), GRID))


def test_hot_order_is_sliced_without_changing_results(hot):
    for table in (lambda s: compress_visits(hot, slice_s=s).select("order_id", "datetime", "row", "col"),):
        whole = sorted(map(str, table(10 ** 7).collect()))
        assert whole == sorted(map(str, table(600).collect())) == sorted(map(str, table(3600).collect()))


def test_hot_order_path_length(hot):
    from math import asin, cos, radians, sin, sqrt
    pts = sorted((r.datetime, r.longitude, r.latitude) for r in hot.where("order_id = 'hot'").collect())
    total = 0.0
    for (_, lon1, lat1), (_, lon2, lat2) in zip(pts, pts[1:]):
        h = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
        total += 2 * 6371008.8 * asin(sqrt(h))
    got = trip_lengths(hot).where("order_id = 'hot'").first()
    assert got.num_points == len(pts) == 500 and got.path_length_km == pytest.approx(total / 1000)


def test_plans_have_no_cross_join_and_prune_columns(spark, sf_dir):
    for name in ("critical_density", "ranked_cells", "od_pairs", "trip_lengths", "operational_table", "ground_speed_advantage"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["altitude_histogram"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double>" in plan


def test_hubs_of_one_cell_share_a_fold(spark, inputs, monkeypatch):
    """Sites in three cells give three folds; each site has the row of its own leave-out."""
    cells = cells_op.traffic(inputs.occ).orderBy("total_points", "row", "col").tail(3)
    rows = [(f"s{k:03d}", *[(c.row, c.col) for c in cells][k % 3], k / 1000, 1.0, "p", False) for k in range(60)]
    inventory = spark.createDataFrame(rows, "site_name string, row bigint, col bigint, lon double, lat double, platform string, is_test_site boolean")
    asked = []

    def counted(occ, groups, fold):
        asked.append(groups.select(fold).distinct().count())
        return rb.leave_cells_out(occ, groups, fold)

    monkeypatch.setattr(sites, "leave_cells_out", counted)
    got = {r.site_name: r for r in sites.leave_hubs_out(inputs.occ, inventory).collect()}
    want = rb.leave_cells_out(inputs.occ, sites.hub_cells(inventory).where("site_name < 's003'"), "site_name").collect()
    assert asked == [3] and len(got) == 60 and len(want) == 3
    for k in range(60):
        row = got[f"s{k:03d}"].asDict()
        for name, value in want[[r.site_name for r in want].index(f"s{k % 3:03d}")].asDict().items():
            assert name == "site_name" or row[name] == (pytest.approx(value) if isinstance(value, float) else value), name
