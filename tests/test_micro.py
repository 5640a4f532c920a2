"""Hand-computed answers on tiny tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.functions.risk import fisher_p, incomplete_beta, log_gamma, pearson_p, risk_columns
from airgrid.functions.time import parse_compact, slot_label, strip_fraction, window_start
from airgrid.operators import breakpoints as bp
from airgrid.operators import percentiles
from airgrid.operators.buffers import buffer_cells, cell_degrees, set_overlap
from airgrid.operators.percentiles import exact_percentiles
from airgrid.operators.ranking import gini, global_rank, rank_with_shares, top_fraction, weighted_median
from airgrid.operators.sequences import compress_visits, route_signatures, transitions, with_visit_index
from airgrid.operators.trips import labelled_bin
from airgrid.session import materialize
from airgrid.spec import GridSpec


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def curve(spark, xs, ys, ws=None):
    return spark.createDataFrame([(float(x), float(y), int(w)) for x, y, w in zip(xs, ys, [1] * len(xs) if ws is None else ws)],
                                 "density_center double, speed_mean double, sample_count int")


def polyfit_scan(x, y, w=None):
    """Reference scan with numpy, one split at a time."""
    best, choice = math.inf, len(x) // 2
    for i in range(3, min(len(x) - 5, 50)):
        total = 0.0
        for part in (slice(0, i), slice(i, len(x))):
            wt = None if w is None else np.sqrt(w[part])
            fit = np.polyfit(x[part], y[part], 1, w=wt)
            err = (y[part] - np.polyval(fit, x[part])) ** 2
            total += float(np.sum(err if w is None else err * w[part]))
        if total < best - 1e-12:
            best, choice = total, i
    return x[choice], best


def test_piecewise_finds_exact_kink(spark):
    xs = [i + 0.5 for i in range(14)]
    ys = [20 - x if x < 6 else 8 - 0.1 * x for x in xs]
    row = bp.piecewise(curve(spark, xs, ys)).first()
    assert row.rho_star == 6.5 and row.objective == pytest.approx(0, abs=1e-9)
    assert row.slope_left == pytest.approx(-1) and row.slope_right == pytest.approx(-0.1)


@pytest.mark.parametrize("weighted", [False, True])
def test_piecewise_matches_polyfit(spark, weighted):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.integers(1, 3, 40)) + 0.5
    y = np.where(x < 25, 15 - 0.3 * x, 6 - 0.05 * x) + rng.normal(0, 0.3, 40)
    w = rng.integers(10, 500, 40)
    rho, best = polyfit_scan(x, y, w if weighted else None)
    row = bp.piecewise(curve(spark, x, y, w), weight="sample_count" if weighted else None).first()
    assert row.rho_star == rho and row.objective == pytest.approx(best)


def test_short_curve_uses_middle_bin_or_nothing(spark):
    c = curve(spark, [0.5, 1.5, 2.5, 3.5, 4.5], [5, 4, 3, 2, 1])
    assert bp.piecewise(c).first().rho_star == 2.5
    assert bp.piecewise(c, fallback=False).count() == 0


def test_inflection_equals_numpy_gradient(spark):
    x = np.array([0.5, 1.5, 3.5, 4.5, 7.5, 8.5, 9.5, 11.5, 12.5, 15.5, 16.5, 17.5])
    y = 10 * np.exp(-x / 4) + 0.1 * np.sin(x)
    d2 = np.gradient(np.gradient(y, x), x)[: int(len(x) * 2 / 3)]
    row = bp.inflection(curve(spark, x, y)).first()
    assert row.rho_star == x[int(np.argmax(d2))] and row.curvature == pytest.approx(d2.max())


def test_relative_risk_and_guards(spark):
    t = spark.createDataFrame([(10, 20, 5, 100), (0, 5, 3, 9), (4, 5, 0, 9)], "a int, b int, c int, d int").withColumns(risk_columns())
    full, no_a, no_c = t.orderBy(F.desc("a")).collect()[0], t.where("a = 0").first(), t.where("c = 0").first()
    rr = (10 / 30) / (5 / 105)
    se = math.sqrt(1 / 10 - 1 / 30 + 1 / 5 - 1 / 105)
    assert full.rr == pytest.approx(rr) and full.rr_lo == pytest.approx(math.exp(math.log(rr) - 1.96 * se))
    assert no_a.rr == no_c.rr == math.inf and no_a.rr_lo is None
    assert no_a.odds_ratio == pytest.approx((0.5 * 9.5) / (5.5 * 3.5))


def brute_fisher(a, b, c, d):
    n, k, r = a + b + c + d, a + c, a + b
    p = lambda x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
    return min(1.0, sum(p(x) for x in range(max(0, k + r - n), min(k, r) + 1) if p(x) <= p(a) * (1 + 1e-7)))


def test_fisher_against_enumeration(spark):
    rng = random.Random(3)
    tables = [(3, 1, 1, 3), (0, 5, 3, 9), (10, 20, 5, 100), (7, 0, 0, 6), (2, 2, 2, 2), (400, 900, 350, 1000)] + [tuple(rng.randrange(40) for _ in range(4)) for _ in range(60)]
    tables = [t for t in tables if sum(t)] + [(47894, 677572, 121, 697789), (0, 0, 0, 0)]
    got = spark.createDataFrame(tables, "a long, b long, c long, d long").withColumn("p", fisher_p()).collect()
    for r in got[:-2]:
        assert r.p == pytest.approx(brute_fisher(r.a, r.b, r.c, r.d), rel=1e-6, abs=1e-12), r
    assert 0 <= got[-2].p < 1e-100 and got[-1].p is None


def test_gamma_and_beta(spark):
    rows = spark.range(1, 400).select((F.col("id") / 4).alias("z")).withColumn("g", log_gamma(F.col("z"))).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.z), abs=1e-12, rel=1e-14) for r in rows)
    # two-sided p of t = 2.228 with 10 degrees of freedom is 0.05; I(0.5; 2, 3) = 11/16
    x = spark.range(1).select(incomplete_beta(F.lit(5.0), F.lit(0.5), F.lit(10 / (10 + 2.2281388519649385 ** 2))).alias("t"),
                              incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.5)).alias("b")).first()
    assert x.t == pytest.approx(0.05) and x.b == pytest.approx(11 / 16)
    p = spark.createDataFrame([(0.632, 10), (-1.0, 5), (None, 9), (0.5, 2)], "r double, n long").select(pearson_p("r", "n").alias("p")).collect()
    assert p[0].p == pytest.approx(0.05, abs=2e-4) and [r.p for r in p[1:]] == [0.0, None, None]


@pytest.mark.parametrize("spread", [1.0, 1e-7])
def test_percentiles_of_a_crowded_bin(spark, monkeypatch, spread):
    """Continuous values that fill one lattice bin are found through cells of that bin."""
    monkeypatch.setattr(percentiles, "CROWD", 50)
    rng = random.Random(8)
    data = [(g, 3.0 + spread * rng.random()) for g in "ab" for _ in range(3000)] + [("c", None), ("c", 4.5), ("d", -0.25), ("d", -0.75)]
    probs = {"p": 0.05, "q": 0.5, "r": 0.951}
    got = percentiles.exact_percentiles(spark.createDataFrame(data, "g string, v double").repartition(5), "v", probs, width=10.0, by=["g"]).collect()
    assert len(got) == 4
    for r in got:
        values = sorted(v for g, v in data if g == r.g and v is not None)
        for name, q in probs.items():
            at = (len(values) - 1) * q
            want = values[math.floor(at)] + (values[math.ceil(at)] - values[math.floor(at)]) * (at - math.floor(at))
            assert r[name] == pytest.approx(want, rel=1e-12)


def test_rank_ties_and_cumulative_share(spark):
    cells = spark.createDataFrame([(r, c, n) for r, c, n in [(0, 2, 5), (0, 1, 5), (3, 0, 5), (1, 1, 9), (2, 2, 1)]], "row int, col int, n int")
    got = {(r.row, r.col): (r["rank"], r.cumulative_share) for r in rank_with_shares(cells, "n").collect()}
    assert [got[k][0] for k in [(1, 1), (0, 1), (0, 2), (3, 0), (2, 2)]] == [1, 2, 3, 4, 5]
    assert got[(0, 2)][1] == pytest.approx(19 / 25) and got[(2, 2)][1] == 1.0
    assert rows(top_fraction(cells, "n", 0.5), "row", "col") == [(0, 1), (1, 1)]
    assert rows(top_fraction(cells, "n", 0.01), "row", "col") == [(1, 1)]


def test_global_rank_equals_plain_window(spark):
    rng = random.Random(1)
    data = [(g, rng.choice([1, 1, 1, 2, 7]), i % 9, i) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(data, "g string, n int, row int, col int")
    got = global_rank(df, [("n", False), ("row", True), ("col", True)], levels=2, by=["g"])
    for g in "ab":
        want = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2], x[3]))
        assert [tuple(r)[:4] for r in got.where(F.col("g") == g).orderBy("rank").select("g", "n", "row", "col", "rank").collect()] == want


def test_gini_and_weighted_median(spark):
    df = spark.createDataFrame([(float(v), w) for v, w in [(1, 1), (2, 1), (3, 2)]], "v double, w int")
    for width in (0.01, 0.7, 100.0):
        assert weighted_median(df, ["v"], "w", width=width).first().v == 2.0  # half the weight falls on a boundary
    assert gini(spark.createDataFrame([(1,), (1,), (1,)], "v int"), "v").first().gini == pytest.approx(0)
    assert gini(spark.createDataFrame([(0,), (0,), (0,), (8,)], "v int"), "v").first().gini == pytest.approx(0.75)


def test_exact_percentiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {"skewed": np.exp(rng.normal(0, 3, 3000)), "tied": np.repeat([1.0, 2.0, 5.0], [700, 1, 3]), "one": np.array([4.25]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975, "e": 1.0}
    for r in exact_percentiles(df, "v", probs, by=["g"], width=0.7).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(float(np.percentile(groups[r.g], p * 100))), (r.g, p)


def visits_of(spark, cells, order="o"):
    data = [(order, f"2023-10-01 10:{i // 2:02d}:{30 * (i % 2):02d}", float(i), 0.0, r, c) for i, (r, c) in enumerate(cells)]
    df = spark.createDataFrame(data, "order_id string, ts string, longitude double, latitude double, row int, col int")
    return df.withColumn("datetime", F.to_timestamp("ts")).drop("ts")


def test_visit_compression_transitions_and_signature(spark):
    a, b, c = (0, 0), (0, 1), (5, 5)
    points = visits_of(spark, [a, a, b, b, a, c]).unionByName(visits_of(spark, [a, b, b, a, c], "p")).unionByName(visits_of(spark, [a, b, c, a], "q"))
    for slice_s in (30, 60, 3600):  # carrying across slices must not change anything
        visits = compress_visits(points, slice_s=slice_s)
        path = with_visit_index(visits, slice_s=slice_s).where("order_id = 'o'").orderBy("seq_index").select("seq_index", "row", "col").collect()
        assert [tuple(r) for r in path] == [(1, 0, 0), (2, 0, 1), (3, 0, 0), (4, 5, 5)]
    moves = transitions(compress_visits(points).where("order_id = 'o'"))
    assert rows(moves.select("node_a.row", "node_a.col", "node_b.row", "node_b.col")) == [(0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 5, 5)]
    assert rows(route_signatures(compress_visits(points)), "length", "orders") == [(4, 1), (4, 2)]


def test_buffer_edge_rules(spark):
    grid = GridSpec(10000.0)
    corner = spark.createDataFrame([(0, 0)], "row int, col int")
    assert rows(buffer_cells(corner, 1, grid=grid, edge="discard"), "row", "col") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert rows(buffer_cells(corner, 1, grid=grid, edge="clamp"), "row", "col") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert buffer_cells(corner, 1, edge="unbounded").count() == 9
    far = spark.createDataFrame([(grid.n_rows, grid.n_cols)], "row int, col int")  # one step outside
    assert rows(buffer_cells(far, 1, grid=grid, edge="discard"), "row", "col") == [(grid.n_rows - 1, grid.n_cols - 1)]
    assert rows(buffer_cells(far, 0, grid=grid, edge="clamp"), "row", "col") == [(grid.n_rows - 1, grid.n_cols - 1)]
    assert rows(buffer_cells(corner, 0, grid=grid), "row", "col") == [(0, 0)]
    with pytest.raises(ValueError):
        buffer_cells(corner, 1, edge="wrap")


def test_degrees_and_overlap(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (9, 9)], "row int, col int")
    assert rows(cell_degrees(cells), "row", "col", "degree") == [(0, 0, 1), (0, 1, 2), (1, 2, 1), (9, 9, 0)]
    other = spark.createDataFrame([(0, 0), (7, 7)], "row int, col int")
    assert tuple(set_overlap(cells, other, ["row", "col"]).first()) == (4, 2, 1, 5, 3, 1, 0.2)


def test_time_expressions(spark):
    t = spark.createDataFrame([("20231001093015",), ("20231001093015.0",), ("20231345000000",), ("x",), ("123456789012345",), ("01231001093015",)], "t string")
    strict = [r[0] for r in t.select(parse_compact(F.col("t"))).collect()]
    assert [v is not None for v in strict] == [True, False, False, False, False, True]
    loose = t.select(parse_compact(strip_fraction(F.col("t"))).alias("v")).collect()
    assert loose[1].v == loose[0].v
    one = spark.sql("select timestamp '2023-10-01 09:31:59' ts, 47 slot")
    row = one.select(F.date_format(window_start(F.col("ts"), 120), "HH:mm:ss").alias("w"), slot_label(F.col("slot"), 30).alias("s")).first()
    assert (row.w, row.s) == ("09:30:00", "23:30-23:59")


def test_labelled_bins(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (1.0,), (79.9,), (80.0,)], "v double")
    got = [r[0] for r in df.select(labelled_bin(F.col("v"), (0, 1, 3, 5, 10, 20, 80))).collect()]
    assert got == [None, "0-1", "1-3", "20-80", None]


def test_percentiles_broadcast_bins_not_rows(spark):
    """A stored table of few distinct values is small as a file; its rows must not be broadcast for that."""
    df = materialize(spark.range(6_000_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 4 / 4).alias("v")))
    key = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(key, str(96 << 20))
    try:
        got = exact_percentiles(df, "v", {"m": .5, "q": .25}, width=0.001, by=["g"]).collect()
    finally:
        spark.conf.unset(key)
    assert {(r.g, r.m, r.q) for r in got} == {(0, 0.25, 0.0), (1, 0.5, 0.25)}


def test_percentiles_of_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FEW", 10)
    df = spark.range(4000).select((F.col("id") % 40).alias("g"), F.floor(F.col("id") / 40).cast("double").alias("v"))
    assert {(r.g, r.m) for r in exact_percentiles(df, "v", {"m": .5}, width=0.5, by=["g"]).collect()} == {(g, 49.5) for g in range(40)}
