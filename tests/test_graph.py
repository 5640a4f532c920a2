"""Graph operators against plain Python on small graphs."""

import heapq
import itertools
import random
from collections import defaultdict

import pytest

from airgrid.operators import graph
from airgrid.operators.joins import lookup_join
from airgrid.operators.spatial import nearest, pairs_within, position_pairs, within_radius
from airgrid.plans.routes import backbone_continuity, network_nodes, network_summary
from airgrid.plans.sites import close_site_pairs
from pyspark.sql import functions as F

from airgrid.session import materialize


def frames(spark, edges, nodes):
    e = spark.createDataFrame([(a, b, w) for a, b, w in edges], "src bigint, dst bigint, weight bigint")
    return e, spark.createDataFrame([(n,) for n in nodes], "node bigint")


def brute_betweenness(edges, nodes, cost):
    """Enumerate all simple shortest paths of every pair."""
    nbr = defaultdict(dict)
    for a, b, w in edges:
        nbr[a][b] = nbr[b][a] = cost(w)
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        heap, best, paths = [(0.0, (s,))], None, []
        while heap:
            d, path = heapq.heappop(heap)
            if best is not None and d > best + 1e-12:
                break
            if path[-1] == t:
                best = d if best is None else best
                paths.append(path)
                continue
            for v, c in nbr[path[-1]].items():
                if v not in path:
                    heapq.heappush(heap, (d + c, path + (v,)))
        for path in paths:
            for v in path[1:-1]:
                score[v] += 1 / len(paths)
    return score


GRAPHS = {
    "path": ([(1, 2, 1), (2, 3, 1), (3, 4, 1)], range(1, 5)),
    "star": ([(1, i, 2) for i in range(2, 6)], range(1, 6)),
    "tail": ([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 5)], range(1, 5)),
    "two parts and an isolated node": ([(1, 2, 1), (2, 3, 4), (7, 8, 1)], (1, 2, 3, 7, 8, 9)),
    "tied weights": ([(1, 2, 2), (2, 4, 2), (1, 3, 2), (3, 4, 2), (1, 4, 1), (4, 5, 3)], range(1, 6)),
}
_rng = random.Random(11)
GRAPHS["random"] = ([(a, b, _rng.choice([1, 2, 4])) for a, b in itertools.combinations(range(9), 2) if _rng.random() < 0.35], range(9))


@pytest.mark.parametrize("name", GRAPHS)
def test_betweenness(spark, name):
    edges, nodes = GRAPHS[name]
    e, n = frames(spark, edges, nodes)
    for cost, column in ((lambda w: 1.0, F.lit(1.0)), (lambda w: 1.0 / w, 1.0 / F.col("weight"))):
        want = brute_betweenness(edges, list(nodes), cost)
        got = {r.node: r.betweenness for r in graph.betweenness(e.withColumn("cost", column), n).collect()}
        assert got == pytest.approx(want)


def test_components_clustering_and_summary(spark):
    edges, nodes = GRAPHS["two parts and an isolated node"]
    e, n = frames(spark, edges, nodes)
    labels = {r.node: r.label for r in graph.connected_components(n, e).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    edges, nodes = GRAPHS["tail"]
    e, n = frames(spark, edges, nodes)
    table = network_nodes(e, n)
    coeff = {r.node: r.clustering for r in table.collect()}
    assert coeff == pytest.approx({1: 1.0, 2: 1.0, 3: 1 / 3, 4: 0.0})
    s = network_summary(table).first()
    assert (s.nodes, s.edges, s.components, s.max_degree, s.max_strength) == (4, 4, 1, 3, 7)
    assert s.density == pytest.approx(8 / 12) and s.mean_local_clustering == pytest.approx((1 + 1 + 1 / 3) / 4)


def test_long_chain_is_one_component(spark):
    e, n = frames(spark, [(i, i + 1, 1) for i in range(300)], range(301))
    assert graph.connected_components(n, e).select("label").distinct().count() == 1


def test_cell_components_and_continuity(spark):
    shape = [(0, 0), (1, 0), (2, 0), (2, 1), (3, 2), (9, 9)]  # L, a diagonal touch, a singleton
    cells = spark.createDataFrame(shape, "row int, col int")
    sizes = sorted(r["size"] for r in graph.component_sizes(graph.cell_components(cells)).collect())
    assert sizes == [1, 5]
    c = backbone_continuity(cells).first()
    assert (c.n_components, c.largest_component_cells, c.components_covering_50pct, c.components_covering_80pct) == (2, 5, 1, 1)
    assert c.singleton_component_share == 0.5 and c.cells_in_le3_share == pytest.approx(1 / 6)
    assert c.largest_component_share == pytest.approx(5 / 6)


@pytest.mark.parametrize("cells, angle", [([(0, i) for i in range(6)], 0.0), ([(i, 0) for i in range(6)], 90.0), ([(i, i) for i in range(6)], 45.0)])
def test_bar_axis(spark, cells, angle):
    comps = graph.cell_components(spark.createDataFrame(cells, "row int, col int"))
    row = graph.component_shapes(comps).first()
    assert row.major_axis_angle_deg == pytest.approx(angle) and row.pca_elongation > 100
    assert row.bbox_aspect_ratio == (1.0 if angle == 45.0 else 6.0)


def scattered(spark, n, seed):
    rng = random.Random(seed)
    data = [(i, 22.5 + rng.random() * 0.03, 113.9 + rng.random() * 0.03) for i in range(n)]
    return data, spark.createDataFrame(data, "k int, lat double, lon double")


def test_distance_joins_against_brute_force(spark):
    from math import asin, cos, radians, sin, sqrt

    def hav(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371008.8 * asin(sqrt(h))

    data, df = scattered(spark, 120, 2)
    got = {(r.k_a, r.k_b) for r in pairs_within(df, "k", 300.0).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if hav(a, b) <= 300.0}

    other, targets = scattered(spark, 60, 9)
    targets = targets.select(F.col("k").alias("t"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    mid = 22.515
    flat = lambda a, b: sqrt(((b[1] - a[1]) * 111320) ** 2 + ((b[2] - a[2]) * 111320 * cos(radians(mid))) ** 2)
    pos = dict(query_pos=("lat", "lon"), target_pos=("t_lat", "t_lon"))
    close = {(r.k, r.t) for r in within_radius(df, targets, 400.0, F.lit(mid), **pos).collect()}
    assert close == {(a[0], b[0]) for a in data for b in other if flat(a, b) <= 400.0}
    near = {r.k: r.t for r in nearest(df, ["k"], targets, ["t"], F.lit(mid), start_m=50.0, **pos).collect()}
    assert near == {a[0]: min(other, key=lambda b: flat(a, b))[0] for a in data}


def test_nearest_descends_many_levels(spark):
    """Clumped targets, queries far outside, and ties: the pyramid keeps every tile that may hold the answer."""
    rng = random.Random(12)
    mid = 22.5
    targets = [(k, 22.4 + round(rng.random(), 1) * 0.3 + rng.random() * 1e-3, 113.9 + round(rng.random(), 1) * 0.3 + rng.random() * 1e-3) for k in range(300)]
    targets += [(900, *targets[0][1:]), (901, None, 114.0)]
    queries = [(k, 22.0 + rng.random(), 113.5 + rng.random()) for k in range(80)] + [(80, 30.0, 100.0), (81, *targets[0][1:])]
    df = spark.createDataFrame(queries, "k int, lat double, lon double")
    spots = spark.createDataFrame(targets, "t int, t_lat double, t_lon double")
    from math import cos, hypot, radians
    flat = lambda a, b: hypot(b[1] - a[1], (b[2] - a[2]) * cos(radians(mid)))
    want = {q[0]: min((t for t in targets if t[1] is not None), key=lambda t: (round(flat(q, t), 12), t[0]))[0] for q in queries}
    for factor in (2, 8):
        got = nearest(df, ["k"], spots, ["t"], F.lit(mid), query_pos=("lat", "lon"), target_pos=("t_lat", "t_lon"), start_m=20.0, factor=factor)
        assert {r.k: r.t for r in got.collect()} == want
    assert nearest(df, ["k"], spots.limit(0), ["t"], F.lit(mid), query_pos=("lat", "lon"), target_pos=("t_lat", "t_lon")).count() == 0


def test_position_pairs_carry_multiplicities(spark):
    """Many points on few positions: at most one row for two positions, and together as many pairs as the points have."""
    rng = random.Random(4)
    spots = [(22.5 + k * 0.001, 114.0) for k in range(9)]
    points = [(f"p{k:04d}", *rng.choice(spots)) for k in range(600)]
    df = spark.createDataFrame(points, "site string, lat double, lon double")
    got = position_pairs(df, "site", 250.0).collect()
    assert len(got) <= 9 + 9 * 8 // 2
    assert sum(r.pairs for r in got) == pairs_within(df, "site", 250.0).count()
    held = defaultdict(list)
    for p, *spot in points:
        held[tuple(spot)].append(p)
    for r in got:
        a, b = held[(r.lat_a, r.lon_a)], held[(r.lat_b, r.lon_b)]
        assert (r.n_a, r.n_b) == (len(a), len(b)) and r.site_a == min(a) and r.site_b == (max(b) if a is b else min(b))


def test_close_sites_are_listed_pair_by_pair(spark):
    """Sites of one position are pairs of their own, each with both names."""
    spots = [(22.5 + (k % 4) * 0.001, 114.0) for k in range(60)]
    rows = [(f"s{k:03d}", lat, lon, k, k, "p", False) for k, (lat, lon) in enumerate(spots)]
    inventory = spark.createDataFrame(rows, "site_name string, lat double, lon double, row bigint, col bigint, platform string, is_test_site boolean")
    got = sorted((r.site_name_a, r.site_name_b) for r in close_site_pairs(inventory, 150.0).collect())
    assert got == [(f"s{a:03d}", f"s{b:03d}") for a, b in itertools.combinations(range(60), 2) if abs(a % 4 - b % 4) <= 1]


def union_find(nodes, edges):
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n
    for a, b in edges:
        x, y = root(a), root(b)
        of[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components_of_hard_shapes(spark):
    """A long path in mixed order, a star, a comb and a random graph, each twice, in one run."""
    rng = random.Random(6)
    path = list(range(200))
    rng.shuffle(path)
    shapes = {"path": list(zip(path, path[1:])), "star": [(150, k) for k in range(0, 300, 2)], "straight": [(k, k + 1) for k in range(150)],
              "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]}
    edges = [(name, a, b) for name, pairs in shapes.items() for a, b in pairs]
    nodes = [(name, k) for name in shapes for k in range(300)]
    got = graph.connected_components(spark.createDataFrame(nodes, "shape string, node bigint"), spark.createDataFrame(edges, "shape string, src bigint, dst bigint"), ["shape"])
    got = {(r.shape, r.node): r.label for r in got.collect()}
    for name, pairs in shapes.items():
        for node, label in union_find(range(300), pairs).items():
            assert got[name, node] == label, name


def test_lookups_of_a_frequent_key_stay_spread(spark):
    """A key of nearly all rows is looked up without a shuffle: no partition of the result holds its rows alone."""
    left = spark.range(40_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("k")).repartition(8)
    right = spark.createDataFrame([(-1, "hot"), (100, "one"), (7, "none")], "k bigint, v string")
    out = materialize(lookup_join(left, right, ["k"]))
    assert {(r.v, r.n) for r in out.groupBy("v").agg(F.count("*").alias("n")).collect()} == {("hot", 39_600), ("one", 1), (None, 399)}
    sizes = [r.n for r in out.where("v = 'hot'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 39_600 / len(sizes) and len(sizes) >= 4


def test_betweenness_in_batches(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(8), 2))) for _ in range(12)}
    e, n = frames(spark, [(a, b, rng.randrange(1, 4)) for a, b in sorted(edges)], range(8))
    e = e.withColumn("cost", 1 / F.col("weight"))
    whole, parts = ({r.node: r.betweenness for r in graph.betweenness(e, n, batch=b).collect()} for b in (1000, 4))
    assert set(whole) == set(range(8)) and all(whole[k] == pytest.approx(parts[k]) for k in whole)
