"""Route graphs of merged endpoints, repeated-route skeletons, road comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.geo import haversine_m
from airgrid.operators.buffers import cell_degrees, set_overlap
from airgrid.operators.cells import in_set
from airgrid.operators import graph
from airgrid.operators.percentiles import bounded_percentiles, exact_percentiles
from airgrid.operators.ranking import gini, global_rank, top_k_size, weighted_median
from airgrid.operators.sequences import compress_visits, order_lengths, route_signatures, transitions
from airgrid.operators.joins import resolved
from airgrid.operators.spatial import pairs_within
from airgrid.operators.trips import distance_bin
from airgrid.session import materialize
from airgrid.spec import ROAD_BUS_KMH, ROAD_PEAK_KMH


def endpoint_centroids(ends: DataFrame) -> DataFrame:
    """Mean coordinates of the endpoint points of each cell."""
    return ends.groupBy("row", "col").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).withColumn("node", graph.cell_node())


def cluster_endpoints(centroids: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, node, label): endpoint cells chained by distances up to each threshold, all thresholds in one run."""
    centroids = materialize(centroids)
    pairs = pairs_within(centroids, "node", max(thresholds))
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    edges = pairs.select("distance_m", F.col("node_a").alias("src"), F.col("node_b").alias("dst"), levels.alias("threshold"))
    edges = edges.where(F.col("distance_m") <= F.col("threshold"))
    nodes = centroids.select("node", levels.alias("threshold"))
    return graph.connected_components(nodes, edges, ["threshold"])


def cluster_nodes(centroids: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster position (mean of member centroids) and member count."""
    return centroids.join(clusters, "node").groupBy(F.col("label").alias("cluster")).agg(
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.count(F.lit(1)).alias("member_count"))


def cluster_pairs(od: DataFrame, clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """OD pairs with the clusters of both ends."""
    side = lambda name: clusters.select(*by, F.col("node").alias(f"_{name}"), F.col("label").alias(name))
    coded = od.withColumns({"_source": graph.cell_node("start_row", "start_col"), "_target": graph.cell_node("end_row", "end_col")})
    return coded.join(side("source"), "_source").join(side("target"), [*by, "_target"]).drop("_source", "_target")


def merge_sensitivity(od: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters and route connections per merge threshold."""
    pairs = od.groupBy("start_row", "start_col", "end_row", "end_col").agg(F.count(F.lit(1)).alias("orders"))
    linked = cluster_pairs(pairs, clusters, ["threshold"])
    away = F.col("source") != F.col("target")
    links = linked.where(away).groupBy("threshold").agg(
        F.count_distinct("source", "target").alias("directed_connections"),
        F.count_distinct(F.least("source", "target"), F.greatest("source", "target")).alias("undirected_connections"))
    orders = linked.groupBy("threshold").agg(F.coalesce(F.sum(F.when(~away, F.col("orders"))), F.lit(0)).alias("self_merged_orders"),
                                             F.sum("orders").alias("_n"))
    counts = clusters.groupBy("threshold").agg(F.count_distinct("label").alias("clusters"))
    return counts.join(orders, "threshold").join(links, "threshold", "left").na.fill(0).withColumn(
        "nonself_order_share", (F.col("_n") - F.col("self_merged_orders")) / F.col("_n"))


def route_edges(linked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Undirected weighted route graph without self-merged orders."""
    return linked.where(F.col("source") != F.col("target")).groupBy(
        *by, F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def network_measures(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Node table without path searches: degree, strength, clustering, component."""
    by, edges, nodes = list(by), materialize(edges), materialize(nodes.select(*by, "node").distinct())
    degrees = materialize(graph.degree_table(edges, nodes, by))
    out = degrees.join(graph.local_clustering(edges, degrees, by), by + ["node"])
    parts = graph.connected_components(nodes, edges, by)
    sizes = parts.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("component_size"))
    return out.join(parts.join(sizes, by + ["label"]).withColumnRenamed("label", "component"), by + ["node"])


def network_nodes(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = (), *, unweighted: bool = True) -> DataFrame:
    """Node table with the measures and betweenness (hop count and inverse flow)."""
    by, edges, nodes = list(by), materialize(edges), materialize(nodes.select(*by, "node").distinct())
    out = network_measures(edges, nodes, by)
    count = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    kinds = {"betweenness_unweighted": F.lit(1.0)} if unweighted else {}
    kinds["betweenness_invflow"] = F.lit(1.0) / F.col("weight")
    for name, cost in kinds.items():
        score = graph.betweenness(edges.withColumn("cost", cost), nodes, by).withColumnRenamed("betweenness", name)
        out = out.join(score, by + ["node"])
    out = out.join(count, by) if by else out.withColumn("_n", count.scalar())
    return materialize(out.withColumns({f"{name}_norm": graph.normalized(F.col(name), F.col("_n")) for name in kinds}).drop("_n"))


def network_summary(node_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size, density, components, degree and strength statistics of a route graph."""
    by, k, n = list(by), F.col("degree"), F.count(F.lit(1))
    share = lambda test: F.avg(test.cast("int"))
    edges = F.sum("degree") / 2
    out = node_table.groupBy(*by).agg(
        n.alias("nodes"), edges.cast("bigint").alias("edges"),
        F.when(n > 1, 2.0 * edges / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"),
        F.count_distinct("component").alias("components"), F.max("component_size").alias("largest_component_nodes"),
        (F.max("component_size") / n).alias("largest_component_share"), F.avg(k).alias("average_degree"), F.avg("strength").alias("average_strength"),
        F.max(k).alias("max_degree"), F.max("strength").alias("max_strength"), F.avg("clustering").alias("mean_local_clustering"),
        share(k == 0).alias("degree_0_share"), share(k == 1).alias("degree_1_share"), share(k == 2).alias("degree_2_share"),
        share(k >= 3).alias("degree_ge3_share"))
    for measure in ("degree", "strength"):
        value = gini(node_table, measure, by=by).withColumnRenamed("gini", f"{measure}_gini")
        out = out.join(value, by) if by else out.withColumn(f"{measure}_gini", value.scalar())
    return out


def network_report(summary: DataFrame) -> DataFrame:
    """Compact per-vendor network table with display rounding."""
    return summary.select("vendor", "nodes", "edges", "components", F.round(F.col("largest_component_share") * 100, 1).alias("largest_component_share_pct"),
                          F.round("mean_local_clustering", 3).alias("mean_local_clustering"), F.round("average_degree", 2).alias("average_degree"),
                          "max_degree", "max_strength")


# ------------------------------------------------------- road comparison
def route_key(src: str, dst: str) -> Column:
    part = lambda p: F.format_string("%.6f,%.6f", F.col(f"{p}_lon"), F.col(f"{p}_lat"))
    return F.concat_ws(";", part(src), part(dst))


def directed_edges(linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed routes: support, median and mean air distance and duration, median OD distance, vendor share."""
    by = ["source", "target"]
    away = linked.where(F.col("source") != F.col("target"))
    out = away.groupBy(*by).agg(
        F.count(F.lit(1)).alias("order_support"), F.avg("path_length_km").alias("mean_air_distance_km"),
        F.avg("duration_minutes").alias("mean_air_duration_min"), F.avg((F.col("vendor") == "SF").cast("int")).alias("sf_order_share"))
    for column, name in (("path_length_km", "median_air_distance_km"), ("duration_minutes", "median_air_duration_min"), ("od_distance_km", "median_od_distance_km")):
        out = out.join(exact_percentiles(away, column, {name: .5}, width=0.02, by=by), by)
    place = lambda p: nodes.select(F.col("cluster").alias(p), F.col("centroid_lat").alias(f"{p}_lat"), F.col("centroid_lon").alias(f"{p}_lon"))
    return out.join(place("source"), "source").join(place("target"), "target").withColumn("route_key", route_key("source", "target"))


def out_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Clusters with out-degree and out-strength."""
    sums = edges.groupBy(F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("order_support").alias("out_strength_orders"))
    return nodes.join(sums, "cluster", "left").na.fill(0, ["out_degree", "out_strength_orders"])


def latest_lookup(attempts: DataFrame) -> DataFrame:
    """Last answer per route key; of equally late ones the longest."""
    return resolved(attempts, "route_key", "attempt", ["distance_m", "duration_s", "status"])


def with_road_metrics(edges: DataFrame, lookup: DataFrame) -> DataFrame:
    """Road distance, three road durations, ratios, time differences and faster flags for routed edges."""
    km, air_min = F.col("distance_m") / 1000.0, F.col("median_air_duration_min")
    out = edges.join(lookup, "route_key", "left").where(F.col("status") == "Ok")
    out = out.withColumns({"road_distance_km": km, "road_duration_osrm_min": F.col("duration_s") / 60.0,
                           "road_duration_peak25_min": km * 60.0 / F.lit(ROAD_PEAK_KMH), "road_duration_bus1757_min": km * 60.0 / F.lit(ROAD_BUS_KMH)})
    out = out.withColumns({"road_to_air_distance_ratio": F.try_divide(F.col("road_distance_km"), F.col("median_air_distance_km")),
                           "road_to_od_distance_ratio": F.try_divide(F.col("road_distance_km"), F.col("median_od_distance_km")),
                           "dist_bin": distance_bin(F.col("median_air_distance_km")),
                           **{f"time_delta_{k}_min": F.col(f"road_duration_{k}_min") - air_min for k in ("osrm", "peak25", "bus1757")}})
    return out.withColumns({f"aerial_faster_{k}": F.col(f"time_delta_{k}_min") > 0 for k in ("osrm", "peak25", "bus1757")})


ROAD_MEDIANS = ("median_air_distance_km", "road_distance_km", "median_air_duration_min", "road_duration_osrm_min", "road_duration_peak25_min",
                "road_to_air_distance_ratio", "time_delta_osrm_min", "time_delta_peak25_min")


def road_comparison(routed: DataFrame) -> DataFrame:
    """Order-weighted medians and faster shares by distance bin and overall."""
    routed = materialize(routed)
    scoped = routed.withColumn("scope", F.explode(F.array(F.lit("all"), F.coalesce("dist_bin", F.lit("outside")))))
    w, by = F.col("order_support"), ["scope"]
    share = lambda flag: F.sum(w * F.col(flag).cast("int")) / F.sum(w)
    out = scoped.groupBy(*by).agg(F.count(F.lit(1)).alias("n_directed_routes"), F.sum(w).alias("n_orders"),
                                  *[share(f"aerial_faster_{k}").alias(f"share_faster_{k}") for k in ("osrm", "peak25", "bus1757")])
    return out.join(weighted_median(scoped, ROAD_MEDIANS, "order_support", by=by), by)


# ------------------------------------------------------- repeated routes
def edge_support(moves: DataFrame) -> DataFrame:
    """Traversals and distinct orders per undirected cell-to-cell edge."""
    return moves.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("traversals"), F.count_distinct("order_id").alias("support"))


def edge_support_summary(edges: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Support and traversal percentiles (integer measures) and traversal shares of the best supported edges."""
    stats = edges.agg(F.count(F.lit(1)).alias("edges"), F.max("support").alias("support_max"), F.max("traversals").alias("traversal_max"),
                      *bounded_percentiles(F.col("support"), {"support_p50": .5, "support_p90": .9}),
                      *bounded_percentiles(F.col("traversals"), {"traversal_p50": .5, "traversal_p90": .9}))
    flat = edges.select("support", "traversals", *[F.col(f"node_{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("row", "col")])
    order = [("support", False), ("a_row", True), ("a_col", True), ("b_row", True), ("b_col", True)]
    ranked = global_rank(flat, order, levels=2)
    n = edges.agg(F.count(F.lit(1))).scalar()
    shares = ranked.agg(*[(F.sum(F.when(F.col("rank") <= top_k_size(n, f), F.col("traversals"))) / F.sum("traversals")).alias(name)
                          for name, f in fractions.items()])
    return stats.select("*", *[shares.select(c).scalar().alias(c) for c in fractions])


def signature_summary(signatures: DataFrame) -> DataFrame:
    """How many orders repeat a visit sequence."""
    o, total = F.col("orders"), F.sum("orders")
    share = lambda k: F.coalesce(F.sum(F.when(o >= k, o)), F.lit(0)) / total
    top = signatures.orderBy(F.desc("orders")).limit(10).agg(F.sum("orders")).scalar()
    return signatures.agg(F.count(F.lit(1)).alias("unique_signatures"), share(2).alias("share_orders_support_ge_2"),
                          share(5).alias("share_orders_support_ge_5"), (F.max(o) / total).alias("top_1_share"), (top / total).alias("top_10_share"),
                          F.max(o).alias("max_orders"))


def sequence_summary(visits: DataFrame, moves: DataFrame) -> DataFrame:
    lengths = order_lengths(visits)
    stats = lengths.agg(F.count(F.lit(1)).alias("orders"), *bounded_percentiles(F.col("visits"), {"median_length_cells": .5}),
                        *bounded_percentiles(F.col("unique_cells"), {"median_unique_cells": .5}))
    return stats.withColumn("edge_traversals", moves.agg(F.count(F.lit(1))).scalar())


def skeleton(edges: DataFrame, minimum: int) -> DataFrame:
    return edges.where(F.col("support") >= minimum)


def _node_id(struct: str) -> Column:
    return F.col(f"{struct}.row").cast("bigint") * F.lit(1 << 20) + F.col(f"{struct}.col")


def skeleton_sensitivity(visits: DataFrame, moves: DataFrame, backbone: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Skeleton graph measures and per-order coverage for several support thresholds.

    An edge is in the skeleton of threshold t when its support reaches t and a
    node when its best edge does, so one pass over orders serves all t.
    """
    edges = materialize(edge_support(moves))
    by, levels = ["threshold"], F.explode(F.array(*[F.lit(int(t)) for t in thresholds]))
    kept = edges.select(_node_id("node_a").alias("src"), _node_id("node_b").alias("dst"), "support", F.lit(1).alias("weight"), levels.alias("threshold"))
    kept = materialize(kept.where(F.col("support") >= F.col("threshold")))
    nodes = materialize(graph.symmetric(kept, by).select("threshold", F.col("src").alias("node")).distinct())
    parts = graph.connected_components(nodes, kept, by).groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("size"))
    shape = parts.groupBy("threshold").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes"), F.max("size").alias("_big"))
    out = kept.groupBy("threshold").agg(F.count(F.lit(1)).alias("edges")).join(shape, by)
    members = backbone.select(graph.cell_node().alias("node")).withColumn("b", F.lit(True))
    shared = nodes.join(members, "node", "left").groupBy("threshold").agg(F.count("b").alias("_shared"))
    size = backbone.agg(F.count(F.lit(1))).scalar()
    out = out.join(shared, by).withColumns({
        "largest_component_share": F.col("_big") / F.col("nodes"), "mean_degree": F.col("edges") * 2 / F.col("nodes"),
        "backbone_coverage": F.col("_shared") / size, "nodes_in_backbone_share": F.col("_shared") / F.col("nodes"),
        "jaccard_with_backbone": F.col("_shared") / (size + F.col("nodes") - F.col("_shared"))})

    walked = moves.groupBy("order_id", "node_a", "node_b").agg(F.count(F.lit(1)).alias("k")).join(edges.drop("traversals"), ["node_a", "node_b"])
    share = lambda t, v: F.sum(F.when(F.col("support") >= t, v).otherwise(F.lit(0))) / F.sum(v)
    edge_cov = walked.groupBy("order_id").agg(*[share(t, F.col("k")).alias(f"e{t}") for t in thresholds])
    best = edges.select(F.explode(F.array("node_a", "node_b")).alias("node"), "support").groupBy("node").agg(F.max("support").alias("support"))
    best = best.select("node.row", "node.col", "support")
    cells = visits.select("order_id", "row", "col").distinct().join(best, ["row", "col"])
    cells = cells.join(edge_cov.select("order_id"), "order_id", "left_semi")
    node_cov = cells.groupBy("order_id").agg(*[share(t, F.lit(1)).alias(f"n{t}") for t in thresholds])
    long = edge_cov.join(node_cov, "order_id").select(F.explode(F.array(*[
        F.struct(F.lit(int(t)).alias("threshold"), F.col(f"e{t}").alias("edge_cov"), F.col(f"n{t}").alias("node_cov")) for t in thresholds])).alias("c")).select("c.*")
    long = materialize(long)
    means = long.groupBy(*by).agg(F.avg("edge_cov").alias("mean_edge_coverage"), F.avg((F.col("edge_cov") >= 0.8).cast("int")).alias("share_orders_ge_80pct"),
                                  F.avg("node_cov").alias("mean_node_coverage"))
    quart = exact_percentiles(long, "edge_cov", {"median_edge_coverage": .5, "p25_edge_coverage": .25}, width=0.001, by=by)
    return means.join(quart, by).join(out, by, "left").na.fill(0, ["edges", "nodes", "components"])


# ------------------------------------------------------- backbone morphology
def backbone_continuity(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cells = materialize(cells)
    return graph.continuity(graph.cell_components(cells, by), cell_degrees(cells, by), by)


def moving_directionality(points: DataFrame, components: DataFrame, shapes: DataFrame, speed: float = 2.0) -> DataFrame:
    """Per component: moving points, axial resultant of headings, median deviation from the component axis."""
    axes = components.join(shapes.select("label", "major_axis_angle_deg"), "label").select("row", "col", "label", "major_axis_angle_deg")
    moving = points.where((F.col("speed") >= speed) & F.col("yaw").isNotNull()).select("row", "col", "yaw").join(axes, ["row", "col"])
    moving = moving.withColumn("deviation", F.abs(F.pmod(F.col("yaw") - F.col("major_axis_angle_deg") + 90.0, F.lit(180.0)) - 90.0))
    base = moving.groupBy("label").agg(F.count(F.lit(1)).alias("moving_points"), graph.axial_resultant(F.col("yaw")).alias("axial_resultant"),
                                       F.max("major_axis_angle_deg").alias("major_axis_angle_deg"))
    return base.join(exact_percentiles(moving, "deviation", {"median_deviation_deg": .5}, width=0.1, by=["label"]), "label")


def directionality_summary(table: DataFrame) -> DataFrame:
    table = materialize(table)
    n, r = F.col("moving_points"), F.col("axial_resultant")
    share = lambda t: F.coalesce(F.sum(F.when(r >= t, n)), F.lit(0)) / F.sum(n)
    out = table.agg(F.sum(n).alias("moving_points"), F.count_if(r >= 0.8).alias("components_r_ge_08"), share(0.8).alias("point_share_r_ge_08"),
                    F.count_if(r >= 0.5).alias("components_r_ge_05"), share(0.5).alias("point_share_r_ge_05"))
    median = weighted_median(table, ["axial_resultant", "median_deviation_deg"], "moving_points")
    return out.select("*", *[median.select(c).scalar().alias(f"weighted_{c}") for c in ("axial_resultant", "median_deviation_deg")])
