"""Graph operators as iterated DataFrame joins; every round is checkpointed to the shared folder.

Edges are (src, dst[, cost]) in both directions. ``by`` runs many graphs at
once (thresholds, vendors, null-model iterations) in the same rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.operators.buffers import neighbour_pairs
from airgrid.operators.joins import lookup_join
from airgrid.operators.ranking import cumulative_by_value, weighted_median
from airgrid.session import materialize

_CELL_SHIFT = 1 << 20


def cell_node(row: str = "row", col: str = "col"):
    """One long per cell, ordered like (row, col)."""
    return F.col(row).cast("bigint") * F.lit(_CELL_SHIFT) + F.col(col)


def symmetric(edges: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Both directions of an undirected edge list."""
    flipped = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), *keep)
    return edges.select(*by, "src", "dst", *keep).unionByName(flipped)


def _followed(hooks: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, target): each label's target, its target's target and so on, to the end; targets are smaller than labels."""
    while True:
        ends = hooks.select(*by, F.col("label").alias("target"), F.col("target").alias("far"))
        hooks = materialize(lookup_join(hooks, ends, by + ["target"]).select(
            *by, "label", F.coalesce("far", "target").alias("target"), F.col("far").isNotNull().alias("moved")))
        done = hooks.where("moved").isEmpty()
        hooks = hooks.drop("moved")
        if done:
            return hooks


def connected_components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, label): label is the smallest node of the component; isolated nodes keep their own.

    Only nodes whose label changed tell their neighbours. A label that meets a smaller one is hooked to it as a whole, chains
    of hooks are followed to their ends, and all nodes of a hooked label take the end's: one round joins
    whole trees. Labels of giant components are looked up without moving all their nodes to one task.
    """
    by = list(by)
    links = materialize(symmetric(edges, by).where(F.col("src") != F.col("dst")).distinct())
    labels = materialize(nodes.select(*by, "node").distinct().withColumn("label", F.col("node")))
    frontier = labels
    while True:
        told = links.join(frontier.select(*by, F.col("node").alias("src"), F.col("label").alias("near")), by + ["src"]).groupBy(
            *by, F.col("dst").alias("node")).agg(F.min("near").alias("near"))
        hooks = told.join(labels, by + ["node"]).where(F.col("near") < F.col("label")).groupBy(*by, "label").agg(F.min("near").alias("target"))
        hooks = materialize(hooks)
        if hooks.isEmpty():
            return labels
        moved = lookup_join(labels, _followed(hooks, by), by + ["label"])
        moved = materialize(moved.select(*by, "node", F.coalesce("target", "label").alias("label"), F.col("target").isNotNull().alias("moved")))
        labels, frontier = moved.drop("moved"), moved.where("moved").drop("moved")


def cell_components(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """8-neighbour components of a cell set: (by, row, col, label)."""
    cells = materialize(cells.select(*by, "row", "col").distinct())
    pairs = neighbour_pairs(cells, by).select(*by, cell_node().alias("src"), cell_node("n_row", "n_col").alias("dst"))
    labels = connected_components(cells.select(*by, cell_node().alias("node")), pairs, by)
    return cells.withColumn("node", cell_node()).join(labels, [*by, "node"]).drop("node")


def component_sizes(components: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return components.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("size"))


def continuity(components: DataFrame, degrees: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number and sizes of components, coverage indices and degree shares of a cell set."""
    by, size = list(by), F.col("size")
    hist = cumulative_by_value(component_sizes(components, by), "size", by=by)
    total = F.max("sum_total")

    def covering(q: float):
        """Components, largest first, needed to hold a share q of the cells."""
        need = F.col("sum_total") * q - F.col("sum_before")
        hit = F.when((need > 0) & (need <= size * F.col("ties")), F.col("rows_before") + F.ceil(need / size))
        return F.max(hit).cast("bigint")

    sizes = hist.groupBy(*by).agg(
        F.max("rows_total").alias("n_components"), F.max("size").alias("largest_component_cells"),
        (F.max("size") / total).alias("largest_component_share"), covering(0.5).alias("components_covering_50pct"),
        covering(0.8).alias("components_covering_80pct"),
        (F.coalesce(F.sum(F.when(size == 1, F.col("ties"))), F.lit(0)) / F.max("rows_total")).alias("singleton_component_share"),
        (F.coalesce(F.sum(F.when(size <= 3, F.col("ties") * size)), F.lit(0)) / total).alias("cells_in_le3_share"))
    d = F.col("degree")
    shares = degrees.groupBy(*by).agg(F.avg(d).alias("mean_degree"), F.avg((d <= 1).cast("int")).alias("degree_le1_share"),
                                      F.avg((d == 2).cast("int")).alias("degree_eq2_share"), F.avg((d >= 3).cast("int")).alias("degree_ge3_share"))
    if by:
        return sizes.join(shares, by)
    return sizes.select("*", *[shares.select(c).scalar().alias(c) for c in shares.columns])


def component_shapes(components: DataFrame, minimum: int = 5) -> DataFrame:
    """PCA elongation, bounding-box aspect and major-axis angle of components with at least ``minimum`` cells."""
    floor = 1.0e-9
    stats = components.groupBy("label").agg(
        F.count(F.lit(1)).alias("cells"), F.var_samp("row").alias("vr"), F.var_samp("col").alias("vc"), F.covar_samp("row", "col").alias("cv"),
        (F.max("row") - F.min("row") + 1).alias("rs"), (F.max("col") - F.min("col") + 1).alias("cs")).where(F.col("cells") >= minimum)
    mid, gap = (F.col("vr") + F.col("vc")) / 2, F.hypot((F.col("vr") - F.col("vc")) / 2, F.col("cv"))
    major, minor = F.greatest(F.lit(floor), mid + gap), F.greatest(F.lit(floor), mid - gap)
    turn = F.degrees(F.atan2(F.col("cv") * 2, F.col("vc") - F.col("vr")) / 2)
    angle = F.pmod(F.round(turn, 9), F.lit(180.0))  # rounded so that -0.0... stays 0, not 180
    return stats.select("label", "cells", F.sqrt(major / minor).alias("pca_elongation"),
                        (F.greatest("rs", "cs") / F.greatest(F.least("rs", "cs"), F.lit(1))).alias("bbox_aspect_ratio"),
                        angle.alias("major_axis_angle_deg"))


def axial_resultant(angle, weight=None):
    """Length of the mean doubled-angle vector (0 = no axis, 1 = one axis)."""
    c, s = F.cos(F.radians(angle) * 2), F.sin(F.radians(angle) * 2)
    if weight is None:
        return F.hypot(F.avg(c), F.avg(s))
    return F.hypot(F.sum(c * weight) / F.sum(weight), F.sum(s * weight) / F.sum(weight))


def shape_summary(shapes: DataFrame, total_cells) -> DataFrame:
    """Size-weighted medians of shape measures and the largest component's values."""
    big = F.struct("cells", -F.col("label"))
    out = shapes.agg(F.count(F.lit(1)).alias("components_ge5_cells"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells_in_ge5"),
                     (F.coalesce(F.sum("cells"), F.lit(0)) / total_cells).alias("cells_in_ge5_share"),
                     *[F.max_by(c, big).alias(f"largest_{c}") for c in ("pca_elongation", "bbox_aspect_ratio", "major_axis_angle_deg")],
                     axial_resultant(F.col("major_axis_angle_deg"), F.col("cells")).alias("axis_axial_resultant"))
    median = weighted_median(shapes, ["pca_elongation", "bbox_aspect_ratio"], "cells")
    return out.select("*", *[median.select(c).scalar().alias(f"weighted_median_{c}") for c in ("pca_elongation", "bbox_aspect_ratio")])


def degree_table(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Degree and strength per node, zero for isolated nodes; ``edges`` are undirected with a weight."""
    by = list(by)
    sums = symmetric(edges, by, ["weight"]).groupBy(*by, F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return nodes.select(*by, "node").distinct().join(sums, by + ["node"], "left").na.fill(0, ["degree", "strength"])


def local_clustering(edges: DataFrame, degrees: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Local clustering coefficient per node, 0 below degree 2.

    Each edge points from its lower- to its higher-degree end, which bounds
    every out-degree by sqrt(2 * edges), so wedges are few even at hubs.
    """
    by = list(by)
    rank = lambda side: degrees.select(*by, F.col("node").alias(side), F.struct("degree", F.col("node").alias("n")).alias(f"_{side}"))
    placed = edges.select(*by, "src", "dst").join(rank("src"), by + ["src"]).join(rank("dst"), by + ["dst"])
    up = F.col("_src") < F.col("_dst")
    arcs = materialize(placed.select(*by, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"),
                                     F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi")))
    wedge = arcs.withColumnRenamed("hi", "x").join(arcs.withColumnRenamed("hi", "y"), by + ["lo"]).where(F.col("x") < F.col("y"))
    closing = arcs.select(*by, F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y"))
    triangles = wedge.join(closing, by + ["x", "y"])
    per_node = triangles.select(*by, F.explode(F.array("lo", "x", "y")).alias("node")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("t"))
    k = F.col("degree")
    return degrees.join(per_node, by + ["node"], "left").na.fill(0, ["t"]).select(
        *by, "node", F.when(k < 2, F.lit(0.0)).otherwise(F.lit(2.0) * F.col("t") / (k * (k - 1))).alias("clustering"))


def betweenness(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = (), *, tolerance: float = 1e-12, batch: int = 2000) -> DataFrame:
    """Shortest-path betweenness for all nodes (undirected, each pair counted once).

    ``edges`` are undirected with ``cost``; costs within ``tolerance`` tie. Sources are worked off in batches of about ``batch`` nodes,
    so that the state of a batch has at most batch x nodes rows, and only a batch's node scores are kept.
    """
    by = list(by)
    nodes = materialize(nodes.select(*by, "node").distinct())
    links = materialize(symmetric(edges, by, ["cost"]))
    batches = -(-nodes.count() // batch)
    scores = None
    for number in range(batches):
        sources = nodes if batches == 1 else nodes.where(F.pmod(F.xxhash64(*by, "node"), F.lit(batches)) == number)
        part = _dependencies(sources, links, by, tolerance)
        scores = part if scores is None else scores.unionByName(part)
    if scores is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    total = scores.groupBy(*by, "node").agg((F.sum("x") / 2).alias("betweenness"))
    return nodes.join(total, by + ["node"], "left").na.fill(0.0, ["betweenness"])


def _dependencies(sources: DataFrame, links: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """(by, node, x): sum over the sources of the share of their shortest paths that pass through each node.

    Distances come in waves that are only appended: a wave has the pairs whose distance got shorter, and the
    distance of a pair is its least one. Path counts follow the shortest-path edges outwards, dependencies inwards.
    """
    pair, steps = by + ["s", "v"], links.withColumnRenamed("src", "v")
    start = materialize(sources.select(*by, F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0.0).alias("d")))
    known, wave = start, start
    while True:
        reach = wave.join(steps, by + ["v"]).groupBy(*by, "s", F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("cost")).alias("d"))
        least = known.groupBy(*pair).agg(F.min("d").alias("least"))
        wave = materialize(reach.join(least, pair, "left").where(F.col("least").isNull() | (F.col("d") < F.col("least") - tolerance)).select(*pair, "d"))
        if wave.isEmpty():
            break
        known = known.unionByName(wave)
    dist = materialize(known.groupBy(*pair).agg(F.min("d").alias("d")))
    ends = dist.select(*by, "s", F.col("v").alias("dst"), F.col("d").alias("d_end"))
    dag = dist.join(steps, by + ["v"]).join(ends, by + ["s", "dst"]).where(
        F.abs(F.col("d") + F.col("cost") - F.col("d_end")) <= tolerance).select(*pair, "dst")
    dag = materialize(dag.where(F.col("dst") != F.col("s")))

    def waves(first: DataFrame, step) -> DataFrame:
        total, wave = first, first
        while True:
            wave = materialize(step(wave))
            if wave.isEmpty():
                return materialize(total.groupBy(*pair).agg(F.sum("x").alias("x")))
            total = total.unionByName(wave)

    forward = lambda w: w.join(dag, pair).groupBy(*by, "s", F.col("dst").alias("v")).agg(F.sum("x").alias("x"))
    sigma = waves(start.select(*pair, F.lit(1.0).alias("x")), forward).withColumnRenamed("x", "sigma")
    tails = sigma.select(*by, "s", F.col("v").alias("dst"), F.col("sigma").alias("sigma_end"))
    flow = materialize(dag.join(sigma, pair).join(tails, by + ["s", "dst"]).select(
        *by, "s", "v", "dst", (F.col("sigma") / F.col("sigma_end")).alias("r")))
    back = lambda w: w.select(*by, "s", F.col("v").alias("dst"), "x").join(flow, by + ["s", "dst"]).groupBy(*pair).agg(
        F.sum(F.col("r") * F.col("x")).alias("x"))
    ones = sigma.where(F.col("s") != F.col("v")).select(*pair, F.lit(1.0).alias("x"))
    through = waves(ones, back).where(F.col("s") != F.col("v"))  # 1 + dependency for every pair with s != v
    return materialize(through.groupBy(*by, F.col("v").alias("node")).agg(F.sum(F.col("x") - 1.0).alias("x")))


def normalized(value, n_nodes):
    """Scale by 2 / ((n-1)(n-2)); zero for graphs of at most two nodes."""
    return F.when(n_nodes <= 2, F.lit(0.0)).otherwise(value * 2.0 / ((n_nodes - 1) * (n_nodes - 2)))
