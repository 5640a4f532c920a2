"""Registered queries: endpoint clusters, route graphs, skeletons, road comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid import sinks
from airgrid.catalog import robustness as r
from airgrid.catalog import sql as q
from airgrid.catalog import trips as t
from airgrid.catalog.inputs import GRID, WINDOW, staged
from airgrid.catalog.registry import query
from airgrid.functions.geo import haversine_m
from airgrid.operators import buffers, cells as cells_op, graph, trips
from airgrid.operators.ranking import top_fraction, weighted_median
from airgrid.operators.sequences import compress_visits, route_signatures, transitions
from airgrid.plans import core, resampling as rs, robustness as rb, routes
from airgrid.plans.summary import summarize
from airgrid.session import materialize, table_path
from airgrid.sources import tables

THRESHOLDS = (400.0, 450.0, 475.0, 500.0)
MERGE = 450.0
SUPPORTS = (2, 5, 10, 20, 50)

# ------------------------------------------------------------ cell components
q.view("fine_backbone", q.top_fraction_sql("SELECT * FROM fine_cells", "total_points", "0.10::DOUBLE"))
q.view("adjacent", """SELECT a.row, a.col, b.row AS n_row, b.col AS n_col FROM fine_backbone a JOIN fine_backbone b
  ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)""")
q.components_view("bb_comp", "SELECT 0 AS g, row*1048576::BIGINT + col AS node FROM fine_backbone",
                  "SELECT 0 AS g, row*1048576::BIGINT + col AS s, n_row*1048576::BIGINT + n_col AS d FROM adjacent")


@staged
def fine_cells(i):
    return cells_op.cell_stats(i.fine_points).select("row", "col", "total_points")


@staged
def fine_backbone(i):
    return top_fraction(fine_cells(i), "total_points", 0.10).select("row", "col")


@query("adjacent_cells", "row:i col:i n_row:i n_col:i", "SELECT * FROM adjacent")
def adjacent_cells(i):
    """J16."""
    return buffers.neighbour_pairs(fine_backbone(i))


@query("backbone_components", "row:i col:i label:i", "SELECT node // 1048576 AS row, node % 1048576 AS col, label FROM bb_comp")
def backbone_components(i):
    """G1."""
    return graph.cell_components(fine_backbone(i))


q.view("bb_sizes", "SELECT label, count(*) AS size FROM bb_comp GROUP BY label")
q.view("bb_ranked", "SELECT size, sum(size) OVER o AS run, row_number() OVER o AS k, sum(size) OVER () AS total FROM bb_sizes WINDOW o AS (ORDER BY size DESC, label ROWS UNBOUNDED PRECEDING)")
q.view("bb_degrees", "SELECT b.row, b.col, count(a.n_row) AS degree FROM fine_backbone b LEFT JOIN adjacent a ON a.row = b.row AND a.col = b.col GROUP BY 1, 2")
CONTINUITY = ("n_components:i largest_component_cells:i largest_component_share:f components_covering_50pct:i components_covering_80pct:i singleton_component_share:f "
              "cells_in_le3_share:f mean_degree:f degree_le1_share:f degree_eq2_share:f degree_ge3_share:f")


q.view("continuity_row", """SELECT count(*) AS n_components, max(size) AS largest_component_cells, max(size)::DOUBLE/sum(size) AS largest_component_share,
       (SELECT min(k) FROM bb_ranked WHERE run >= 0.5*total) AS components_covering_50pct, (SELECT min(k) FROM bb_ranked WHERE run >= 0.8*total) AS components_covering_80pct,
       avg((size = 1)::INT) AS singleton_component_share, coalesce(sum(size) FILTER (size <= 3), 0)::DOUBLE/sum(size) AS cells_in_le3_share,
       (SELECT avg(degree) FROM bb_degrees) AS mean_degree, (SELECT avg((degree <= 1)::INT) FROM bb_degrees) AS degree_le1_share,
       (SELECT avg((degree = 2)::INT) FROM bb_degrees) AS degree_eq2_share, (SELECT avg((degree >= 3)::INT) FROM bb_degrees) AS degree_ge3_share FROM bb_sizes""")


@query("backbone_continuity", CONTINUITY, "SELECT * FROM continuity_row")
def backbone_continuity(i):
    """G13, W9."""
    return routes.backbone_continuity(fine_backbone(i))


q.view("bb_shapes", """SELECT label, cells, sqrt(greatest(1e-9, m + g)/greatest(1e-9, m - g)) AS pca_elongation, greatest(rs, cs)::DOUBLE/greatest(least(rs, cs), 1) AS bbox_aspect_ratio,
  (round(degrees(atan2(2*cv, vc - vr))/2.0, 9) % 180.0 + 180.0) % 180.0 AS major_axis_angle_deg FROM (
  SELECT *, (vr+vc)/2.0 AS m, sqrt(power((vr-vc)/2.0, 2) + cv*cv) AS g FROM (
    SELECT label, count(*) AS cells, var_samp(node // 1048576) AS vr, var_samp(node % 1048576) AS vc, covar_samp(node // 1048576, node % 1048576) AS cv,
    max(node // 1048576) - min(node // 1048576) + 1 AS rs, max(node % 1048576) - min(node % 1048576) + 1 AS cs FROM bb_comp GROUP BY label HAVING count(*) >= 5))""")


def shapes_of(i):
    comps = materialize(graph.cell_components(fine_backbone(i)))
    return comps, materialize(graph.component_shapes(comps))


@query("component_shapes", "label:i cells:i pca_elongation:f5 bbox_aspect_ratio:f major_axis_angle_deg:f5", "SELECT * FROM bb_shapes")
def component_shapes(i):
    """G14."""
    return shapes_of(i)[1]


def wmedian_sql(source: str, value: str, weight: str, by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    g, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return (f"SELECT {g}min({value}) AS {value} FROM (SELECT {g}{value}, sum({weight}) OVER ({p} ORDER BY {value} RANGE UNBOUNDED PRECEDING) AS run, sum({weight}) OVER ({p}) AS tot"
            f" FROM {source} WHERE {value} IS NOT NULL) WHERE run >= tot*0.5 {grp}")


@query("component_shape_summary", "components_ge5_cells:i cells_in_ge5:i cells_in_ge5_share:f largest_bbox_aspect_ratio:f largest_pca_elongation:f5 axis_axial_resultant:f5 "
       "weighted_median_pca_elongation:f5 weighted_median_bbox_aspect_ratio:f",
       f"""SELECT count(*) AS components_ge5_cells, sum(cells) AS cells_in_ge5, sum(cells)::DOUBLE/(SELECT count(*) FROM fine_backbone) AS cells_in_ge5_share,
       arg_max(bbox_aspect_ratio, row(cells, -label)) AS largest_bbox_aspect_ratio, arg_max(pca_elongation, row(cells, -label)) AS largest_pca_elongation,
       sqrt(power(sum(cos(radians(major_axis_angle_deg)*2)*cells)/sum(cells), 2) + power(sum(sin(radians(major_axis_angle_deg)*2)*cells)/sum(cells), 2)) AS axis_axial_resultant,
       (SELECT pca_elongation FROM ({wmedian_sql('bb_shapes', 'pca_elongation', 'cells')})) AS weighted_median_pca_elongation,
       (SELECT bbox_aspect_ratio FROM ({wmedian_sql('bb_shapes', 'bbox_aspect_ratio', 'cells')})) AS weighted_median_bbox_aspect_ratio FROM bb_shapes""")
def component_shape_summary(i):
    """G14 summary, G15 (weighted), A34."""
    comps, shapes = shapes_of(i)
    return graph.shape_summary(shapes, comps.agg(F.count(F.lit(1))).scalar())


q.view("moving", """SELECT c.label, yaw, major_axis_angle_deg, abs((((yaw - major_axis_angle_deg + 90.0) % 180.0) + 180.0) % 180.0 - 90.0) AS dev
  FROM fine_points p JOIN bb_comp c ON p.row*1048576::BIGINT + p.col = c.node JOIN bb_shapes s ON s.label = c.label WHERE speed >= 2.0 AND yaw IS NOT NULL""")
q.view("direction", """SELECT label, count(*) AS moving_points, sqrt(power(avg(cos(radians(yaw)*2)), 2) + power(avg(sin(radians(yaw)*2)), 2)) AS axial_resultant,
  max(major_axis_angle_deg) AS major_axis_angle_deg, quantile_cont(dev, 0.5) AS median_deviation_deg FROM moving GROUP BY label""")


@query("moving_directionality", "label:i moving_points:i axial_resultant:f5 major_axis_angle_deg:f5 median_deviation_deg:f4", "SELECT * FROM direction")
def moving_directionality(i):
    """G15, G16, P27."""
    comps, shapes = shapes_of(i)
    return routes.moving_directionality(i.fine_points, comps, shapes)


@query("moving_directionality_summary", "moving_points:i components_r_ge_08:i point_share_r_ge_08:f components_r_ge_05:i point_share_r_ge_05:f weighted_axial_resultant:f5 weighted_median_deviation_deg:f4",
       f"""SELECT sum(moving_points) AS moving_points, count(*) FILTER (axial_resultant >= 0.8) AS components_r_ge_08, coalesce(sum(moving_points) FILTER (axial_resultant >= 0.8), 0)::DOUBLE/sum(moving_points) AS point_share_r_ge_08,
       count(*) FILTER (axial_resultant >= 0.5) AS components_r_ge_05, coalesce(sum(moving_points) FILTER (axial_resultant >= 0.5), 0)::DOUBLE/sum(moving_points) AS point_share_r_ge_05,
       (SELECT axial_resultant FROM ({wmedian_sql('direction', 'axial_resultant', 'moving_points')})) AS weighted_axial_resultant,
       (SELECT median_deviation_deg FROM ({wmedian_sql('direction', 'median_deviation_deg', 'moving_points')})) AS weighted_median_deviation_deg FROM direction""")
def moving_directionality_summary(i):
    """G16."""
    comps, shapes = shapes_of(i)
    return routes.directionality_summary(routes.moving_directionality(i.fine_points, comps, shapes))


q.view("rnd_cells", f"""SELECT iter AS g, row, col FROM (SELECT iter, row, col, row_number() OVER (PARTITION BY iter ORDER BY md5('15057|' || iter::VARCHAR || '|' || row::VARCHAR || '|' || col::VARCHAR)) AS rk FROM fine_cells, {r.iters(50)})
  WHERE rk <= (SELECT count(*) FROM fine_backbone)""")
q.view("rnd_adjacent", """SELECT a.g, a.row*1048576::BIGINT + a.col AS s, b.row*1048576::BIGINT + b.col AS d FROM rnd_cells a JOIN rnd_cells b
  ON a.g = b.g AND b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 WHERE a.row <> b.row OR a.col <> b.col""")
q.components_view("rnd_comp", "SELECT g, row*1048576::BIGINT + col AS node FROM rnd_cells", "SELECT * FROM rnd_adjacent")
q.view("rnd_sizes", "SELECT g, label, count(*) AS size FROM rnd_comp GROUP BY g, label")


q.view("morphology_draws", """SELECT z.g AS iter, n_components, largest_component_share, components_covering_50pct, degree_le1_share, degree_ge3_share FROM (SELECT g, count(*) AS n_components, max(size)::DOUBLE/sum(size) AS largest_component_share FROM rnd_sizes GROUP BY g) z
       JOIN (SELECT g, min(k) AS components_covering_50pct FROM (SELECT g, sum(size) OVER (PARTITION BY g ORDER BY size DESC, label ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY g ORDER BY size DESC, label) AS k, sum(size) OVER (PARTITION BY g) AS total FROM rnd_sizes) WHERE run >= 0.5*total GROUP BY g) c USING (g)
       JOIN (SELECT g, avg((deg <= 1)::INT) AS degree_le1_share, avg((deg >= 3)::INT) AS degree_ge3_share FROM (SELECT n.g, n.row, n.col, count(a.s) AS deg FROM rnd_cells n LEFT JOIN rnd_adjacent a ON a.g = n.g AND a.s = n.row*1048576::BIGINT + n.col GROUP BY 1, 2, 3) GROUP BY g) d USING (g)""")


@query("morphology_null", "iter:i n_components:i largest_component_share:f components_covering_50pct:i degree_le1_share:f degree_ge3_share:f", "SELECT * FROM morphology_draws")
def morphology_null(i):
    """Continuity of random cell sets, all iterations in one component run."""
    size = fine_backbone(i).agg(F.count(F.lit(1))).scalar()
    drawn = rs.random_cells(fine_cells(i), size, 50, 15057).select("iter", "row", "col")
    return routes.backbone_continuity(drawn, ["iter"])


MORPHOLOGY_NULLS = {m: r.null_sql("morphology_draws", m, f"(SELECT {m} FROM continuity_row)")
                    for m in ("n_components", "components_covering_50pct", "degree_le1_share", "degree_ge3_share")}


@query("morphology_null_summary", "measure:s " + r.NULL, " UNION ALL ".join(f"SELECT '{m}' AS measure, * FROM ({v})" for m, v in MORPHOLOGY_NULLS.items()))
def morphology_null_summary(i):
    """Random cell sets against the backbone, by measure."""
    size = fine_backbone(i).agg(F.count(F.lit(1))).scalar()
    drawn = rs.random_cells(fine_cells(i), size, 50, 15057).select("iter", "row", "col")
    draws, seen = materialize(routes.backbone_continuity(drawn, ["iter"])), materialize(routes.backbone_continuity(fine_backbone(i)))
    return rs.null_summaries(draws, {m: seen.select(m).scalar() for m in MORPHOLOGY_NULLS})


q.components_view("main_bb_comp", "SELECT 0 AS g, row*1048576::BIGINT + col AS node FROM backbone", """SELECT 0 AS g, a.row*1048576::BIGINT + a.col AS s, b.row*1048576::BIGINT + b.col AS d
  FROM backbone a JOIN backbone b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1""")
q.view("without_largest", """SELECT w.* FROM windows w ANTI JOIN (SELECT node FROM main_bb_comp WHERE label = (SELECT label FROM main_bb_comp GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)) x
  ON w.row*1048576::BIGINT + w.col = x.node""")


@query("leave_largest_component_out", q.SUMMARY_SPEC, q.summary_sql("SELECT * FROM without_largest"))
def leave_largest_component_out(i):
    """R11."""
    comps = materialize(graph.cell_components(core.backbone_cells(i.occ)))
    largest = graph.component_sizes(comps).agg(F.max_by("label", F.struct("size", -F.col("label")))).scalar()
    return summarize(i.occ.join(comps.where(F.col("label") == largest), ["row", "col"], "left_anti"))


# ---------------------------------------------------------- endpoint clusters
q.view("centroids", "SELECT r_row AS row, r_col AS col, avg(lat) AS lat, avg(lon) AS lon, r_row*1048576::BIGINT + r_col AS node FROM ends GROUP BY r_row, r_col")
q.view("close_cells", f"SELECT a.node AS s, b.node AS d, {q.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist FROM centroids a JOIN centroids b ON a.node <> b.node")
q.view("merge_levels", f"SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in THRESHOLDS)}]) AS g")
q.components_view("clusters_all", "SELECT g, node FROM centroids, merge_levels", "SELECT g, s, d FROM close_cells JOIN merge_levels ON dist <= g")
q.view("clusters", f"SELECT node, label FROM clusters_all WHERE g = {MERGE}")


@staged
def centroids_of(i):
    return routes.endpoint_centroids(trips.endpoints(t.od_of(i)))


def clusters_of(i, thresholds=(MERGE,)):
    return routes.cluster_endpoints(centroids_of(i), thresholds)


@staged
def main_clusters(i):
    return clusters_of(i).drop("threshold")


@query("close_endpoint_pairs", "node_a:i node_b:i distance_m:f3", "SELECT s AS node_a, d AS node_b, dist AS distance_m FROM close_cells WHERE s < d AND dist <= 500")
def close_endpoint_pairs(i):
    """J10."""
    from airgrid.operators.spatial import pairs_within
    return pairs_within(centroids_of(i), "node", 500.0)


@query("endpoint_clusters", "threshold:f node:i label:i", "SELECT g AS threshold, node, label FROM clusters_all")
def endpoint_clusters(i):
    """Several merge distances in one run."""
    return clusters_of(i, THRESHOLDS)


q.view("cluster_nodes", "SELECT label AS cluster, avg(lat) AS centroid_lat, avg(lon) AS centroid_lon, count(*) AS member_count FROM centroids JOIN clusters USING (node) GROUP BY label")


@query("cluster_nodes", "cluster:i centroid_lat:f centroid_lon:f member_count:i", "SELECT * FROM cluster_nodes")
def cluster_nodes(i):
    """G3 centroids."""
    return routes.cluster_nodes(centroids_of(i), main_clusters(i))


q.view("linked_all", """SELECT o.*, a.g AS threshold, a.label AS source, b.label AS target FROM od o JOIN clusters_all a ON a.node = start_row*1048576::BIGINT + start_col
  JOIN clusters_all b ON b.node = end_row*1048576::BIGINT + end_col AND a.g = b.g""")
q.view("linked", f"SELECT * FROM linked_all WHERE threshold = {MERGE}")


@query("merge_sensitivity", "threshold:f clusters:i self_merged_orders:i directed_connections:i undirected_connections:i nonself_order_share:f",
       """SELECT threshold, (SELECT count(DISTINCT label) FROM clusters_all c WHERE c.g = threshold) AS clusters, count(*) FILTER (source = target) AS self_merged_orders,
       count(DISTINCT (source, target)) FILTER (source <> target) AS directed_connections, count(DISTINCT (least(source, target), greatest(source, target))) FILTER (source <> target) AS undirected_connections,
       count(*) FILTER (source <> target)::DOUBLE/count(*) AS nonself_order_share FROM linked_all GROUP BY threshold""")
def merge_sensitivity(i):
    """G4."""
    return routes.merge_sensitivity(t.od_of(i), clusters_of(i, THRESHOLDS))


q.view("route_edges", "SELECT least(source, target) AS src, greatest(source, target) AS dst, count(*) AS weight FROM linked WHERE source <> target GROUP BY 1, 2")


@staged
def linked_of(i):
    return routes.cluster_pairs(t.od_of(i), main_clusters(i))


@query("route_edges", "src:i dst:i weight:i", "SELECT * FROM route_edges")
def route_edges(i):
    """G5, P26."""
    return routes.route_edges(linked_of(i))


def metric_sql(edges: str, nodes: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    on = (lambda a, b: f"{a}.{by} = {b}.{by} AND " if by else "")
    gn = f"n.{by}, " if by else ""
    sym = f"(SELECT {g}src, dst, weight FROM {edges} UNION ALL SELECT {g}dst, src, weight FROM {edges})"
    tri = f"SELECT {('a.' + by + ', ') if by else ''}a.src AS node, count(*) AS t FROM {sym} a JOIN {sym} b ON {on('a', 'b')}a.src = b.src AND a.dst < b.dst JOIN {edges} c ON {on('a', 'c')}c.src = a.dst AND c.dst = b.dst GROUP BY ALL"
    return f"""SELECT {gn}n.node, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength, CASE WHEN coalesce(degree, 0) < 2 THEN 0.0 ELSE 2.0::DOUBLE*coalesce(t, 0)/(degree*(degree-1)) END AS clustering
      FROM ({nodes}) n LEFT JOIN (SELECT {g}src AS node, count(*) AS degree, sum(weight) AS strength FROM {sym} GROUP BY ALL) d ON {on('d', 'n')}d.node = n.node LEFT JOIN ({tri}) x ON {on('x', 'n')}x.node = n.node"""


q.view("route_nodes", metric_sql("route_edges", "SELECT DISTINCT label AS node FROM clusters"))


@query("route_node_metrics", "node:i degree:i strength:i clustering:f", "SELECT * FROM route_nodes")
def route_node_metrics(i):
    """G6, G7."""
    clusters = main_clusters(i)
    edges, nodes = materialize(routes.route_edges(routes.cluster_pairs(t.od_of(i), clusters))), clusters.select(F.col("label").alias("node")).distinct()
    degrees = materialize(graph.degree_table(edges, nodes))
    return degrees.join(graph.local_clustering(edges, degrees), "node")


def network_of(i, table=routes.network_nodes):
    clusters = main_clusters(i)
    edges = routes.route_edges(routes.cluster_pairs(t.od_of(i), clusters))
    return table(edges, clusters.select(F.col("label").alias("node")))


q.components_view("route_comp", "SELECT DISTINCT 0 AS g, label AS node FROM clusters", "SELECT 0 AS g, src AS s, dst AS d FROM route_edges UNION ALL SELECT 0, dst, src FROM route_edges")
_NODES = "SELECT DISTINCT 0 AS g, label AS node FROM clusters"
q.betweenness_view("bc_hops", "SELECT 0 AS g, src, dst, 1.0::DOUBLE AS cost FROM route_edges", _NODES)
q.betweenness_view("bc_flow", "SELECT 0 AS g, src, dst, 1.0::DOUBLE/weight AS cost FROM route_edges", _NODES)
_NORM = "CASE WHEN {n} <= 2 THEN 0.0 ELSE 2.0::DOUBLE*{b}/(({n}-1)*({n}-2)) END"


@query("route_network_betweenness", "node:i degree:i component:i component_size:i betweenness_unweighted:f betweenness_unweighted_norm:f betweenness_invflow:f betweenness_invflow_norm:f",
       f"""SELECT node, degree, label AS component, count(*) OVER (PARTITION BY label) AS component_size, h.bc AS betweenness_unweighted, {_NORM.format(n='(SELECT count(*) FROM route_nodes)', b='h.bc')} AS betweenness_unweighted_norm,
       f.bc AS betweenness_invflow, {_NORM.format(n='(SELECT count(*) FROM route_nodes)', b='f.bc')} AS betweenness_invflow_norm FROM route_nodes JOIN route_comp USING (node) JOIN bc_hops h USING (node) JOIN bc_flow f USING (node)""")
def route_network_betweenness(i):
    """G8, G9, G10 (also checked against path enumeration in the tests)."""
    return network_of(i)


NETWORK = ("nodes:i edges:i density:f components:i largest_component_nodes:i largest_component_share:f average_degree:f average_strength:f max_degree:i max_strength:i "
           "mean_local_clustering:f degree_0_share:f degree_1_share:f degree_2_share:f degree_ge3_share:f degree_gini:f strength_gini:f")


def gini_sql(source: str, value: str, by: str = "") -> str:
    p = f"PARTITION BY {by} " if by else ""
    g, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return (f"SELECT {g}CASE WHEN sum({value}) > 0 THEN 2.0*sum(k*{value})/(count(*)*sum({value})::DOUBLE) - (count(*)+1.0)/count(*)::DOUBLE ELSE 0.0 END AS gini"
            f" FROM (SELECT {g}{value}, row_number() OVER ({p}ORDER BY {value}) AS k FROM {source}) {grp}")


def network_sql(nodes: str, comp: str, by: str = "") -> str:
    g, grp, using = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    return f"""SELECT * FROM (SELECT {g}count(*) AS nodes, sum(degree)/2 AS edges, CASE WHEN count(*) > 1 THEN sum(degree)::DOUBLE/(count(*)*(count(*)-1)) ELSE 0.0 END AS density, avg(degree) AS average_degree,
      avg(strength) AS average_strength, max(degree) AS max_degree, max(strength) AS max_strength, avg(clustering) AS mean_local_clustering, avg((degree = 0)::INT) AS degree_0_share, avg((degree = 1)::INT) AS degree_1_share,
      avg((degree = 2)::INT) AS degree_2_share, avg((degree >= 3)::INT) AS degree_ge3_share FROM {nodes} {grp}) a
      JOIN (SELECT {g}count(*) AS components, max(size) AS largest_component_nodes, max(size)::DOUBLE/sum(size) AS largest_component_share FROM (SELECT {g}label, count(*) AS size FROM {comp} GROUP BY ALL) {grp}) b {using}
      JOIN (SELECT {g}gini AS degree_gini FROM ({gini_sql(nodes, 'degree', by)})) c {using} JOIN (SELECT {g}gini AS strength_gini FROM ({gini_sql(nodes, 'strength', by)})) d {using}"""




@query("route_network_summary", NETWORK, network_sql("route_nodes", "route_comp"))
def route_network_summary(i):
    """G6."""
    return routes.network_summary(materialize(network_of(i, routes.network_measures)))


@query("top_nodes_by_strength", "node:i strength:i degree:i", "SELECT node, strength, degree FROM route_nodes ORDER BY strength DESC, degree DESC, node LIMIT 10")
def top_nodes_by_strength(i):
    """W10."""
    clusters = main_clusters(i)
    edges = routes.route_edges(routes.cluster_pairs(t.od_of(i), clusters))
    table = graph.degree_table(materialize(edges), clusters.select(F.col("label").alias("node")))
    return table.orderBy(F.desc("strength"), F.desc("degree"), "node").limit(10)


# ------------------------------------------------------------- vendor graphs
q.view("vendor_edges", "SELECT vendor, least(source, target) AS src, greatest(source, target) AS dst, count(*) AS weight FROM linked WHERE source <> target GROUP BY 1, 2, 3")
q.view("vendor_node_set", "SELECT DISTINCT vendor, node FROM (SELECT vendor, src AS node FROM vendor_edges UNION ALL SELECT vendor, dst FROM vendor_edges)")
q.view("vendor_nodes", metric_sql("vendor_edges", "SELECT * FROM vendor_node_set", "vendor"))
q.components_view("vendor_comp_g", "SELECT vendor AS g, node FROM vendor_node_set", "SELECT vendor AS g, src AS s, dst AS d FROM vendor_edges UNION ALL SELECT vendor, dst, src FROM vendor_edges")
q.view("vendor_comp", "SELECT g AS vendor, node, label FROM vendor_comp_g")
q.view("vendor_network", network_sql("vendor_nodes", "vendor_comp", "vendor"))


def vendor_graph(i):
    edges = materialize(routes.route_edges(linked_of(i), ["vendor"]))
    nodes = graph.symmetric(edges, ["vendor"]).select("vendor", F.col("src").alias("node")).distinct()
    return edges, nodes


def vendor_summary(i):
    return routes.network_summary(materialize(routes.network_measures(*vendor_graph(i), ["vendor"])), ["vendor"])


@query("vendor_network_summary", "vendor:s " + NETWORK, "SELECT * FROM vendor_network")
def vendor_network_summary(i):
    """G11."""
    return vendor_summary(i)


q.betweenness_view("bc_vendor", "SELECT vendor AS g, src, dst, 1.0::DOUBLE/weight AS cost FROM vendor_edges", "SELECT vendor AS g, node FROM vendor_node_set")


@query("vendor_network_betweenness", "vendor:s node:i degree:i betweenness_invflow:f betweenness_invflow_norm:f",
       f"""SELECT v.vendor, v.node, degree, bc AS betweenness_invflow, {_NORM.format(n='n', b='bc')} AS betweenness_invflow_norm FROM vendor_nodes v JOIN bc_vendor b ON b.g = v.vendor AND b.node = v.node
       JOIN (SELECT vendor, count(*) AS n FROM vendor_node_set GROUP BY 1) c ON c.vendor = v.vendor""")
def vendor_network_betweenness(i):
    """G11 centrality, both vendor graphs in the same rounds."""
    return routes.network_nodes(*vendor_graph(i), ["vendor"], unweighted=False)


@query("vendor_network_report", "vendor:s nodes:i edges:i components:i largest_component_share_pct:f mean_local_clustering:f average_degree:f max_degree:i max_strength:i",
       """SELECT vendor, nodes, edges, components, round(largest_component_share*100, 1) AS largest_component_share_pct, round(mean_local_clustering, 3) AS mean_local_clustering,
       round(average_degree, 2) AS average_degree, max_degree, max_strength FROM vendor_network""")
def vendor_network_report(i):
    """G12."""
    return routes.network_report(vendor_summary(i))


_OVERLAP = "left_size:i right_size:i shared:i either:i left_only:i right_only:i jaccard:f"


@query("vendor_edge_overlap", _OVERLAP,
       """SELECT *, left_size + right_size - shared AS either, left_size - shared AS left_only, right_size - shared AS right_only, shared::DOUBLE/(left_size + right_size - shared) AS jaccard FROM (
       SELECT (SELECT count(*) FROM vendor_edges WHERE vendor = 'MT') AS left_size, (SELECT count(*) FROM vendor_edges WHERE vendor = 'SF') AS right_size,
       (SELECT count(*) FROM vendor_edges a JOIN vendor_edges b ON a.src = b.src AND a.dst = b.dst WHERE a.vendor = 'MT' AND b.vendor = 'SF') AS shared)""")
def vendor_edge_overlap(i):
    """J17, G11 overlap."""
    edges = materialize(routes.route_edges(linked_of(i), ["vendor"]))
    pick = lambda v: edges.where(F.col("vendor") == v)
    return buffers.set_overlap(pick("MT"), pick("SF"), ["src", "dst"])


@query("vendor_node_overlap", _OVERLAP,
       """SELECT *, left_size + right_size - shared AS either, left_size - shared AS left_only, right_size - shared AS right_only, shared::DOUBLE/(left_size + right_size - shared) AS jaccard FROM (
       SELECT count(*) FILTER (mt) AS left_size, count(*) FILTER (sf) AS right_size, count(*) FILTER (mt AND sf) AS shared FROM (
         SELECT node, bool_or(vendor = 'MT') AS mt, bool_or(vendor = 'SF') AS sf FROM vendor_node_set GROUP BY node))""")
def vendor_node_overlap(i):
    """G11 overlap of nodes."""
    nodes = materialize(vendor_graph(i)[1])
    pick = lambda v: nodes.where(F.col("vendor") == v)
    return buffers.set_overlap(pick("MT"), pick("SF"), ["node"])


@query("vendor_node_table", "vendor:s node:i centroid_lat:f centroid_lon:f member_count:i degree:i strength:i clustering:f component:i component_size:i betweenness_invflow:f betweenness_invflow_norm:f",
       f"""SELECT v.vendor, v.node, centroid_lat, centroid_lon, member_count, degree, strength, clustering, p.label AS component, z.size AS component_size, bc AS betweenness_invflow, {_NORM.format(n='n', b='bc')} AS betweenness_invflow_norm
       FROM vendor_nodes v JOIN bc_vendor b ON b.g = v.vendor AND b.node = v.node JOIN cluster_nodes k ON k.cluster = v.node JOIN vendor_comp p ON p.vendor = v.vendor AND p.node = v.node
       JOIN (SELECT vendor, label, count(*) AS size FROM vendor_comp GROUP BY 1, 2) z ON z.vendor = v.vendor AND z.label = p.label JOIN (SELECT vendor, count(*) AS n FROM vendor_node_set GROUP BY 1) c ON c.vendor = v.vendor""")
def vendor_node_table(i):
    """G11 node table of both vendors."""
    measured = routes.network_nodes(*vendor_graph(i), ["vendor"], unweighted=False)
    places = routes.cluster_nodes(centroids_of(i), main_clusters(i)).withColumnRenamed("cluster", "node")
    return measured.join(places, "node")


# ------------------------------------------------------------ road comparison
q.view("od_trips", """SELECT l.source, l.target, t.vendor, t.path_length_km, t.duration_minutes, t.od_distance_km FROM linked l JOIN trips t USING (order_id)
  WHERE duration_minutes > 0 AND od_distance_km > 0""")
q.view("directed_edges", """SELECT *, printf('%.6f,%.6f;%.6f,%.6f', a.centroid_lon, a.centroid_lat, b.centroid_lon, b.centroid_lat) AS route_key, a.centroid_lat AS source_lat, a.centroid_lon AS source_lon, b.centroid_lat AS target_lat, b.centroid_lon AS target_lon FROM (
  SELECT source, target, count(*) AS order_support, avg(path_length_km) AS mean_air_distance_km, avg(duration_minutes) AS mean_air_duration_min, avg((vendor = 'SF')::INT) AS sf_order_share,
   quantile_cont(path_length_km, 0.5) AS median_air_distance_km, quantile_cont(duration_minutes, 0.5) AS median_air_duration_min, quantile_cont(od_distance_km, 0.5) AS median_od_distance_km
  FROM od_trips WHERE source <> target GROUP BY 1, 2) e JOIN cluster_nodes a ON a.cluster = e.source JOIN cluster_nodes b ON b.cluster = e.target""")


def od_trips(i):
    """OD pairs with positive trip length and duration."""
    joined = trips.pairs_with_lengths(t.paths_of(i), t.refined_extent_of(i), GRID.size_m)
    return joined.where((F.col("duration_minutes") > 0) & (F.col("od_distance_km") > 0))


def directed_of(i):
    clusters = main_clusters(i)
    nodes = materialize(routes.cluster_nodes(centroids_of(i), clusters))
    linked = routes.cluster_pairs(od_trips(i), clusters).select("source", "target", "vendor", "path_length_km", "duration_minutes", "od_distance_km")
    return materialize(routes.directed_edges(materialize(linked), nodes)), nodes


@query("od_with_trips", "order_id:s start_row:i start_col:i path_length_km:f duration_minutes:f od_distance_km:f",
       "SELECT o.order_id, start_row, start_col, path_length_km, duration_minutes, od_distance_km FROM od o JOIN trips t USING (order_id) WHERE duration_minutes > 0 AND od_distance_km > 0")
def od_with_trips(i):
    """J2."""
    return od_trips(i)


@query("directed_route_edges", "source:i target:i order_support:i mean_air_distance_km:f mean_air_duration_min:f8 sf_order_share:f median_air_distance_km:f median_air_duration_min:f8 median_od_distance_km:f",
       "SELECT * FROM directed_edges")
def directed_route_edges(i):
    """A33."""
    return directed_of(i)[0]


@query("cluster_out_degrees", "cluster:i member_count:i out_degree:i out_strength_orders:i",
       """SELECT cluster, member_count, coalesce(d, 0) AS out_degree, coalesce(s, 0) AS out_strength_orders FROM cluster_nodes LEFT JOIN (
       SELECT source, count(*) AS d, sum(order_support) AS s FROM directed_edges GROUP BY source) ON source = cluster""")
def cluster_out_degrees(i):
    """A33 nodes."""
    edges, nodes = directed_of(i)
    return routes.out_degrees(edges, nodes)


# answers of a routing service: early failures, final answers, repeated final answers, and routes without any
_METRES = f"1.4*{q.haversine('source_lat', 'source_lon', 'target_lat', 'target_lon')}"
_FINAL = f"CASE WHEN (source + 7*target) % 11 = 0 THEN 'NoRoute' ELSE 'Ok' END AS status, {_METRES}"
q.view("road_file", f"""SELECT route_key, 1 AS attempt, 'Ok' AS status, 1.0::DOUBLE AS distance_m, 1.0::DOUBLE AS duration_s FROM directed_edges WHERE source % 5 = 0
  UNION ALL SELECT route_key, 2, {_FINAL} AS distance_m, {_METRES}/7.5 AS duration_s FROM directed_edges WHERE (source + target) % 13 <> 0
  UNION ALL SELECT route_key, 2, {_FINAL}*1.25 AS distance_m, {_METRES}/6.0 AS duration_s FROM directed_edges WHERE (source + target) % 13 <> 0 AND target % 3 = 0""")
q.view("road_attempts", "SELECT route_key, r.distance_m AS distance_m, r.duration_s AS duration_s, r.status AS status FROM (SELECT route_key, max({'attempt': attempt, 'distance_m': distance_m, 'duration_s': duration_s, 'status': status}) AS r FROM road_file GROUP BY route_key)")


def road_attempts(edges):
    metres = haversine_m(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon")) * 1.4
    status = F.when((F.col("source") + F.col("target") * 7) % 11 == 0, "NoRoute").otherwise("Ok")
    answered = edges.where((F.col("source") + F.col("target")) % 13 != 0)
    final = answered.select("route_key", F.lit(2).alias("attempt"), status.alias("status"), metres.alias("distance_m"), (metres / 7.5).alias("duration_s"))
    again = answered.where(F.col("target") % 3 == 0).select("route_key", F.lit(2).alias("attempt"), status.alias("status"), (metres * 1.25).alias("distance_m"), (metres / 6.0).alias("duration_s"))
    early = edges.where(F.col("source") % 5 == 0).select("route_key", F.lit(1).alias("attempt"), F.lit("Ok").alias("status"), F.lit(1.0).alias("distance_m"), F.lit(1.0).alias("duration_s"))
    return early.unionByName(final).unionByName(again)


def routed_of(i):
    """The lookup goes through its file and reader."""
    edges, _ = directed_of(i)
    path = table_path(i.spark, "roads")
    sinks.write_table(road_attempts(edges), path, fmt="csv")
    return routes.with_road_metrics(edges, routes.latest_lookup(tables.read_road_lookup(i.spark, path)))


_D = ("osrm", "peak25", "bus1757")
q.view("routed", f"""SELECT *, {t.bin_sql('median_air_distance_km')} AS dist_bin, road_distance_km/median_air_distance_km AS road_to_air_distance_ratio, road_distance_km/median_od_distance_km AS road_to_od_distance_ratio,
  {', '.join(f'road_duration_{k}_min - median_air_duration_min AS time_delta_{k}_min, road_duration_{k}_min - median_air_duration_min > 0 AS aerial_faster_{k}' for k in _D)} FROM (
  SELECT e.*, status, distance_m/1000.0 AS road_distance_km, duration_s/60.0 AS road_duration_osrm_min, 60.0*distance_m/1000.0/25.0 AS road_duration_peak25_min, 60.0*distance_m/1000.0/17.57 AS road_duration_bus1757_min
  FROM directed_edges e JOIN road_attempts a USING (route_key) WHERE status = 'Ok')""")


@query("road_metrics", "source:i target:i road_distance_km:f5 road_duration_osrm_min:f5 road_duration_peak25_min:f5 road_duration_bus1757_min:f5 road_to_air_distance_ratio:f5 road_to_od_distance_ratio:f5 "
       "time_delta_osrm_min:f4 time_delta_peak25_min:f4 time_delta_bus1757_min:f4 aerial_faster_osrm:b aerial_faster_peak25:b aerial_faster_bus1757:b dist_bin:s", "SELECT * FROM routed")
def road_metrics(i):
    """P20, S5, W11."""
    return routed_of(i)


_MED = routes.ROAD_MEDIANS
q.view("routed_scoped", "SELECT unnest(['all', coalesce(dist_bin, 'outside')]) AS scope, * FROM routed")


@query("road_comparison", "scope:s n_directed_routes:i n_orders:i share_faster_osrm:f share_faster_peak25:f share_faster_bus1757:f " + " ".join(f"{m}:f4" for m in _MED),
       "SELECT * FROM (SELECT scope, count(*) AS n_directed_routes, sum(order_support) AS n_orders, "
       + ", ".join(f"sum(order_support*aerial_faster_{k}::INT)::DOUBLE/sum(order_support) AS share_faster_{k}" for k in _D) + " FROM routed_scoped GROUP BY scope) "
       + " ".join(f"JOIN ({wmedian_sql('routed_scoped', m, 'order_support', 'scope')}) m{k} USING (scope)" for k, m in enumerate(_MED)))
def road_comparison(i):
    """C20, A34."""
    return routes.road_comparison(routed_of(i))


@query("top_route_edges", "source:i target:i order_support:i", "SELECT source, target, order_support FROM routed ORDER BY order_support DESC, source, target LIMIT 60")
def top_route_edges(i):
    """W10 (60 edges)."""
    return routed_of(i).orderBy(F.desc("order_support"), "source", "target").limit(60)


# ------------------------------------------------------------ repeated routes
q.view("moves", "SELECT order_id, least(row(p_row, p_col), row(row, col)) AS a, greatest(row(p_row, p_col), row(row, col)) AS b FROM visits WHERE p_row IS NOT NULL")
q.view("edge_support", "SELECT a, b, count(*) AS traversals, count(DISTINCT order_id) AS support FROM moves GROUP BY a, b")
_AB = "a_row:i a_col:i b_row:i b_col:i "
_AB_SQL = "a[1] AS a_row, a[2] AS a_col, b[1] AS b_row, b[2] AS b_col"


@staged
def visits_of(i):
    return compress_visits(i.points).select("order_id", "datetime", "longitude", "latitude", "speed", "altitude", "row", "col", "previous")


def _flat(df):
    return df.select("*", *[F.col(f"node_{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("row", "col")])


@query("edge_support", _AB + "traversals:i support:i", f"SELECT {_AB_SQL}, traversals, support FROM edge_support")
def edge_support(i):
    """G17."""
    return _flat(routes.edge_support(transitions(compress_visits(i.points))))


@query("skeleton_edges", _AB + "support:i", f"SELECT {_AB_SQL}, support FROM edge_support WHERE support >= 5")
def skeleton_edges(i):
    """G20."""
    return _flat(routes.skeleton(routes.edge_support(transitions(compress_visits(i.points))), 5))


q.view("ranked_edges", f"SELECT *, row_number() OVER (ORDER BY support DESC, a[1], a[2], b[1], b[2]) AS rk, count(*) OVER () AS nn FROM edge_support")


@query("edge_support_summary", "edges:i support_p50:f support_p90:f support_max:i traversal_p50:f traversal_p90:f traversal_max:i top_01pct_share:f top_1pct_share:f",
       """SELECT count(*) AS edges, quantile_cont(support, 0.5) AS support_p50, quantile_cont(support, 0.9) AS support_p90, max(support) AS support_max, quantile_cont(traversals, 0.5) AS traversal_p50,
       quantile_cont(traversals, 0.9) AS traversal_p90, max(traversals) AS traversal_max, sum(traversals) FILTER (rk <= greatest(1, floor(nn*0.001::DOUBLE)))::DOUBLE/sum(traversals) AS top_01pct_share,
       sum(traversals) FILTER (rk <= greatest(1, floor(nn*0.01::DOUBLE)))::DOUBLE/sum(traversals) AS top_1pct_share FROM ranked_edges""")
def edge_support_summary(i):
    """G17 summary."""
    edges = materialize(routes.edge_support(transitions(compress_visits(i.points))))
    return routes.edge_support_summary(edges, {"top_01pct_share": 0.001, "top_1pct_share": 0.01})


q.view("signatures", "SELECT sig, count(*) AS orders FROM (SELECT order_id, string_agg(row::VARCHAR || '_' || col::VARCHAR, '>' ORDER BY seq_index) AS sig, count(*) AS n FROM visit_seq GROUP BY order_id) WHERE n >= 2 GROUP BY sig")


@query("route_signatures", "unique_signatures:i share_orders_support_ge_2:f share_orders_support_ge_5:f top_1_share:f top_10_share:f max_orders:i",
       """SELECT count(*) AS unique_signatures, coalesce(sum(orders) FILTER (orders >= 2), 0)::DOUBLE/sum(orders) AS share_orders_support_ge_2, coalesce(sum(orders) FILTER (orders >= 5), 0)::DOUBLE/sum(orders) AS share_orders_support_ge_5,
       max(orders)::DOUBLE/sum(orders) AS top_1_share, (SELECT sum(orders) FROM (SELECT orders FROM signatures ORDER BY orders DESC LIMIT 10))::DOUBLE/sum(orders) AS top_10_share, max(orders) AS max_orders FROM signatures""")
def route_signature_summary(i):
    """G18."""
    return routes.signature_summary(materialize(route_signatures(compress_visits(i.points))))


@query("sequence_summary", "orders:i median_length_cells:f median_unique_cells:f edge_traversals:i",
       """SELECT count(*) AS orders, quantile_cont(v, 0.5) AS median_length_cells, quantile_cont(u, 0.5) AS median_unique_cells, (SELECT count(*) FROM moves) AS edge_traversals
       FROM (SELECT order_id, count(*) AS v, count(DISTINCT (row, col)) AS u FROM visits GROUP BY order_id HAVING count(*) >= 2)""")
def sequence_summary(i):
    visits = visits_of(i)
    return routes.sequence_summary(visits, transitions(visits))


q.view("sk_levels", f"SELECT unnest({list(SUPPORTS)}) AS g")
q.view("sk_edges", "SELECT g, a[1]*1048576::BIGINT + a[2] AS s, b[1]*1048576::BIGINT + b[2] AS d, support FROM edge_support JOIN sk_levels ON support >= g")
q.view("sk_nodes", "SELECT DISTINCT g, node FROM (SELECT g, s AS node FROM sk_edges UNION ALL SELECT g, d FROM sk_edges)")
q.components_view("sk_comp", "SELECT * FROM sk_nodes", "SELECT g, s, d FROM sk_edges UNION ALL SELECT g, d, s FROM sk_edges")
q.view("sk_cover", """SELECT g, order_id, avg((support >= g)::INT) AS ec FROM moves m JOIN edge_support e ON m.a = e.a AND m.b = e.b, sk_levels GROUP BY g, order_id""")
q.view("node_best", "SELECT node, max(support) AS support FROM (SELECT a AS node, support FROM edge_support UNION ALL SELECT b, support FROM edge_support) GROUP BY node")
q.view("sk_node_cover", """SELECT g, order_id, avg((support >= g)::INT) AS nc FROM (SELECT DISTINCT order_id, row(row, col) AS node FROM visits WHERE order_id IN (SELECT order_id FROM moves)) v JOIN node_best USING (node), sk_levels GROUP BY g, order_id""")


@query("skeleton_sensitivity", "threshold:i edges:i nodes:i components:i largest_component_share:f mean_degree:f backbone_coverage:f nodes_in_backbone_share:f jaccard_with_backbone:f mean_edge_coverage:f "
       "median_edge_coverage:f p25_edge_coverage:f share_orders_ge_80pct:f mean_node_coverage:f",
       """SELECT g AS threshold, coalesce(edges, 0) AS edges, coalesce(nodes, 0) AS nodes, coalesce(components, 0) AS components, big::DOUBLE/nodes AS largest_component_share, edges*2.0::DOUBLE/nodes AS mean_degree,
       shared::DOUBLE/nb AS backbone_coverage, shared::DOUBLE/nodes AS nodes_in_backbone_share, shared::DOUBLE/(nb + nodes - shared) AS jaccard_with_backbone, mean_edge_coverage, median_edge_coverage, p25_edge_coverage, share_orders_ge_80pct, mean_node_coverage
       FROM (SELECT g, avg(ec) AS mean_edge_coverage, quantile_cont(ec, 0.5) AS median_edge_coverage, quantile_cont(ec, 0.25) AS p25_edge_coverage, avg((ec >= 0.8)::INT) AS share_orders_ge_80pct FROM sk_cover GROUP BY g)
       JOIN (SELECT g, avg(nc) AS mean_node_coverage FROM sk_node_cover GROUP BY g) USING (g) LEFT JOIN (SELECT g, count(*) AS edges FROM sk_edges GROUP BY g) USING (g)
       LEFT JOIN (SELECT g, count(*) AS components, sum(size) AS nodes, max(size) AS big FROM (SELECT g, label, count(*) AS size FROM sk_comp GROUP BY ALL) GROUP BY g) USING (g)
       LEFT JOIN (SELECT g, count(*) FILTER (b.row IS NOT NULL) AS shared FROM sk_nodes n LEFT JOIN backbone b ON n.node = b.row*1048576::BIGINT + b.col GROUP BY g) USING (g), (SELECT count(*) AS nb FROM backbone)""")
def skeleton_sensitivity(i):
    """G19, G2."""
    visits = visits_of(i)
    return routes.skeleton_sensitivity(visits, transitions(visits), core.backbone_cells(i.occ), SUPPORTS)


# ----------------------------------------------------------------- route-days
q.view("route_days", """SELECT order_id, strftime(start_time, '%Y-%m-%d') AS date, least(source, target)::VARCHAR || '_' || greatest(source, target)::VARCHAR AS route_id,
  least(source, target)::VARCHAR || '_' || greatest(source, target)::VARCHAR || '_' || strftime(start_time, '%Y-%m-%d') AS route_day FROM linked WHERE source <> target""")
q.view("route_day_points", "SELECT p.*, route_day FROM points p JOIN route_days d ON p.order_id = d.order_id AND strftime(window_start, '%Y-%m-%d') = d.date")


def route_days_of(i):
    ends = [F.least("source", "target").cast("string"), F.greatest("source", "target").cast("string")]
    linked = linked_of(i).where(F.col("source") != F.col("target")).withColumn("date", F.date_format("start_time", "yyyy-MM-dd"))
    return linked.select("order_id", "date", F.concat_ws("_", *ends).alias("route_id"), F.concat_ws("_", *ends, "date").alias("route_day"))


def unique_right_join(points, mapping):
    """Inner join that fails when the mapping has two rows for one key."""
    keys = ["order_id", "date"]
    checked = mapping.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("route_day").alias("route_day"), F.max("route_id").alias("route_id"))
    fail = F.raise_error(F.lit("mapping is not unique per order and date")).cast("string")
    checked = checked.withColumn("route_day", F.when(F.col("_n") == 1, F.col("route_day")).otherwise(fail)).drop("_n")
    return points.join(checked, keys)


@staged
def route_day_parts(i):
    dated = cells_op.with_window(i.points, WINDOW).withColumn("date", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
    return cells_op.contributions(unique_right_join(dated, route_days_of(i)), WINDOW, "route_day")


@query("route_day_contributions", "route_day:s row:i col:i window_start:t n_points:i speed_sum:f",
       "SELECT route_day, row, col, window_start, count(*) AS n_points, sum(speed) AS speed_sum FROM route_day_points GROUP BY ALL")
def route_day_contributions(i):
    """A36, J3."""
    return route_day_parts(i)


q.view("top_route_days", """SELECT route_day FROM (SELECT route_day, sum(n) AS pts, count(*) AS cw FROM (SELECT route_day, row, col, window_start, count(*) AS n FROM route_day_points GROUP BY ALL) GROUP BY 1)
  ORDER BY pts DESC, cw DESC, route_day LIMIT 50""")


@query("leave_top_route_days_out", "route_day:s " + q.SUMMARY_SPEC,
       "SELECT *, fold AS route_day FROM (" + q.summary_sql("SELECT f.route_day AS fold, row, col, window_start, count(*) AS n_points, avg(speed) AS mean_speed FROM route_day_points p, top_route_days f WHERE p.route_day <> f.route_day GROUP BY ALL", "fold") + ")")
def leave_top_route_days_out(i):
    """R14, W10."""
    parts = route_day_parts(i)
    sizes = parts.groupBy("route_day").agg(F.sum("n_points").alias("p"), F.count(F.lit(1)).alias("w"))
    top = sizes.orderBy(F.desc("p"), F.desc("w"), "route_day").limit(50).select("route_day")
    return rb.leave_selected_groups_out(parts, "route_day", top)


@query("route_day_bootstrap", r._boot_spec("rr", "odds_ratio"),
       r.boot_summary_sql("(" + r.cluster_sql("SELECT * FROM route_day_points", "route_day", 200, 20260405) + ")", {"rr": "rr", "odds_ratio": "odds_ratio"}))
def route_day_bootstrap(i):
    """R15."""
    draws = rs.cluster_bootstrap(route_day_parts(i), "route_day", core.backbone_cells(i.occ), core.rho_star(i.occ), 200, 20260405)
    return rs.bootstrap_summary(draws, ["rr", "odds_ratio"])
