"""Flow, density and speed per cell-window from distinct and entering flights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.operators.cells import flight_windows, in_set, with_window
from airgrid.operators.curves import binned_relation
from airgrid.operators.percentiles import exact_percentiles
from airgrid.operators.sequences import compress_visits
from airgrid.operators.trips import distance_bin
from airgrid.session import materialize
from airgrid.spec import WindowSpec


def entries(points: DataFrame, window: WindowSpec) -> DataFrame:
    """Distinct orders entering each cell-window."""
    return with_window(compress_visits(points), window).groupBy("row", "col", "window_start").agg(
        F.count_distinct("order_id").alias("flow_entries"))


def operational_table(points: DataFrame, window: WindowSpec) -> DataFrame:
    """Density (distinct flights), mean speed and entry flow per cell-window."""
    base = flight_windows(points, window).withColumnsRenamed({"n_unique": "density_unique_flights", "mean_speed": "speed_mean"})
    out = base.join(entries(points, window), ["row", "col", "window_start"], "left").na.fill(0, ["flow_entries"])
    out = out.withColumn("flow_entries_per_hour", F.col("flow_entries") * F.lit(3600.0 / window.seconds))
    return out.where((F.col("density_unique_flights") > 0) & (F.col("speed_mean") > 0)).withColumns({
        "window_date": F.to_date("window_start"),
        "spacing_surrogate_m": F.lit(100.0) / F.greatest(F.col("density_unique_flights"), F.lit(1))})


def _long(table: DataFrame, specs: list[tuple[str, str, str, float]]) -> DataFrame:
    """One row per (window, relation) with its x, y and bin width."""
    parts = F.array(*[F.struct(F.lit(n).alias("relation"), F.col(x).cast("double").alias("x"),
                               F.col(y).cast("double").alias("y"), F.lit(float(w)).alias("width")) for n, x, y, w in specs])
    keep = [c for c in ("subset",) if c in table.columns]
    return table.select(*keep, F.explode(parts).alias("r")).select(*keep, "r.relation", "r.x", "r.y", "r.width")


def zero_based_relations(table: DataFrame) -> DataFrame:
    """Speed-density, flow-density and flow-speed relations with bins from zero."""
    specs = [("v_k", "density_unique_flights", "speed_mean", 1.0), ("q_k", "density_unique_flights", "flow_entries_per_hour", 1.0),
             ("q_v", "speed_mean", "flow_entries_per_hour", 0.5)]
    table = materialize(table.select(*sorted({c for _, x, y, _ in specs for c in (x, y)})))
    return binned_relation(_long(table, specs), "x", "y", bin_width="width", by=["relation"])


def anchored_relations(table: DataFrame, endpoint_buffer: DataFrame) -> DataFrame:
    """Four relations for all windows and for windows away from endpoints, bins from the smallest x."""
    specs = [("speed_vs_density", "density_unique_flights", "speed_mean", 1.0),
             ("speed_vs_flow", "flow_entries_per_hour", "speed_mean", 6.0),
             ("flow_vs_density", "density_unique_flights", "flow_entries_per_hour", 1.0),
             ("speed_vs_spacing", "spacing_surrogate_m", "speed_mean", 4.0)]
    # written once: the bins read it for their origins, their means and twice for their quartiles
    flagged = materialize(in_set(table.select("row", "col", *sorted({c for _, x, y, _ in specs for c in (x, y)})), endpoint_buffer, "near"))
    subsets = F.when(F.col("near"), F.array(F.lit("all_windows"))).otherwise(
        F.array(F.lit("all_windows"), F.lit("away_from_endpoint")))
    both = flagged.withColumn("subset", F.explode(subsets))
    return binned_relation(_long(both, specs), "x", "y", bin_width="width", by=["subset", "relation"], origin=None)


def speed_by_phase(points: DataFrame, trip_table: DataFrame, endpoint_buffer: DataFrame) -> DataFrame:
    """Point speeds with phase (near or away from endpoints) and the trip's distance bin and vendor."""
    info = trip_table.withColumn("dist_bin", distance_bin(F.col("path_length_km"))).where(F.col("dist_bin").isNotNull())
    info = info.select("order_id", "dist_bin", "path_length_km", "duration_minutes", F.col("vendor").alias("trip_vendor"))
    flagged = in_set(points.select("order_id", "row", "col", F.col("speed").alias("point_speed")), endpoint_buffer, "near")
    phase = F.when(F.col("near"), "Endpoint-adjacent").otherwise("Away from endpoint")
    return flagged.join(info, "order_id").withColumn("phase", phase).drop("near")


def speed_by_phase_summary(points: DataFrame, trip_table: DataFrame, endpoint_buffer: DataFrame) -> DataFrame:
    by = ["phase", "dist_bin"]
    # written once: means and percentiles would each join the points again
    data = materialize(speed_by_phase(points, trip_table, endpoint_buffer).select(*by, "point_speed"))
    means = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("point_speed").alias("mean_speed"))
    return means.join(exact_percentiles(data, "point_speed", {"median_speed": .5}, width=0.05, by=by), by)
