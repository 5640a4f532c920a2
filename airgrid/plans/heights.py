"""Endpoint heights above ground against terrain and buildings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.operators.joins import resolved
from airgrid.operators.percentiles import exact_percentiles
from airgrid.operators.spatial import nearest, within_radius
from airgrid.session import materialize
from airgrid.spec import BUILDING_RADIUS_M, GROUND_LIKE_M, HEIGHT_TOLERANCE_M, STATION_ADJACENT_M

_POS = ("median_lat", "median_lon")


def terrain_key(lat: str, lon: str) -> Column:
    return F.format_string("%.6f,%.6f", F.col(lat), F.col(lon))


def with_terrain(endpoints: DataFrame, terrain: DataFrame) -> DataFrame:
    """Height above ground from the terrain lookup (keyed by formatted coordinates); null where the lookup has no row."""
    keyed = terrain.where(F.col("terrain_m").isNotNull()).select(terrain_key("lat", "lon").alias("key"), F.lit(0).alias("version"), "terrain_m")
    lookup = resolved(keyed, "key", "version", ["terrain_m"])
    joined = endpoints.withColumn("key", terrain_key(*_POS)).join(lookup, "key", "left").drop("key")
    return joined.withColumn("rel_ground_m", F.col("median_altitude") - F.col("terrain_m"))


def usable_buildings(buildings: DataFrame) -> DataFrame:
    """Distinct (position, height) rows with their number of copies; incomplete rows dropped."""
    return buildings.select("building_height_m", "lon", "lat").na.drop().groupBy("building_height_m", "lon", "lat").agg(
        F.count(F.lit(1)).alias("copies"))


def building_matches(endpoints: DataFrame, buildings: DataFrame, mid_lat: Column) -> DataFrame:
    """Nearest building, number of buildings in the search radius, and best height match there."""
    key, pos = ["row", "col"], dict(query_pos=_POS, target_pos=("lat", "lon"))
    houses = materialize(usable_buildings(buildings))
    near = nearest(endpoints, key, houses, ["building_height_m"], mid_lat, **pos).select(
        *key, F.col("distance_m").alias("nearest_bldg_dist_m"), F.col("building_height_m").alias("nearest_bldg_height_m"))
    local = within_radius(endpoints.select(*key, *_POS, "rel_ground_m"), houses, BUILDING_RADIUS_M, mid_lat, **pos)
    gap = F.abs(F.col("building_height_m") - F.col("rel_ground_m"))
    best = local.groupBy(*key).agg(F.sum("copies").alias("bldg_count"), F.min(F.struct(gap.alias("gap"), "building_height_m", "distance_m")).alias("b"))
    best = best.select(*key, "bldg_count", F.col("b.gap").alias("best_height_gap"), F.col("b.building_height_m").alias("best_match_height"),
                       F.col("b.distance_m").alias("best_match_dist"))
    return endpoints.join(near, key, "left").join(best, key, "left").na.fill(0, ["bldg_count"])


def height_class(rel_ground: Column, gap: Column, tolerance: Column) -> Column:
    return F.when(rel_ground.isNull(), "unknown").when(rel_ground <= GROUND_LIKE_M, "ground_like").when(gap <= tolerance, "building_compatible").otherwise("elevated_unresolved")


def classify(endpoints: DataFrame, terrain: DataFrame, buildings: DataFrame, sites: DataFrame) -> DataFrame:
    """Endpoint cells with building matches, nearest site and height class."""
    base = materialize(with_terrain(endpoints, terrain))
    mid = base.agg(F.avg("median_lat")).scalar()
    matched = building_matches(base, buildings, mid)
    site = nearest(base, ["row", "col"], sites.select("lat", "lon").distinct(), [], mid, query_pos=_POS, target_pos=("lat", "lon"))
    out = matched.join(site.select("row", "col", F.col("distance_m").alias("nearest_station_m")), ["row", "col"], "left")
    return materialize(out.withColumns({
        "station_adjacent": F.col("nearest_station_m") <= STATION_ADJACENT_M,
        "height_class": height_class(F.col("rel_ground_m"), F.col("best_height_gap"), F.lit(HEIGHT_TOLERANCE_M))}))


def class_shares(classified: DataFrame) -> DataFrame:
    """Cell and touch shares per class, for all endpoints and for those next to a site."""
    scopes = F.when(F.col("station_adjacent"), F.array(F.lit("overall"), F.lit("station_adjacent"))).otherwise(F.array(F.lit("overall")))
    scoped = classified.withColumn("scope", F.explode(scopes))
    totals = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_t"))
    return scoped.groupBy("scope", "height_class").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("touches")).join(totals, "scope").select(
        "scope", "height_class", "cells", (F.col("cells") / F.col("_c")).alias("cell_share"), "touches", (F.col("touches") / F.col("_t")).alias("touch_share"))


def class_quartiles(classified: DataFrame) -> DataFrame:
    probs = {"p25_rel_ground_m": .25, "median_rel_ground_m": .5, "p75_rel_ground_m": .75}
    row = exact_percentiles(classified, "rel_ground_m", probs, width=0.5)
    station = exact_percentiles(classified, "nearest_station_m", {"median_nearest_station_m": .5}, width=1.0)
    return row.withColumn("median_nearest_station_m", station.scalar())


def sensitivity(base: DataFrame, buildings: DataFrame, radii: Sequence[float] = (100.0, 150.0),
                tolerances: Sequence[float] = (15.0, 20.0, 25.0)) -> DataFrame:
    """Class shares for every search radius and height tolerance from one radius join."""
    base = materialize(base)
    mid, key = base.agg(F.avg("median_lat")).scalar(), ["row", "col"]
    local = within_radius(base.select(*key, *_POS, "rel_ground_m"), usable_buildings(buildings), max(radii), mid, query_pos=_POS, target_pos=("lat", "lon"))
    gap = F.abs(F.col("building_height_m") - F.col("rel_ground_m"))
    gaps = local.groupBy(*key).agg(*[F.min(F.when(F.col("distance_m") <= r, gap)).alias(f"g{int(r)}") for r in radii])
    grid = F.explode(F.array(*[F.struct(F.lit(int(r)).alias("search_radius_m"), F.lit(int(t)).alias("height_tolerance_m"), F.col(f"g{int(r)}").alias("gap"))
                               for r in radii for t in tolerances]))
    spread = base.join(gaps, key, "left").select("n", "rel_ground_m", grid.alias("p")).select("n", "rel_ground_m", "p.*")
    spread = spread.withColumn("class_name", height_class(F.col("rel_ground_m"), F.col("gap"), F.col("height_tolerance_m")))
    by = ["search_radius_m", "height_tolerance_m"]
    totals = spread.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_t"))
    frame = totals.withColumn("class_name", F.explode(F.array(*[F.lit(c) for c in ("ground_like", "building_compatible", "elevated_unresolved", "unknown")])))
    counts = spread.groupBy(*by, "class_name").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    return frame.join(counts, by + ["class_name"], "left").na.fill(0, ["c", "t"]).select(
        *by, "class_name", (F.col("c") / F.col("_c")).alias("cell_share"), (F.col("t") / F.col("_t")).alias("touch_share"))
