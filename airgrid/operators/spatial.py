"""Distance joins through tiles: equi-joins on tile keys, then an exact distance filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.geo import haversine_m, planar_m
from airgrid.session import materialize
from airgrid.spec import LOCAL_METERS_PER_DEGREE, METERS_PER_DEGREE


def _around(df: DataFrame) -> DataFrame:
    """Repeat each row for the 3 x 3 tiles around its own."""
    span = F.sequence(F.lit(-1), F.lit(1))
    return df.withColumn("_dy", F.explode(span)).withColumn("_dx", F.explode(span)).withColumns({
        "_ty": F.col("_ty") + F.col("_dy"), "_tx": F.col("_tx") + F.col("_dx")}).drop("_dy", "_dx")


def _tiled_pairs(points: DataFrame, threshold_m: float, strict: bool, salts: int = 1) -> DataFrame:
    """Ordered pairs (a, b) of rows (id, lat, lon) with id_a < id_b no farther apart than the threshold.

    Tiles are at least as wide as the threshold everywhere, so partners lie in
    adjacent tiles. ``salts`` deals the rows a of a crowded tile over as many keys and repeats the rows b for each.
    """
    top = points.agg(F.max(F.abs(F.col("lat")))).scalar()
    tiled = points.withColumns({
        "_ty": F.floor(F.col("lat") * F.lit(METERS_PER_DEGREE / threshold_m)),
        "_tx": F.floor(F.col("lon") * F.lit(METERS_PER_DEGREE / threshold_m) * F.cos(F.radians(top)))})
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in points.columns], "_ty", "_tx")
    left = side(_around(tiled), "a").withColumn("_salt", F.pmod(F.xxhash64("id_a"), F.lit(salts)))
    right = side(tiled, "b").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    joined = left.join(right, ["_ty", "_tx", "_salt"]).where(F.col("id_a") < F.col("id_b")).drop("_ty", "_tx", "_salt")
    out = joined.withColumn("distance_m", haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    return out.where(F.col("distance_m") < threshold_m if strict else F.col("distance_m") <= threshold_m)


def pairs_within(points: DataFrame, key: str, threshold_m: float, *, lat: str = "lat", lon: str = "lon", strict: bool = False, salts: int = 1) -> DataFrame:
    """Unordered pairs (key_a < key_b) of a table no farther apart than the threshold, with their distance."""
    rows = points.select(F.col(key).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return _tiled_pairs(rows, threshold_m, strict, salts).select(F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b"), "distance_m")


def position_pairs(points: DataFrame, key: str, threshold_m: float, *, lat: str = "lat", lon: str = "lon", strict: bool = False) -> DataFrame:
    """Pairs of positions no farther apart than the threshold, with the number of pairs of points that each stands for.

    Points that share a position are one row with a multiplicity, so a crowded spot gives one pair with each neighbour and one
    with itself, not the product of its points. Columns: lat and lon of both, the points at both (``n_a``, ``n_b``), ``pairs``, one key of each
    side (the smallest; at a position with itself smallest and largest) and ``distance_m``.
    """
    spots = materialize(points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).withColumn("id", F.struct("lat", "lon")))
    apart = _tiled_pairs(spots, threshold_m, strict).select(
        "lat_a", "lon_a", "lat_b", "lon_b", "n_a", "n_b", (F.col("n_a") * F.col("n_b")).alias("pairs"), F.col("low_a").alias(f"{key}_a"),
        F.col("low_b").alias(f"{key}_b"), "distance_m")
    n = F.col("n")
    together = spots.where(n > 1).select(
        F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), n.alias("n_a"), n.alias("n_b"),
        (n * (n - 1) / 2).cast("bigint").alias("pairs"), F.col("low").alias(f"{key}_a"), F.col("high").alias(f"{key}_b"), F.lit(0.0).alias("distance_m"))
    return apart.unionByName(together)


def _planar_tiles(df: DataFrame, lat: str, lon: str, mid_lat: Column, size_m: float) -> DataFrame:
    scale = F.lit(LOCAL_METERS_PER_DEGREE / size_m)
    return df.withColumns({"_ty": F.floor(F.col(lat) * scale), "_tx": F.floor(F.col(lon) * scale * F.cos(F.radians(mid_lat)))})


def within_radius(queries: DataFrame, targets: DataFrame, radius_m: float, mid_lat: Column, *, query_pos: tuple[str, str],
                  target_pos: tuple[str, str]) -> DataFrame:
    """Query-target combinations within the radius, with ``distance_m`` (local planar metric).

    Targets should be distinct positions (copies folded into a count) so a
    crowded spot contributes one row.
    """
    left = _around(_planar_tiles(queries, *query_pos, mid_lat, radius_m))
    right = _planar_tiles(targets, *target_pos, mid_lat, radius_m)
    joined = left.join(right, ["_ty", "_tx"]).drop("_ty", "_tx")
    distance = planar_m(F.col(query_pos[0]), F.col(query_pos[1]), F.col(target_pos[0]), F.col(target_pos[1]), mid_lat)
    return joined.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)


def _gap_m(query_pos: tuple[str, str], mid_lat: Column) -> Column:
    """Distance of a query from the box (south, north, west, east); the planar metric is separable, so it bounds all positions inside."""
    inside = lambda q, low, high: F.least(F.greatest(F.col(q), F.col(low)), F.col(high))
    return planar_m(F.col(query_pos[0]), F.col(query_pos[1]), inside(query_pos[0], "south", "north"), inside(query_pos[1], "west", "east"), mid_lat)


def tile_pyramid(targets: DataFrame, pos: tuple[str, str], factor: int) -> list[DataFrame]:
    """Levels of occupied tiles, finest first, each with its parent tile, bounding box and one target position.

    Each level is summed up from the one below, until a level has a single tile or 16 at most.
    """
    lat, lon = F.col(pos[0]), F.col(pos[1])
    parent = [F.floor(F.col(c) / factor).alias(p) for c, p in (("_ty", "_py"), ("_tx", "_px"))]
    finest = targets.groupBy("_ty", "_tx").agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"),
                                               F.min(F.struct(lat.alias("y"), lon.alias("x"))).alias("spot"))
    levels = [materialize(finest.select("*", *parent))]
    while levels[-1].count() > 16:
        above = levels[-1].groupBy(F.col("_py").alias("_ty"), F.col("_px").alias("_tx")).agg(
            F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"), F.min("spot").alias("spot"))
        levels.append(materialize(above.select("*", *parent)))
    return levels


def nearest(queries: DataFrame, key: Sequence[str], targets: DataFrame, carried: Sequence[str], mid_lat: Column, *,
            query_pos: tuple[str, str], target_pos: tuple[str, str], start_m: float = 250.0, factor: int = 8) -> DataFrame:
    """Closest target of each query: (key, distance_m, carried...); ties are decided by the carried columns.

    Targets are tiled once. Queries go down a pyramid of occupied tiles: on each level they keep the tiles whose box is no farther
    than the nearest known position of any tile, and only the targets in the last tiles are measured.
    """
    key = list(key)
    left = queries.select(*key, *query_pos).distinct().where(F.col(query_pos[0]).isNotNull() & F.col(query_pos[1]).isNotNull())
    usable = targets.where(F.col(target_pos[0]).isNotNull() & F.col(target_pos[1]).isNotNull())
    right = materialize(_planar_tiles(usable.select(*target_pos, *carried).distinct(), *target_pos, mid_lat, start_m))
    levels = tile_pyramid(right, target_pos, factor)
    # at most 16 tiles at the top
    top = levels[-1].select(F.collect_list(F.struct("_ty", "_tx", "south", "north", "west", "east", "spot"))).scalar()
    found = left.withColumn("_t", F.explode(top)).select(*key, *query_pos, "_t.*")
    for depth in range(len(levels) - 1, -1, -1):
        if depth < len(levels) - 1:
            below = levels[depth].withColumnsRenamed({"_ty": "_cy", "_tx": "_cx"}).withColumnsRenamed({"_py": "_ty", "_px": "_tx"})
            found = found.join(below, ["_ty", "_tx"]).drop("_ty", "_tx").withColumnsRenamed({"_cy": "_ty", "_cx": "_tx"})
        spot = planar_m(F.col(query_pos[0]), F.col(query_pos[1]), F.col("spot.y"), F.col("spot.x"), mid_lat)
        reach = F.min(spot).over(Window.partitionBy(*key))
        found = found.withColumn("_reach", reach).where(_gap_m(query_pos, mid_lat) <= F.col("_reach") * (1 + 1e-12) + 1e-9)
        found = found.select(*key, *query_pos, "_ty", "_tx")
    distance = planar_m(F.col(query_pos[0]), F.col(query_pos[1]), F.col(f"_t.{target_pos[0]}"), F.col(f"_t.{target_pos[1]}"), mid_lat)
    right = right.select("_ty", "_tx", F.struct(*target_pos, *carried).alias("_t"))
    hits = found.join(right, ["_ty", "_tx"]).select(*key, distance.alias("distance_m"), *[F.col(f"_t.{c}").alias(c) for c in carried])
    return materialize(hits.groupBy(*key).agg(F.min(F.struct("distance_m", *carried)).alias("_n")).select(*key, "_n.*"))
