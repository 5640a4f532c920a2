"""Column expressions for grids and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.spec import EARTH_RADIUS_M, LOCAL_METERS_PER_DEGREE, METERS_PER_DEGREE, GridSpec


def _clamp(value: Column, upper: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(upper), value))


def raw_row(lat: Column, grid: GridSpec) -> Column:
    return F.floor((lat - F.lit(grid.min_lat)) * F.lit(grid.m_lat) / F.lit(float(grid.size_m))).cast("int")


def raw_col(lon: Column, grid: GridSpec) -> Column:
    return F.floor((lon - F.lit(grid.min_lon)) * F.lit(grid.m_lon) / F.lit(float(grid.size_m))).cast("int")


def cell_row(lat: Column, grid: GridSpec) -> Column:
    return _clamp(raw_row(lat, grid), grid.n_rows - 1)


def cell_col(lon: Column, grid: GridSpec) -> Column:
    return _clamp(raw_col(lon, grid), grid.n_cols - 1)


def with_cell(df: DataFrame, grid: GridSpec, lon: str = "longitude", lat: str = "latitude",
              row: str = "row", col: str = "col") -> DataFrame:
    return df.withColumns({row: cell_row(F.col(lat), grid), col: cell_col(F.col(lon), grid)})


def cell_id(row: Column, col: Column) -> Column:
    """Printable cell key; the operators themselves carry (row, col)."""
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def centroid_lat(row: Column, grid: GridSpec) -> Column:
    return F.lit(grid.min_lat) + (row + F.lit(0.5)) * F.lit(float(grid.size_m)) / F.lit(grid.m_lat)


def centroid_lon(col: Column, grid: GridSpec) -> Column:
    return F.lit(grid.min_lon) + (col + F.lit(0.5)) * F.lit(float(grid.size_m)) / F.lit(grid.m_lon)


def round_half_even(value: Column, decimals: int) -> Column:
    """Scale, round half to even, unscale."""
    return F.rint(value * F.lit(10.0 ** decimals)) / F.lit(10.0 ** decimals)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / F.lit(2.0))
    half_lon = F.sin(F.radians(lon2 - lon1) / F.lit(2.0))
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # least() would skip a null chord, so the cap is a plain condition
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)))


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, mid_lat: Column) -> Column:
    dy = (lat2 - lat1) * F.lit(LOCAL_METERS_PER_DEGREE)
    dx = (lon2 - lon1) * F.lit(LOCAL_METERS_PER_DEGREE) * F.cos(F.radians(mid_lat))
    return F.sqrt(dx * dx + dy * dy)


def coordinate_extent(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.agg(F.min(lon).alias("lo"), F.max(lon).alias("hi"), F.min(lat).alias("la"), F.max(lat).alias("ha"))


def anchored_cell(df: DataFrame, size_m: float, lon: str, lat: str, *, extent: DataFrame | None = None, row: str = "row", col: str = "col") -> DataFrame:
    """Grid whose origin is the smallest coordinate present in the data, or in the given extent.

    The extent is a one-row aggregate read through scalar subqueries, so the
    points themselves are neither shuffled nor joined.
    """
    extent = coordinate_extent(df, lon, lat) if extent is None else extent
    lo, la, ha = (extent.select(name).scalar() for name in ("lo", "la", "ha"))
    east = (F.col(lon) - lo) * F.lit(METERS_PER_DEGREE) * F.cos(F.radians((la + ha) / F.lit(2.0)))
    north = (F.col(lat) - la) * F.lit(METERS_PER_DEGREE)
    return df.withColumns({
        row: F.floor(north / F.lit(float(size_m))).cast("int"),
        col: F.floor(east / F.lit(float(size_m))).cast("int"),
    })
