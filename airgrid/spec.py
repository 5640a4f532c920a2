"""Immutable parameters shared by the operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

# ---- fixed values: study area, conversion factors, thresholds -------------
BBOX_MIN_LON, BBOX_MAX_LON = 113.31, 114.25
BBOX_MIN_LAT, BBOX_MAX_LAT = 22.31, 22.87
METERS_PER_DEGREE = 111000.0
EARTH_RADIUS_M = 6371008.8
LOCAL_METERS_PER_DEGREE = 111320.0
MAX_SPEED, MAX_ALTITUDE = 40.0, 500.0
INVALID_YAW = 999.0
BACKBONE_SHARE = 0.10
MIN_BIN_SAMPLES = 10
MAX_SPLIT_INDEX = 50
Z_95 = 1.96
SLOW_SPEED = 2.0
DISTANCE_EDGES_KM = (0, 1, 3, 5, 10, 20, 80)
LENGTH_EDGES_KM = (0, 1, 2, 3, 4, 5, 7, 10, 15, 20, 80)
DURATION_EDGES_MIN = (0, 2, 5, 7.5, 10, 12.5, 15, 20, 50)
ROAD_PEAK_KMH, ROAD_BUS_KMH = 25.0, 17.57
GROUND_SPEEDS_KMH = tuple(range(10, 71))
GROUND_LIKE_M, BUILDING_RADIUS_M, HEIGHT_TOLERANCE_M, STATION_ADJACENT_M = 15.0, 150.0, 20.0, 150.0
MONITORING_BUDGETS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10)
SKELETON_THRESHOLDS = (20, 50, 100, 200, 500)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class GridSpec:
    """A regular lon/lat grid; cells are (row, col) counted from the south-west corner."""

    size_m: float
    min_lon: float = BBOX_MIN_LON
    max_lon: float = BBOX_MAX_LON
    min_lat: float = BBOX_MIN_LAT
    max_lat: float = BBOX_MAX_LAT

    @property
    def m_lat(self) -> float:
        return METERS_PER_DEGREE

    @property
    def m_lon(self) -> float:
        return METERS_PER_DEGREE * math.cos(math.radians((self.min_lat + self.max_lat) / 2.0))

    @property
    def n_rows(self) -> int:
        return math.ceil((self.max_lat - self.min_lat) * self.m_lat / self.size_m)

    @property
    def n_cols(self) -> int:
        return math.ceil((self.max_lon - self.min_lon) * self.m_lon / self.size_m)

    @property
    def total_cells(self) -> int:
        return self.n_rows * self.n_cols


@dataclass(frozen=True)
class WindowSpec:
    """A tumbling time window aligned to midnight."""

    seconds: int = 120


FINE_GRID = GridSpec(100.0)
FINE_WINDOW = WindowSpec(120)
