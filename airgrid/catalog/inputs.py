"""Input tables of the registered queries, derived from the given parquet tables.

Each table is a projection of one given table, so its size follows the data.
The same definitions exist as SQL in ``catalog/sql.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions.geo import with_cell
from airgrid.operators.cells import cell_windows, occupancy
from airgrid.session import materialize
from airgrid.spec import FINE_GRID, FINE_WINDOW, GridSpec, WindowSpec

# The derived telemetry is thin, so density studies use a coarser grid than the default.
GRID = GridSpec(500.0)
WINDOW = WindowSpec(3600)

_POSITION = ["113.90D + 0.05D*x*x*x as longitude", "22.60D + 0.05D*y*y as latitude"]


def staged(build: Callable[["Inputs"], DataFrame]) -> Callable[["Inputs"], DataFrame]:
    """An intermediate table written once per query run and shared by its consumers."""

    @wraps(build)
    def once(inputs: "Inputs") -> DataFrame:
        if build not in inputs.stages:
            inputs.stages[build] = materialize(build(inputs))
        return inputs.stages[build]

    return once


class Inputs:
    """Lazy DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self.stages: dict[Callable, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def telemetry(self) -> DataFrame:
        base = self.table("lineitem").selectExpr(
            "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "cast(l_partkey % 100 as double)/100.0D as x", "cast(l_suppkey % 50 as double)/50.0D as y",
            "(l_orderkey % 22)*86400 + 28800 + (l_orderkey*37) % 28800 + l_linenumber*60 + l_partkey % 60 as sec")
        return base.selectExpr(
            "cast(l_orderkey as string) as order_id",
            "timestamp_seconds(unix_timestamp(timestamp '2023-10-01 00:00:00') + sec) as datetime",
            *_POSITION,
            "least(40.0D, l_quantity*0.8D*sqrt((x*x*x + y*y)/2.0D)) as speed",
            "l_extendedprice - 500.0D*floor(l_extendedprice/500.0D) as altitude",
            "cast((l_suppkey*7 + l_linenumber*13) % 360 as double) as yaw",
            "case when l_orderkey % 3 = 0 then 'SF' else 'MT' end as vendor")

    @cached_property
    def raw_telemetry(self) -> DataFrame:
        """All-text rows with bad values mixed in, as a CSV scan would deliver them."""
        keyed = self.table("lineitem").selectExpr(
            "l_orderkey as k", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "cast(l_partkey % 100 as double)/100.0D as x", "cast(l_suppkey % 50 as double)/50.0D as y",
            "(l_orderkey % 22)*86400 + 28800 + (l_orderkey*37) % 28800 + l_linenumber*60 + l_partkey % 60 as sec")
        text = keyed.selectExpr(
            "k", "cast(k as string) as order_id", "concat('sn', cast(k % 40 as string)) as sn",
            "case when k % 3 = 0 then 'SF' else 'MT' end as vendor",
            "case when k % 107 = 0 then '20231345000000' else concat(date_format(timestamp_seconds("
            "unix_timestamp(timestamp '2023-10-01 00:00:00') + sec), 'yyyyMMddHHmmss'),"
            " case when k % 5 = 0 then '.0' else '' end) end as time",
            "cast(case when k % 97 = 0 then -1.0D else least(40.0D, l_quantity*0.8D*sqrt((x*x*x + y*y)/2.0D)) end as string) as speed",
            "case when k % 103 = 0 then 'n/a' else cast(l_extendedprice - 500.0D*floor(l_extendedprice/500.0D) as string) end as altitude",
            "cast(case when k % 101 = 0 then 999.0D else cast((l_suppkey*7 + l_linenumber*13) % 360 as double) end as string) as yaw",
            "cast(l_linenumber*60 - case when k % 113 = 0 then 1000 else 0 end as string) as flight_time",
            "cast(113.90D + 0.05D*x*x*x + case when k % 127 = 0 then 5.0D else 0.0D end as string) as longitude",
            "cast(22.60D + 0.05D*y*y as string) as latitude")
        text = text.select(*[F.when(F.col("k") % 109 != 0, F.col(c)).alias(c) for c in text.columns if c != "k"])
        # written as a table of its own, so cleaning starts from stored text as it does on files
        return materialize(text)

    @cached_property
    def events(self) -> DataFrame:
        """Second point table, for day-profile queries."""
        return self.table("events").selectExpr(
            "cast(user_id as string) as order_id", "cast(ts as timestamp) as datetime", "value")

    @cached_property
    def sites(self) -> DataFrame:
        base = self.table("supplier").selectExpr(
            "s_suppkey", "s_name", "s_nationkey",
            "cast((s_suppkey*7) % 100 as double)/100.0D as x", "cast(s_suppkey % 50 as double)/50.0D as y")
        return base.selectExpr(
            "s_name as site_name", "concat('platform', cast(s_nationkey % 2 as string)) as platform",
            "case when s_suppkey % 10 = 0 then 'other' else 'main' end as city",
            "case when s_suppkey % 17 = 0 then 'test pad 试飞 é' end as note",
            "concat('2023-0', cast(1 + s_suppkey % 9 as string)) as open_time",
            "case when s_suppkey % 23 = 0 then 'unknown' else cast(113.90D + 0.05D*x*x*x as string) end as lon",
            "cast(22.60D + 0.05D*y*y as string) as lat")

    @cached_property
    def buildings(self) -> DataFrame:
        base = self.table("part").selectExpr(
            "p_partkey", "p_size", "cast(p_partkey % 100 as double)/100.0D as x",
            "cast((p_partkey*3) % 50 as double)/50.0D as y")
        return base.selectExpr(
            "p_partkey as building_id",
            "case when p_partkey % 50 = 0 then null else 5.0D + 2.0D*p_size end as building_height_m",
            "113.9003D + 0.05D*x*x*x as lon", "22.6002D + 0.05D*y*y as lat")

    @cached_property
    def nav_logs(self) -> DataFrame:
        """Flight-log rows of all days, with a path per flight as the file walker would give it."""
        base = self.table("lineitem").selectExpr(
            "l_orderkey as k", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "cast(l_partkey % 100 as double)/100.0D as x", "cast(l_suppkey % 50 as double)/50.0D as y")
        stem = ("concat(date_format(timestamp_seconds(unix_timestamp(case when k % 50 = 0 then timestamp '2024-10-01 00:00:00'"
                " else timestamp '2025-10-01 00:00:00' end) + k*137), 'yyyyMMdd-HHmmss'), '.mat')")
        return base.selectExpr(
            f"concat('logs/', case k % 4 when 0 then concat('A/R', cast(k % 3 as string), '/') when 1 then concat('B/R', cast(k % 3 as string), '/')"
            f" when 2 then concat('B-2/R', cast(k % 3 as string), '/') else '' end, {stem}) as path",
            "case when k % 89 = 0 then 0.0D else 22.60D + 0.05D*y*y end as lat", "113.90D + 0.05D*x*x*x as lon",
            "case when l_linenumber = 7 and k % 11 = 0 then null else (l_linenumber*60 + l_partkey % 60)*1000000L end as logtime",
            "0.6D*least(40.0D, l_quantity*0.8D*sqrt((x*x*x + y*y)/2.0D)) as vel_x", "0.8D*least(40.0D, l_quantity*0.8D*sqrt((x*x*x + y*y)/2.0D)) as vel_y",
            "l_extendedprice - 500.0D*floor(l_extendedprice/500.0D) as altitude_agl")

    @cached_property
    def points(self) -> DataFrame:
        """Telemetry on the study grid."""
        return with_cell(self.telemetry, GRID)

    @cached_property
    def fine_points(self) -> DataFrame:
        return with_cell(self.telemetry, FINE_GRID)

    @cached_property
    def windows(self) -> DataFrame:
        """Cell-windows, staged: the studies read this table several times."""
        return materialize(cell_windows(self.points, WINDOW))

    @cached_property
    def fine_windows(self) -> DataFrame:
        return cell_windows(self.fine_points, FINE_WINDOW)

    @cached_property
    def occ(self) -> DataFrame:
        return materialize(occupancy(self.windows))
