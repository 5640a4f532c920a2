"""Readers, encodings and sinks."""

import codecs

from pyspark.sql import functions as F

from airgrid import sinks
from airgrid.operators.clean import clean_points
from airgrid.plans.followup import path_metadata, truthy
from airgrid.plans.sites import site_inventory
from airgrid.sources import tables
from airgrid.spec import GridSpec

HEADER = ",".join(tables.RAW_COLUMNS)
ROW = "o1,sn1,MT,20231001093015,12.5,100,999.0,60,113.95,22.61"


def test_bom_is_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(codecs.BOM_UTF8 + f"{HEADER}\n{ROW}\n".encode())
    row = clean_points(tables.read_raw_csv(spark, str(tmp_path / "a.csv"))).first()
    assert row.order_id == "o1" and row.yaw_clean is None and row.yaw_valid is False and row.day_of_week == 6 and row.is_weekend


def test_gb18030(spark, tmp_path):
    text = "site_name,platform,city,note,open_time,lon,lat\n测试站,甲,甲市,,2023, 113.95,22.61\n起降点,乙,甲市,试飞,2023,x,22.61\n"
    (tmp_path / "s.csv").write_bytes(text.encode("gb18030"))
    sites = tables.read_sites(spark, str(tmp_path / "s.csv"), encoding="GB18030")
    got = site_inventory(sites, "甲市", "测试", GridSpec(100.0)).collect()
    assert [(r.site_name, r.is_test_site) for r in got] == [("测试站", True)]


def test_bad_rows_are_dropped(spark, tmp_path):
    bad = [ROW.replace("12.5", "-1"), ROW.replace(",100,", ",n/a,"), ROW.replace("20231001093015", "20231345000000"), ROW.replace("113.95", "120"),
           ROW.replace(",60,", ",-5,"), "," * 9, ROW.replace("12.5", "40.0001")]
    edge = [ROW.replace("12.5", "40"), ROW.replace(",100,", ",500,"), ROW.replace("113.95", "114.25")]
    (tmp_path / "r.csv").write_text("\n".join([HEADER, ROW, *bad, *edge]) + "\n")
    raw = tables.read_raw_csv(spark, str(tmp_path / "r.csv"))
    assert clean_points(raw).count() == 4
    assert clean_points(raw, flight_time=False).count() == 5


def test_partitioned_sink_and_pruned_scan(spark, tmp_path):
    df = spark.range(1000).select(F.date_add(F.lit("2023-10-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"), F.col("id").alias("v"), F.lit(1).alias("w"))
    sinks.write_table(df, str(tmp_path / "t"), partition_by="date")
    scan = tables.read_points(spark, str(tmp_path / "t"), ["v"], F.col("date") == F.lit("2023-10-02").cast("date"))
    assert scan.count() == 333
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "ReadSchema: struct<v:bigint>" in plan
    sinks.write_metrics(df.agg(F.sum("v").alias("s")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().s == 499500


def test_lookup_readers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("building_height_m,lon,lat\n10.5,113.9,22.6\n,113.9,22.6\n")
    (tmp_path / "t.csv").write_text("lat,lon,terrain_m,source\n22.6,113.9,31.0,x\n")
    (tmp_path / "r.csv").write_text("route_key,attempt,status,distance_m,duration_s\nk,1,Ok,1200.5,90\n")
    assert tables.read_buildings(spark, str(tmp_path / "b.csv")).count() == 1
    assert tables.read_terrain(spark, str(tmp_path / "t.csv")).first().terrain_m == 31.0
    assert tables.read_road_lookup(spark, str(tmp_path / "r.csv")).first().distance_m == 1200.5


def test_path_metadata_and_flags(spark):
    paths = spark.createDataFrame([("logs/A/R1/20251110-081500.mat",), ("logs/20260316-090000.mat",), ("logs/A/R1/20241110-081500.mat",)], "path string")
    got = sorted((r.source_folder, r.route_code, r.flight_id) for r in path_metadata(paths).collect())
    assert got == [("A", "R1", "A__R1__20251110-081500"), ("root_logs", "unassigned", "root_logs__unassigned__20260316-090000")]
    flags = spark.createDataFrame([("1",), ("True",), ("true",), ("0",), ("TRUE",)], "v string").select(truthy(F.col("v")).alias("b")).collect()
    assert [r.b for r in flags] == [True, True, True, False, False]
