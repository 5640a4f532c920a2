"""Registered queries against their SQL twins. AIRGRID_ALL_ORACLES=1 runs every one."""

import os

import pytest

from airgrid.catalog import ORACLES, QUERIES
from check_oracles import canonical, connect

CORE = ["critical_density", "breakpoint_specifications", "breakpoint_inflection", "regime_metrics", "density_diagram", "cell_stats", "cell_window_stats",
        "ranked_cells", "backbone_cells", "concentration", "clean_points", "trajectory_stats", "trajectory_segments", "od_pairs", "endpoint_altitudes",
        "trip_lengths", "length_summary", "ground_speed_advantage", "hourly_profile", "operational_table", "subset_summary", "altitude_bands",
        "leave_one_vendor_day_out", "date_hour_bootstrap", "time_shuffle_null", "vendor_day_bootstrap", "backbone_components", "component_shapes",
        "merge_sensitivity", "route_node_metrics", "skeleton_sensitivity", "route_signatures", "site_coverage", "cell_metrics", "endpoint_heights",
        "flight_metrics", "landed_points_scan"]
NAMES = sorted(ORACLES) if os.environ.get("AIRGRID_ALL_ORACLES") else CORE


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf_dir, name):
    got = canonical(QUERIES[name](spark, sf_dir).toPandas())
    want = canonical(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
