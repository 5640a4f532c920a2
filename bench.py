"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from airgrid.catalog import QUERIES
from airgrid.testing import local_session

HEADLINE = ("critical_density", "cell_stats", "cell_window_stats", "ranked_cells", "clean_points", "trajectory_stats", "od_pairs", "trip_lengths",
            "operational_table", "binned_relations", "hourly_profile", "subset_summary", "leave_one_day_out", "leave_one_vendor_day_out",
            "grid_size_sensitivity", "date_hour_bootstrap", "time_shuffle_null", "vendor_day_bootstrap", "route_day_bootstrap", "edge_support",
            "skeleton_sensitivity", "endpoint_clusters", "route_network_summary", "road_comparison", "endpoint_heights", "flight_metrics",
            "leave_one_hub_out", "monitoring_random_baseline")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["support_ratio"](spark, sf_dir).collect()  # JVM and reader warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
