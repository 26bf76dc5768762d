"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cryoframe.plans.registry import QUERIES  # noqa: E402
from cryoframe.session import local_session  # noqa: E402

HEADLINE = [
    "Z01_points_to_mass", "A06_consolidate", "B01_flag_mask", "C01_radius_join", "C02_k_nearest", "C03_nearest_cutoff", "C04_track_crossings", "C11_bilinear",
    "C16_buffer_anti_join", "D01_space_time_filter", "D28_cell_year_medians", "E01_track_sessions", "E02_rolling_median", "I02_node_rates", "I03_window_rates",
    "I04_node_series", "I07_trend_table", "I14_year_jackknife", "I16_acceleration_support", "I20_idw", "I23_kriging", "I30_lagrangian_rate", "J01_distance_to_class",
    "J03_flux_divergence", "B08_front_classifier",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    QUERIES["B02_roi_box"](spark, sf_dir).collect()  # start the JVM and the Python workers' session once
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        # All rows are computed and none is brought to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cores}))
    spark.stop()


if __name__ == "__main__":
    main()
