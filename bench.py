"""Headline queries, median of warm runs; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from meterloom.plans.catalog import load
from meterloom.session import build_session

HEADLINE = (
    "a1_resample_week", "a7_weekly_features", "d8_cycles_to_monthly", "d14_fill_linear", "f4_share_above",
    "x3_first_events", "x4_detect", "x8_matrix_profile", "c2_dtw_within", "c12_silhouette", "c10_dbscan", "c16_nearest_pattern", "e6_recurrence_plot",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    seconds = {}
    for name in HEADLINE:
        took = []
        for run in range(RUNS + 1):  # the first run warms up
            begin = time.perf_counter()
            registry[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({
        "metric": "sum of median warm query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
