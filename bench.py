"""Runs the headline queries and prints one JSON line: seconds of each, and their sum."""

from __future__ import annotations

import json
import os
import time

from tidemark import catalog
from tidemark.session import build

NAMES = (
    "agg01_fractional_occupancy",
    "agg03_switching_rate",
    "agg07_approximate_pairs",
    "win01_life_times",
    "win03_interval_times",
    "win10_viterbi",
    "win11_forward_backward",
    "pre01_standardise",
    "pre02_detrend_suppliers",
    "pre09_embedding",
    "pre30_lag_design",
    "join01_event_locked",
    "join13_lagged_correlation",
    "agg10_weighted_covariance",
    "agg27_explained_single_mar",
    "spec02_multitaper",
    "dec15_regression_by_time",
    "stat04_difference_test",
    "train02_fit_chain",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in NAMES:
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(sorted(runs)[1], 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
