"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattloom.plans import catalog, fixtures  # noqa: E402
from wattloom.session import build_session  # noqa: E402

HEADLINE = [
    "accounting_measured", "A10_A13_A14_average_model", "A15_J1_account_runs", "A8_in_row_energy", "S5_job_mapping", "T9", "T12_O8_best_start", "P12_clean", "P13_W6_filter_ledger",
    "J5_W2_node_overlaps", "A18_profile_audit", "K2_G9", "W1_peak_power", "W7_capacity_check", "X1_X8_X9_fcfs_simulated", "X3_X4_X13_easy", "X6_X11_carbon_aware", "X15_compare_baselines", "X14_X16_K3_carbon_sweep",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory=os.environ.get("BENCH_MEMORY", "12g"))
    began = time.time()
    fixtures.jobs(spark, sf_dir).count()
    fixtures.raw_trace(spark, sf_dir).count()
    prepared = time.time() - began
    times = {}
    for head in HEADLINE:
        name = next((n for n in catalog.QUERIES if n == head or n.startswith(head + "_") or f"_{head}_" in n), None)
        if name is None:
            continue
        best = None
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            t = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - t)
        times[name] = round(best, 3)
    jobs = fixtures.jobs(spark, sf_dir).count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(sf_dir.rstrip("/")).startswith("sf") else sf_dir,
        "prepare_sec": round(prepared, 3), "jobs": jobs, "job_accountings_per_sec": round(4 * jobs / times["X15_compare_baselines"]),
    }))


if __name__ == "__main__":
    main()
