"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to completion with the ``noop`` sink (full execution,
nothing collected). Mining runs its per-level actions while the plan is built, so
plan-building time is included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketcast.plans.queries import QUERIES  # noqa: E402
from basketcast.session import build_session  # noqa: E402

HEADLINE = [
    "clean_transactions", "validation_profile", "basket_lines", "frequent_itemsets", "frequent_itemsets_brand",
    "association_rules_brand", "daily_sales", "sales_trend_week", "forecast_features", "latest_lag_state",
    "train_split", "inventory_recommendations", "bundle_inventory", "lift_matrix", "combined_insights",
    "associated_sales_comparison", "synth_txn_id", "demand_forecast",
]


# The median of RUNS runs counts; a query of SHORT_SECONDS or more is run once.
RUNS, SHORT_SECONDS = int(os.environ.get("BENCH_RUNS", "3")), 6.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", app_name="basketcast-bench", shuffle_partitions=cpus * 2)
    times: dict[str, float] = {}
    for name in names:
        runs: list[float] = []
        while len(runs) < RUNS and (not runs or runs[0] < SHORT_SECONDS):  # long ones are run once
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))


if __name__ == "__main__":
    main()
