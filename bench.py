"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}. The fact
table is built and materialized first (timed as ``facts_build``); every
operator then runs in full on it and is executed with a no-op sink (the whole
plan runs, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "profit_by_hour", "profit_by_factor", "overall_metrics", "profit_score", "top_scenarios",
    "price_grid", "segment_optimal_prices", "pricing_strategy_compare", "price_elasticity_bins",
    "efficiency_by_factor", "restaurant_delays", "executive_kpis",
    "driver_metrics", "shift_allocation", "drivers_needed",
    "daily_orders", "moving_average_forecast", "hourly_features",
    "customer_rfm", "customer_profile",
    "restaurant_sites", "pickup_hotspots", "efficient_routes", "profit_by_factor_clustered",
    "autoregressive_forecast", "city_autoregressive_forecast",
    "customer_segments", "hourly_demand_model", "delivery_time_models",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from dispatchlens.plans.catalog import registry
    from dispatchlens.plans.materialize import fact_table
    from dispatchlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="dispatchlens-bench")
    times: dict[str, float] = {}
    t = time.time()
    fact_table(spark, sf_dir)
    times["facts_build"] = round(time.time() - t, 3)
    qs = registry()
    for name in HEADLINE:
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
