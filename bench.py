"""Headline-query benchmark.

Runs a representative set of registered plans (every template, generic aggregation,
profiling and quality) over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one
JSON line. Each query is forced to full execution with the ``noop`` sink (no driver
collect). Every query evaluates its own source; nothing is cached between queries, so each
pays for its own preparation.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkwright.plans.registry import queries  # noqa: E402
from sparkwright.session import get_session  # noqa: E402

HEADLINE = [
    "retail_monthly_revenue",
    "retail_kpis",
    "retail_product_performance",
    "retail_rfm_segments",
    "mfg_kpis",
    "mfg_machine_performance",
    "log_kpis",
    "log_carrier_performance",
    "fin_kpis",
    "fin_monthly_summary",
    "generic_aggregate",
    "quality_rules_all",
    "quality_score",
    "profile_numeric",
    "data_dictionary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="sparkwright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("sparkwright.spreadScans", "true")  # the bench tables are one row group each
    registry = queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
