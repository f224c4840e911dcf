"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local threads).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crashrisk.plans import catalog  # noqa: E402
from crashrisk.session import build_session  # noqa: E402

HEADLINE = [
    "agg1_stats_by_year",
    "flt7_filter_crashes",
    "agg10_describe",
    "agg12_distinct_counts",
    "jn3_radius_leave_one_out",
    "jn4_radius_held_out",
    "jn5_interval_to_point",
    "agg18_route_roll_up",
    "ml2_features_v2",
    "smp1_stratified_split",
    "win1_candidate_wins",
    "win2_number_rows",
    "ingest_transform",
    "ml12_threshold_sweep",
    "agg16_binary_roc_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("crashrisk-bench", master=f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    catalog.load()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start executors and load classes
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # the no-op sink computes every row and column, and writes nothing
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
