"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the local cores. All queries run
once to warm up and then BENCH_RUNS times in turn; the median counts. The time is that of building
the plan and of bringing the result to the driver.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillmart.registry import QUERIES  # noqa: E402
from tillmart.session import build_session  # noqa: E402

HEADLINE = (
    "kpis", "kpis_filtered", "monthly_trend", "sales_by_category", "top8_customers", "top6_products", "revenue_by_market",
    "top10_customers", "top10_products", "monthly_running_total", "mom_growth", "category_rank", "cohort_retention",
    "cohort_retention_filtered", "retention_matrix", "estimated_funnel", "bi_measures", "bi_measures_by_category", "bi_mom_growth",
    "question_routing", "clean_dates", "dim_customers", "quality_checks", "quality_issues", "integrity_checks", "events_hourly",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g")
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken = {name: [] for name in HEADLINE}
    for _ in range(runs + 1):
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            taken[name].append(time.perf_counter() - start)
    seconds = {name: round(statistics.median(times[1:]), 3) for name, times in taken.items()}
    print(json.dumps({
        "metric": "headline queries, warm median, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
