"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) is the input, ``BENCH_CPUS`` the local cores.
Every query runs once to warm up and then ``RUNS`` times; the median counts. The
customer table is rebuilt from the star schema under its own key.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from session import local_session  # noqa: E402

from tellerlake.plans.catalog import all_queries  # noqa: E402
from tellerlake.sources import star, store  # noqa: E402

RUNS = 3
HEADLINE = [
    "kpi_pack", "kpi_risk_distribution", "kpi_top10_balance", "seg_customer_detail", "seg_summary",
    "geo_customers_by_state", "geo_top_cities", "loan_by_state", "loan_high_dti",
    "risk_high_customers", "risk_by_credit_category", "txn_by_occupation", "clean_dedup",
    "clean_customers", "exec_credit_score_hist", "risk_state_credit_heatmap", "segpage_summary",
    "five_number_summary", "eda_describe", "eda_correlation", "insights_all", "recommendations",
    "stratified_split", "eval_auc_ovr_weighted",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS"))
    queries = all_queries()
    names = sorted(queries) if "--all" in sys.argv else HEADLINE

    def build() -> None:
        table = f"bench_{time.time_ns()}"
        state = store.source_state(spark, sf_dir)
        n = store.buckets(spark, sum(s[1] for s in state))
        store.store_customers(star.customer_table(spark, sf_dir), table,
                              store.new_path(spark, table), n)

    def run(name: str) -> None:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def median(work) -> float:
        work()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            work()
            times.append(time.perf_counter() - start)
        return round(statistics.median(times), 4)

    seconds = {"build_customers": median(build)}
    store.customers_of(spark, sf_dir)
    for name in names:
        seconds[name] = median(lambda: run(name))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
