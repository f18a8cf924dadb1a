"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.plans import registry
from tallyloom.session import make_session

HEADLINE = (
    "q01_weekly_delivery", "q02_commits_enriched", "q05_cycle_percentiles", "q06_bus_factor", "q08_agent_share", "q09_ratio_metrics", "q09b_commit_metrics", "q10_attribution_pair", "q11_adopters_cumulative",
    "q12_before_after_volume", "q14_author_period", "q17_change_table", "q23_upsert_latest", "q25_incremental_equals_full", "q28_classify_titles", "q32b_page_findings_all", "q35_recurrence", "q37_ci_verdict", "q40_cooccurrence", "q46_stream_daily_counts",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = make_session(f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    for name in HEADLINE[:3]:  # warm-up
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
