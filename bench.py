"""Headline timings: one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ROUNDS (timed runs per query, default 3; the median counts, after one warm-up run).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from leadweave.plans.catalog import QUERIES
from leadweave.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))
HEADLINE = [
    "scan_leads", "search_leads", "facets_all", "counts_since", "period_report",
    "dedup_candidates", "merge_leads", "upsert_leads", "upsert_action_counts",
    "canonical_urls", "extract_emails", "best_phones", "classify_industry", "pages_to_text",
    "extract_social_links", "enrich_sites", "union_sources", "source_cascade", "scan_totals",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    # the no-op sink makes Spark compute every row and column without moving them to the driver
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "leadweave-bench", partitions=int(CPUS))
    times = {}
    for name in HEADLINE:
        run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(ROUNDS)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline query seconds (sum of medians)",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
