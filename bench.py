"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from greenledger.bindings import QUERIES
from greenledger.session import local_session

HEADLINE = [
    "curate_record", "relevance_score", "canonical_url", "archive_merge", "version_history", "source_health_state", "exact_copies", "near_dup_pairs",
    "corpus_counts", "cumulative_days", "peer_topk", "balanced_digest", "theme_counts", "indicator_gaps", "measure_recommend", "portfolio_select", "sensitivity", "page_extract", "link_candidates", "dq_violations",
    "portfolio_by_brand", "assessment", "board_assessment", "archive_newest", "archive_ordered_digest", "stale_reports", "dq_dependencies", "map_views", "search_counts", "record_build",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["monthly_counts"](spark, folder).count()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
