"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from checks import catalog, views
from vulnlake.session import local_session

HEADLINE = [
    "scan_report",
    "match_advisories",
    "change_headline",
    "sections",
    "chunk_window",
    "ingest_corpus",
    "bm25_top_k",
    "assemble_context",
    "vector_candidates",
    "mmr",
    "cache_lookup",
    "parse_response",
    "locate_exact",
    "patch_files",
    "hybrid_retrieval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="vulnlake-bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    # the stored index is written once, and opened by every query that searches it
    start = time.perf_counter()
    views.stored_index(spark, sf_dir)
    seconds["write_index"] = round(time.perf_counter() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
