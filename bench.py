"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from ragspark import registry
from ragspark.session import local_session

HEADLINES = [
    "gated_passages", "near_duplicate_prune", "bm25_top_k", "hybrid_papers", "strict_filter", "result_chunks",
    "character_split", "clean_text", "final_context", "keyword_recommendation", "book_recommendation", "canonical_merge",
    "web_context",
]


def seconds(spark, name: str, folder: str, runs: int) -> float:
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    queries = {name: seconds(spark, name, folder, runs) for name in HEADLINES}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
                      "queries": queries, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
