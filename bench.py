"""Timings of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Search tables
are built once, which is timed as ``index_build``; every query then runs once
to warm up and is timed on a second run.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfseek.plans import registry
from shelfseek.session import local_session

HEADLINE = [
    "latest_detail", "build_documents", "postings", "article_postings", "normalize_queries",
    "exact_candidates", "lexical_candidates", "lexical_passages", "trigram_candidates",
    "semantic_candidates", "hybrid_relevance", "hybrid_batch", "similar_products",
    "similar_all_pairs", "ann_search", "suggestions", "pending_all", "embed_outcomes",
    "embed_texts", "orphans", "duplicate_keys", "cascade_delete", "sync_documents",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times = {}

    def timed(name, run):
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    def run(query):
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()

    timed("index_build", lambda: (registry.search_index(spark, sf_dir),
                                  registry.article_index(spark, sf_dir)))
    only = sys.argv[1:] or HEADLINE
    for name in only:
        run(registry.QUERIES[name])
        timed(name, lambda: run(registry.QUERIES[name]))
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
