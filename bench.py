"""Bench of the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.  Every query is written to the `noop` sink, so
all rows and columns are produced; each runs once before the run that counts.  `search_postings_stored` searches a table
of postings that was written beforehand, as a service would.  The documents are one row group, so they are dealt to as
many partitions as there are cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from vacantia.operators import search
from vacantia.plans import catalog
from vacantia.plans.catalog import QUERIES
from vacantia.session import build_session
from vacantia.sources.adapters import PARTITIONS

HEADLINE = [
    "top_skills", "process_postings", "extract_skills", "chunk_documents", "chunk_ids", "prepare_postings",
    "upsert_actions", "upsert_state", "search_postings", "search_postings_stored", "search_total", "knn_topk", "recommend_topn",
    "recommend_filtered", "retrieve_topk", "retrieve_topk_filtered", "extractive_answers", "top_terms",
    "latency_summary", "rate_limit", "incremental_equals_full", "pipeline_summary", "embed_norms",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", PARTITIONS: cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    stored = f"{spark.conf.get('spark.sql.warehouse.dir')}/bench-{uuid.uuid4().hex}"
    catalog.jobs(spark, folder).write.parquet(stored)
    queries = QUERIES | {"search_postings_stored": lambda s, _: search.search_postings(s.read.parquet(stored), **catalog.SEARCH).select(*catalog.PAGE)}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
