"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each query is planned and run whole into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from paperloom.catalog import load_catalog
from paperloom.session import build_session, clear_shared

HEADLINE = (
    "bm25_topk",
    "sparse_topk",
    "dense_topk",
    "hybrid_retrieval",
    "paper_chunks",
    "entity_mentions",
    "edge_provenance",
    "triple_decisions",
    "node_upsert",
    "hydrated_papers",
    "request_pacing",
    "overlap_topk",
    "answer_questions",
    "streamed_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "paperloom-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.checkpoint.dir": shared, "spark.paperloom.spread": str(2 * int(cpus))},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/region.parquet").collect()
    times = {}
    for name in names:
        began = time.perf_counter()
        catalog[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    clear_shared(spark)
    spark.stop()
    asked = {"queries_in_batch": 200, "hybrid_sec_per_question": round(times["hybrid_retrieval"] / 200, 4)} if "hybrid_retrieval" in times else {}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                **asked,
            }
        )
    )


if __name__ == "__main__":
    main()
