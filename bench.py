"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores,
``BENCH_RUNS`` how often a query runs (the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafstack.plans import all_queries
from leafstack.session import build_session

HEADLINE = (
    "b2_explode_pages b3_sections b4_sentences b5_windows b7_tables b9_ids b10_embed b11_final_chunks "
    "c2_listing c3_scrape c5_parts_of c7_guided_questions d4_lookup d5_upsert d6_topk d6_topk_grouped "
    "d7_ann_topk e1_latest e2_collect_retrieval e5_change_feed f3_dedupe f4_eval_set "
    "f5_eval_set_documented f7_retriever_metrics g2_history g7_retrieve g8_context g10_references "
    "j3_load_all j4_upsert_stream"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "leafstack-bench", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
    })
    queries = all_queries()
    # read to the end: a limit would close the pipe of a Python worker that still writes
    queries["b10_embed"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name:28} {best:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
