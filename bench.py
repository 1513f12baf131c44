"""Headline timings: one JSON line.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the run."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalog, tables  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = """d1_tokenize d8_shingles e4_postings e6_bm25_topk e7_dense_topk e8_exact_match e18_selection b3_html_blocks b7_chunks
b11_context b14_hash_embedding c1_detect_changes c4_activate f3_plan f13_verify g1_chunk_signals g4_rephrases h3_rates h5_percentiles h15_limit_replay
i10_diagnoses j2_judge j5_summary l5_chat_turns k2_daily_usage""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    chosen = sys.argv[1:] or HEADLINE
    catalog.QUERIES["h3_rates"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM
    times = {}
    for name in chosen:
        tables._STORED.clear()  # every query pays for its own stages
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec"}
    print(json.dumps(result | {"queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
