"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
threads. Every query runs once to warm up and then ``BENCH_RUNS`` times; the
median counts. Results go to the no-op sink, so all rows are produced.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "rank_feedback",
    "top_n",
    "paginate",
    "backlog",
    "backlog_export",
    "priority_score",
    "kpi_cards",
    "charts_volume",
    "charts_peak",
    "charts_sentiment",
    "charts_source",
    "metadata",
    "search_text",
    "spike_windows",
    "spike_tickets",
    "anomalies",
    "clean_text",
    "extract_post_body",
    "prefilter_noise",
    "micro_batches",
    "build_batch_prompts",
    "apply_batch_responses",
    "classify_rows",
    "upsert_new_only",
    "ingest_run",
)


def main() -> None:
    from voxledger.catalog import load
    from voxledger.session import build_session, scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = load().queries, {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            with scratch(spark):
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
