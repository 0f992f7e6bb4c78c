"""Time the headline queries and print one JSON line.

Each query is built and run to its end (``noop`` sink) once to warm up and then ``BENCH_RUNS`` times;
the middle time counts. ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_QUERIES`` choose input, cores and queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanlake import catalog  # noqa: E402
from spanlake.session import build_session  # noqa: E402

HEADLINE = [
    "token_totals_by_model",
    "lake_token_totals",
    "lake_latest_calls",
    "lake_rollout_lookup",
    "call_view",
    "log_summary",
    "log_top_paths",
    "log_correlate",
    "log_open_requests",
    "capture_spans",
    "sanitize_requests",
    "join_tool_results",
    "sft_records",
    "trl_conversational",
    "rl_records",
    "train_test_split_exact",
    "with_sequence",
    "batch_assign",
    "batch_retain",
    "session_metrics",
    "windowed_rates",
    "span_children",
    "stream_shards_30",
    "stream_correlate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in HEADLINE if n in chosen] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in names:
        taken = []
        for run in range(runs + 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
