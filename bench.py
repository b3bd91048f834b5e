"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 3) into Spark's no-op sink, which computes
every row and column; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from reqlens.plans import registry  # noqa: E402
from reqlens.session import build_session  # noqa: E402

HEADLINE = [
    "request_structure", "payload_statistics", "request_shape", "body_shape", "rule_features", "rule_scan",
    "signature_prefilter", "request_fingerprints", "audit_events", "access_events", "alert_statistics", "log_page",
    "trend_day", "alert_vectors", "top_vectors", "counter_deltas", "duration_histogram", "body_fill", "replay_match",
    "gate_counts", "dataset_split", "family_sample", "model_metrics", "bootstrap_interval", "advisory_columns",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "reqlens-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline queries, sum of warm medians", "value": total, "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
