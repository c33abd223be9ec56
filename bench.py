"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores, BENCH_RUNS the timed repetitions (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from tidemark.session import build_session

HEADLINE = (
    "contract_report", "type_inference", "records_rejected", "split_assign", "impute_scale",
    "impute_onehot", "auc_ap", "classification_metrics", "cut_points", "baseline_numeric",
    "baseline_categorical", "drift_report", "drift_status", "rolling_window", "monitor_evaluations",
    "monitor_events", "request_counts", "latency_p95", "request_rate", "probability_rate",
    "promotion_history", "train_score", "split_assign_many_classes", "auc_ap_blocks",
    "retraining_decisions_blocks", "monitor_stream", "request_rate_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    cores = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = build_session(
        "bench", f"local[{cpus}]", cores,
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-bench-"),
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    import workload

    workload.load_all()
    times: dict[str, float] = {}
    # the first query of a session pays for loading classes; that is not the query's time
    workload.QUERIES["request_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
