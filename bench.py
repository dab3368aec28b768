"""Time the headline queries: ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_RUNS`` set the scope.

Every query is executed in full (all columns of all rows) and the median of its
runs is reported. ``BENCH_ALL=1`` times every registered query once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boxtally.plans import load_registry
from boxtally.session import local_session

HEADLINE = (
    "compute_metrics", "metrics_by_pipeline_version", "version_rates", "stored_grouped_metrics",
    "chart_series", "recovery_funnel", "user_correctness", "candidate_pairs", "assign_matches",
    "reconcile", "reconcile_with_recovery", "dedup_detections", "suppress_overlaps",
    "rank_label_proposals", "plan_tiles", "fold_decode_attempts", "infer_grid_gaps",
    "assemble_items", "photo_results", "derive_issues_persisted", "online_feedback",
    "flatten_callbacks", "processing_status", "review_candidates", "export_entries",
    "value_scores", "symbol_benchmark", "insert_if_absent", "apply_completion", "session_lines",
    "session_steps", "session_stream", "chat_stream", "hourly_stream", "capture_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    every = os.environ.get("BENCH_ALL") == "1"
    runs = 1 if every else int(os.environ.get("BENCH_RUNS", "2"))
    registry = load_registry()
    names = list(registry) if every else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()

    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            t = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(taken), 3)
        if every:
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "label capture queries, sum of medians" if not every else "all queries, one run",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
