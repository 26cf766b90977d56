"""Time the headline queries: one warm-up, then the median of several runs into the noop sink.

A query whose warm-up took long is measured once.

Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, and BENCH_ALL=1 for every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.queries import all_queries
from tidemark.session import local_session

HEADLINE = [
    "src_log_lines", "file_manifest_diff", "sink_statement_set",
    "rows_to_json", "changelog_rows", "retain_first", "result_page", "result_page_deep", "latest_result_only",
    "changes", "take_until_terminal", "last_state", "frames_with_rows", "cascade_cancel", "savepoint_watch",
    "latest_state", "lww_upsert", "or_set", "snapshot_changed", "snapshot_reconcile", "apply_change_events",
    "job_state_map", "cluster_refs", "deploy_decision",
    "job_overview", "service_snapshot", "pod_snapshot", "pod_metrics",
    "metric_pivot", "metric_pivot_taskmanager", "quantity_rollup", "path_normalize", "config_merge",
    "effective_config", "sql_job", "rel_join_asof", "rel_window_rank", "rel_rollup", "udf_agg",
    "stream_tumbling", "stream_changes",
]

LONG_RUN = 2.5


def run_once(build, spark, folder: str) -> float:
    begun = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    known = all_queries()
    names = sys.argv[1:] or (list(known) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = local_session(cpus, "tidemark-bench")
    times = {}
    for name in names:
        warm_up = run_once(known[name], spark, folder)
        repeats = runs if warm_up < LONG_RUN else 1
        times[name] = round(statistics.median(run_once(known[name], spark, folder) for _ in range(repeats)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
