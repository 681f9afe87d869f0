"""Headline queries, timed: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm up and then BENCH_RUNS times (default 2); the best
time counts. Results are written to the no-op sink, so all rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casewright.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "item_dfg_edges", "item_dfg_performance", "item_case_variants", "item_variants_table",
    "item_follows", "item_events_daily", "item_activity_histogram", "item_quality_precision",
    "item_quality_generalization", "filter_stack_base_semantics", "filter_rules",
    "filter_variant_top3", "clean_log", "case_duration", "case_date_column", "case_variant_info",
    "log_overview", "duration_describe", "duration_histogram", "events_weekly", "resource_counts",
    "resource_trend_weekly", "activity_resource_matrix", "resource_dfg", "user_variants_table",
    "quality_metrics", "token_replay", "replay_report", "alignment_report", "inductive_tree",
    # The route of cases too large for a task.
    "hot_user_dfg_edges", "hot_user_variants_table", "hot_user_follows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in names:
        once(name)
        times[name] = round(min(once(name) for _ in range(runs)), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
