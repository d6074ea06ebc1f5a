"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local cores, BENCH_QUERIES a comma-separated choice of queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from detlake.plans.catalog import QUERIES  # noqa: E402
from detlake.session import local_session  # noqa: E402

HEADLINE = [
    "iou_join",
    "greedy_matches",
    "error_profile",
    "threshold_frontier",
    "miss_reasons",
    "average_precision",
    "board_routing",
    "suppress_overlaps",
    "tile_annotations",
    "content_issues",
    "near_signature_links",
    "near_pair_count",
    "connected_components",
    "grouped_split",
    "review_states",
    "reconcile",
    "job_state_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("detlake-bench", os.environ.get("BENCH_CPUS", "8"))
    # One small query first, so that starting the engine is not charged to the first name.
    QUERIES["job_states"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
