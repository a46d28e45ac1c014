"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e15_overall_scores", "g7_person_fit", "c9_score_answers", "d2_keyword_search", "d3_semantic_search", "d6_reference_items",
    "e1_error_table", "e2_leave_one_out_mean", "e6_error_summary", "e7_run_summary", "f2_paired_comparisons", "f3_holm_adjustment",
    "f4_factorial_effects", "f5_bootstrap_interval", "f9_scale_agreement", "e18_leaderboard", "e26_error_distribution",
    "c11_pending_work", "h4_request_chunks", "h6_anchored_lines", "k1_collected_results", "j1_word_coverage",
]


def main() -> None:
    from thetaloom.plans import QUERIES
    from thetaloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors and their Python workers before the first timing.
    spark.range(0, 1000, 1, 16).mapInArrow(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
