"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Every query is planned from Parquet and its whole result is produced (noop sink).
BENCH_QUERIES may name a comma-separated list of prefixes, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import catalog  # noqa: E402
from tidemark.session import local_session, sweep  # noqa: E402

HEADLINE = (
    "b1_as_of_latest", "b2_as_of_current", "b6_exclude_superseded", "b11_content_digest", "b12_xor_fingerprint",
    "d1_competition_intervals", "d3_rolling_entity_sums", "d5_marker_between",
    "e1_reduce_ordered_group", "e3_side_rollup", "e10_import_quality_counts", "e12_tokenise_and_map", "e15_reconcile_side_totals",
    "c1_reference_violations", "c6_audit_member_totals", "c7_audit_group_scores", "c9_audit_transitions",
    "f4_empirical_bayes_shrinkage", "f5_numeric_distribution", "f8_empirical_event_probabilities",
    "w4_rolling_count_rate", "w5_ewma_recursive", "w7_last_n_per_entity", "w8_before_day_features", "w11_interval_union",
    "g1_entity_features", "g2_pregame_side_features", "g6_pregame_member_features", "g10_relation_edges", "g12_side_nodes",
    "g15_merge_overlapping_sources", "g18_member_success_queries", "h5_evaluate", "h7_partial_observation_nll", "h13_paired_sensitivity",
    "j4_score_selections", "j5_enumerate_picks",
    "g9_fit_and_score", "g11_entity_nodes", "g21_member_group_edges", "g24_build_day_tables", "g26_sample_index", "g27_route_coverage",
    "g27_reachability", "c15_distinct_priors", "h12_out_of_fold_stack", "p2_fixed_batch_workload", "s4_seeded_cap",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="tidemark-bench")
    queries = catalog.queries()
    if wanted == "all":
        names = list(queries)
    elif wanted:
        names = [n for n in queries if n.startswith(tuple(wanted.split(",")))]
    else:
        names = list(HEADLINE)
    queries["b1_as_of_latest"](spark, folder).write.format("noop").mode("overwrite").save()  # start the executors
    times = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        sweep(spark)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
