"""Summaries of physical plans: exchanges, broadcasts, joins, windows, Python steps and what the scans read.

usage: python tools/plans.py [--full] name-prefix ...
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WATCHED = ("Exchange", "BroadcastExchange", "ReusedExchange", "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "ShuffledHashJoin",
           "Window", "WindowGroupLimit", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "MapInPandas", "FlatMapGroupsInPandas", "Generate")


def main() -> None:
    from tidemark import catalog
    from tidemark.session import local_session

    full = "--full" in sys.argv
    prefixes = tuple(a for a in sys.argv[1:] if not a.startswith("--"))
    spark = local_session(8)
    for name, run in catalog.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        plan = run(spark, os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        if full:
            print(name, plan, sep="\n")
            continue
        nodes = collections.Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z][A-Za-z]+)", plan, re.M))
        single = len(re.findall(r"Exchange SinglePartition", plan))
        print(name, {k: nodes[k] for k in WATCHED if nodes[k]}, f"single-partition exchanges {single}" if single else "", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
