"""Look for plan shapes that do not scale: python tools/plans.py [key ...]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.plans import catalog  # noqa: E402
from riskloom.session import local_session  # noqa: E402

SMELLS = {
    "nested loop": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "row python": r"BatchEvalPython",
    "arrow python": r"ArrowEvalPython",
    "grouped python": r"FlatMapGroupsInPandas",
    "single partition": r"Exchange SinglePartition",
}


def main():
    spark = local_session("plans")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for key in sys.argv[1:] or catalog.QUERIES:
        df = catalog.QUERIES[key](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = {n: len(re.findall(p, plan)) for n, p in SMELLS.items()}
        found["shuffles"] = len(re.findall(r"Exchange hashpartitioning", plan))
        lone = re.findall(r"Exchange SinglePartition.*\n(.*)", plan)
        bad = [x.strip(" :+-") [:60] for x in lone if "HashAggregate" not in x and "ObjectHashAggregate" not in x]
        print(f"{key:28}", {n: c for n, c in found.items() if c}, "LONE" if bad else "", bad[:2], flush=True)


if __name__ == "__main__":
    main()
