"""Structural counts from the final (adaptive) physical plan of queries:
shuffle exchanges, broadcast exchanges, Python-UDF nodes, cartesian nodes.

usage: python tools/plan_stats.py sf_dir name [name ...]
"""

from __future__ import annotations

import json
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def final_plan(df) -> str:
    """The plan that ran: executed through the frame's own query execution, which then
    holds the adaptive planner's final version."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    plan = execution.executedPlan().toString()
    assert "isFinalPlan=false" not in plan
    return plan.split("== Initial Plan ==")[0]


def stats(df) -> dict:
    plan = final_plan(df)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python_udf_nodes": len(re.findall(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", plan)),
        "cartesian_nodes": len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan)),
    }


def main():
    from cohortlab.plans.queries import QUERIES
    from cohortlab.session import get_spark
    spark = get_spark(master="local[8]", shuffle_partitions=16)
    sf = sys.argv[1]
    print(json.dumps({n: stats(QUERIES[n](spark, sf)) for n in sys.argv[2:]}, indent=1))


if __name__ == "__main__":
    main()
