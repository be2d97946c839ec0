"""Benchmark the headline queries.

Runs each query fully (a ``noop`` write, so every row is computed and nothing
is collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one
JSON line: {"metric", "value", "unit", "queries": {name: seconds}, "sf"}.
Times include plan construction, which for the matching stages runs the
checkpoint jobs that materialise the study cohort.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "risk_flags",            # conditions active at LMP (flagship)
    "diag_snomed",           # diagnosis history chain
    "exposure_pivot",        # medication exposure flags
    "medinfo_exposure",      # per-order durations
    "psm_features",          # covariate frame
    "psm_match_1nn",         # exact nearest-score matching
    "balance_by_comparison", # effect sizes after matching, 13 comparisons
    "outcomes_adjusted",     # risk ratios, intervals, Fisher p
    "outcomes_unadjusted",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from cohortlab.plans.queries import QUERIES
    from cohortlab.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      app="cohortlab-bench")
    # warm-up (JVM start, JIT of the generated code) on the smallest tables when
    # present, so the first timed query is not charged for it
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in ("risk_flags", "exposure_pivot"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    QUERIES["cohort_counts"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
