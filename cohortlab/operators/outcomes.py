"""Outcome counts and per-comparison risk statistics.

The study collected each arm to the driver, counted outcomes in a Python row
loop and called SciPy once per outcome and comparison. Here all analyses,
comparisons and outcomes are rows of one long frame: one grouped count,
column arithmetic for the risk ratio and interval, and one support expansion
for Fisher's test. Only the final table (analyses x comparisons x 4
outcomes) is small enough to show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import stats as S
from ..functions.encoders import pval_signal

def outcome_tests() -> dict[str, Column]:
    return {
        "ptb": F.col("preterm_category") == V.OUTCOME_PRETERM,
        "lbw": F.col("LBW") == V.OUTCOME_LBW,
        "sga": F.col("SGA") == V.OUTCOME_SGA,
        "csec": F.col("delivery_method") == V.OUTCOME_CSECTION,
    }


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def outcome_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """A10/O1: rows and outcome counts per group (NULL outcome: not counted)."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                  *[_count_if(c).alias(k) for k, c in outcome_tests().items()])


def outcome_long(counts_treated: DataFrame, counts_control: DataFrame, group: list[str]) -> DataFrame:
    """One row per (group, outcome) with a, n1 (treated) and c, n0 (control)."""
    t = counts_treated.select(*group, F.col("n").alias("n1"),
                              *[F.col(k).alias(f"t_{k}") for k in V.OUTCOMES])
    c = counts_control.select(*group, F.col("n").alias("n0"),
                              *[F.col(k).alias(f"c_{k}") for k in V.OUTCOMES])
    j = t.join(c, group, "inner")
    stack = F.explode(F.array(*[
        F.struct(F.lit(k).alias("outcome"), F.col(f"t_{k}").alias("a"), F.col(f"c_{k}").alias("c"))
        for k in V.OUTCOMES])).alias("o")
    return j.select(*group, "n1", "n0", stack).select(*group, "o.outcome", "o.a", "n1", "o.c", "n0")


def risk_table(long: DataFrame, group: list[str]) -> DataFrame:
    """Risk ratio, Katz 95% interval, two-sided Fisher p and its star
    code per (group, outcome). ``rr``, ``lower``, ``upper`` are rounded to 2
    places as in the study's report; ``*_raw`` and ``p_value`` keep 6."""
    a, n1, c, n0 = F.col("a"), F.col("n1"), F.col("c"), F.col("n0")
    rr = S.relative_risk(a, n1, c, n0)
    lo, hi = S.katz_interval(a, n1, c, n0)
    ids = [*group, "outcome"]
    # the counts travel through Fisher's aggregate, so the counts below are planned once
    t = S.fisher_exact_two_sided(long, [*ids, "a", "n1", "c", "n0"], "a", "n1", "c", "n0")
    t = t.withColumns({"_rr": rr, "_lo": lo, "_hi": hi})
    return t.select(*ids, "a", "n1", "c", "n0",
                    F.round("_rr", 2).alias("rr"), F.round("_lo", 2).alias("lower"),
                    F.round("_hi", 2).alias("upper"), pval_signal(F.col("p_value")).alias("pval"),
                    F.round("_rr", 6).alias("rr_raw"), F.round("_lo", 6).alias("lower_raw"),
                    F.round("_hi", 6).alias("upper_raw"), F.round("p_value", 6).alias("p_value"))
