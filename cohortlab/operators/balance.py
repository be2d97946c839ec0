"""Covariate balance (E1-E3): Cohen's d per covariate, before and after
matching, for any number of comparisons at once.

One grouped aggregate yields count, mean and sample variance of every
covariate per (comparison, arm); the effect size is column arithmetic on the
two arms' rows of that small table.

After matching with replacement a row counts as often as it was matched. ``arm_cells``
therefore groups by that number as well, and ``weighted_stats`` unites the cells with any
weights: one pass over the feature rows serves both before (weight 1) and after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arm_stats(df: DataFrame, treatment: str, covariates: list[str],
              group: list[str] | None = None) -> DataFrame:
    """Count, mean and sample variance of every covariate per (group, arm):
    one grouped aggregate, reshaped to (group, arm, variable, n, m, v)."""
    g = group or []
    aggs = []
    for i, c in enumerate(covariates):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n_{i}"), F.avg(v).alias(f"m_{i}"), F.var_samp(v).alias(f"v_{i}")]
    st = df.groupBy(*g, treatment).agg(*aggs)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"n_{i}").alias("n"), F.col(f"m_{i}").alias("m"),
                 F.col(f"v_{i}").alias("v")) for i, c in enumerate(covariates)])).alias("x")
    return st.select(*g, treatment, cells).select(*g, treatment, "x.*")


def arm_cells(df: DataFrame, treatment: str, covariates: list[str], weight: str,
              group: list[str] | None = None) -> DataFrame:
    """(group, arm, weight, variable, k, m, s): count, mean and sum of squared deviations of
    every covariate among the rows of one weight. Partial aggregates merge stably; there are
    at most about sqrt(2 x matches) different weights in a group."""
    g = group or []
    aggs = []
    for i, c in enumerate(covariates):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"k_{i}"), F.avg(v).alias(f"m_{i}"), F.var_pop(v).alias(f"s_{i}")]
    st = df.groupBy(*g, treatment, weight).agg(*aggs)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"k_{i}").alias("k"), F.col(f"m_{i}").alias("m"),
                 (F.col(f"s_{i}") * F.col(f"k_{i}")).alias("s")) for i, c in enumerate(covariates)])).alias("x")
    return st.select(*g, treatment, weight, cells).select(*g, treatment, weight, "x.*")


def weighted_stats(cells: DataFrame, treatment: str, weight, group: list[str] | None = None) -> DataFrame:
    """Count, mean and sample variance per (group, arm, variable), as ``arm_stats`` gives them,
    of rows that count ``weight`` (a Column over a cell) times; arms of weight 0 are left out."""
    part = [*(group or []), treatment, "variable"]
    rows = cells.withColumn("_w", weight.cast("long")).where("_w > 0")
    over = Window.partitionBy(*part)  # one small row a weight
    n = F.sum(F.col("_w") * F.col("k")).over(over)
    rows = rows.withColumn("_n", n).withColumn("_m", F.try_divide(
        F.sum(F.col("_w") * F.col("k") * F.col("m")).over(over), F.col("_n").cast("double")))
    square = F.col("_w") * (F.col("s") + F.col("k") * (F.col("m") - F.col("_m")) * (F.col("m") - F.col("_m")))
    return rows.groupBy(*part, F.col("_n").alias("n"), F.col("_m").alias("m")).agg(F.sum(square).alias("_s")) \
        .select(*part, "n", "m", F.try_divide(F.col("_s"), (F.col("n") - 1).cast("double")).alias("v"))


def effect_from_stats(stats: DataFrame, treatment: str, group: list[str] | None = None) -> DataFrame:
    """Cohen's d per (group, variable) from ``arm_stats`` rows of both arms."""
    g = group or []
    t = stats.filter(F.col(treatment) == 1).select(*g, "variable", F.col("n").alias("n1"),
                                                   F.col("m").alias("m1"), F.col("v").alias("v1"))
    c0 = stats.filter(F.col(treatment) == 0).select(*g, "variable", F.col("n").alias("n0"),
                                                    F.col("m").alias("m0"), F.col("v").alias("v0"))
    st2 = t.join(c0, [*g, "variable"], "full_outer")
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"),
                          (F.col("n1") + F.col("n0") - 2).cast("double"))
    d = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled))
    return st2.select(*g, "variable", d.alias("effect_size"))


def cohen_d(df: DataFrame, treatment: str, covariates: list[str],
            group: list[str] | None = None) -> DataFrame:
    """(mean_treated - mean_control) / pooled sample SD, with the pooled
    variance ((n1-1) s1^2 + (n0-1) s0^2) / (n1 + n0 - 2). Undefined values
    (an empty arm, zero pooled SD) are NULL.

    One grouped aggregate computes count, mean and sample variance of every
    covariate per (group, arm) in a single pass; only that small result is
    reshaped to one row per (group, variable)."""
    return effect_from_stats(arm_stats(df, treatment, covariates, group), treatment, group)


def balance_table(effects: DataFrame, group: list[str], digits: int = 2) -> DataFrame:
    """The 'after' effect sizes per comparison, rounded (+ 0.0 turns a
    rounded negative zero into zero)."""
    return effects.filter(F.col("matching") == "after").select(
        *group, "variable", (F.round("effect_size", digits) + 0.0).alias("effect_size"))
