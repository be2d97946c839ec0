"""Risk ratio, Katz confidence interval and Fisher's exact test as column
expressions (O2, O3).

Hypergeometric probabilities use the saddle-point form: three binomial terms,
each a deviance plus the errors of Stirling's formula. Differences of ln(n!)
would lose the digits that tell equal tables apart (N ln N is 2e10 at N = 1e9);
here the terms are of the size of the result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import FISHER_REL_TOL, Z_975

SERIES_FROM = 10
_SMALL_ERROR = [0.0] + [math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi))
                        for n in range(1, SERIES_FROM)]


def stirling_error(n: Column) -> Column:
    """ln(n!) - ((n + 1/2) ln n - n + ln(2 pi) / 2) for integer n >= 1."""
    x = F.greatest(n.cast("double"), F.lit(float(SERIES_FROM)))  # series branch only
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x
    table = F.array(*[F.lit(v) for v in _SMALL_ERROR])
    return F.when(n < SERIES_FROM, F.element_at(table, (n + 1).cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x."""
    e = (x - mean) / mean
    return mean * ((1 + e) * F.log1p(e) - e)


def _ln_binomial(k: Column, m: Column, p: Column) -> Column:
    """ln P(k successes of m) for 0 < p < 1."""
    r = m - k
    inner = (stirling_error(m) - stirling_error(k) - stirling_error(r)
             - _deviance(k, m * p) - _deviance(r, m * (1 - p))
             - 0.5 * F.log(2 * math.pi * k.cast("double") * r / m))
    return F.when(k == 0, m * F.log1p(-p)).when(r == 0, m * F.log(p)).otherwise(inner)


def relative_risk(a: Column, n1: Column, c: Column, n0: Column) -> Column:
    """(a/n1) / (c/n0); infinite with c = 0, NaN with a = c = 0, NULL for an empty arm."""
    return F.when((n1 == 0) | (n0 == 0), F.lit(None).cast("double")) \
        .when((c == 0) & (a == 0), F.lit(math.nan)).when(c == 0, F.lit(math.inf)) \
        .otherwise(F.try_divide(F.try_divide(a.cast("double"), n1), F.try_divide(c.cast("double"), n0)))


def katz_interval(a: Column, n1: Column, c: Column, n0: Column, z: float = Z_975) -> tuple[Column, Column]:
    """Log-normal (Katz) interval: RR * exp(-/+ z * sqrt(1/a - 1/n1 + 1/c - 1/n0)).
    With a = 0 the lower bound is 0 and the upper NaN; with c = 0 the lower is
    NaN and the upper infinite; with both 0 both are NaN; NULL for an empty arm."""
    rr = relative_risk(a, n1, c, n0)
    se = F.sqrt(F.try_divide(F.lit(1.0), a) - F.try_divide(F.lit(1.0), n1)
                + F.try_divide(F.lit(1.0), c) - F.try_divide(F.lit(1.0), n0))
    empty = F.when((n1 == 0) | (n0 == 0), F.lit(None).cast("double"))
    lo = empty.when(c == 0, F.lit(math.nan)).when(a == 0, F.lit(0.0)).otherwise(rr * F.exp(-z * se))
    hi = empty.when(a == 0, F.lit(math.nan)).when(c == 0, F.lit(math.inf)).otherwise(rr * F.exp(z * se))
    return lo, hi


DROP = 50.0  # a tail is summed to where its terms are e^-50 of its first


def _search(low: Column, high: Column, holds) -> Column:
    """Where a condition on the integers between ``low`` and ``high`` (both excluded) turns from
    true to false: the last that holds, or ``low``. Bisection, 63 halvings at most."""
    def halve(acc, _):
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("long")
        inside = acc["high"] - acc["low"] > 1
        ok = holds(mid)
        return F.struct(F.when(inside & ok, mid).otherwise(acc["low"]).alias("low"),
                        F.when(inside & ~ok, mid).otherwise(acc["high"]).alias("high"))
    start = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, halve)["low"]


def fisher_tails(df: DataFrame, id_cols: list[str], a: str, n1: str, c: str, n0: str) -> DataFrame:
    """``id_cols``, the table's margins, its log probability and, for either tail of tables no
    more likely than it (relative tolerance 1e-7), the range [_from, _to] to be summed.

    Hypergeometric probabilities rise to the mode and fall from it, so bisection finds where
    each tail starts. They are log-concave: their ratios shrink outward, so if the term d
    places out is e^-50 of the first, all terms beyond it together are at most e^-50 (1 + d / 50)
    of the first. Summing stops there, after some tens of standard deviations, i.e. about
    sqrt(N) terms."""
    N = F.col(n1) + F.col(n0)
    K = F.col(a) + F.col(c)
    base = df.select(*id_cols, F.col(a).cast("long").alias("_a"), F.col(n1).cast("long").alias("_n1"), N.cast("long").alias("_N"),
                     K.cast("long").alias("_K"), F.greatest(F.lit(0), F.col(n1) - (N - K)).cast("long").alias("_lo"),
                     F.least(K, F.col(n1)).cast("long").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    mode = F.floor((F.col("_n1") + 1).cast("double") * (F.col("_K") + 1) / (F.col("_N") + 2)).cast("long")
    base = base.withColumn("_mode", F.greatest(lo, F.least(hi, mode))) \
        .withColumn("_limit", _ln_hypergeometric(F.col("_a")) + math.log1p(FISHER_REL_TOL))
    rare = lambda x: _ln_hypergeometric(x) <= F.col("_limit")
    base = base.withColumns({"_left": _search(lo - 1, F.col("_mode") + 1, rare),
                             "_right": _search(F.col("_mode"), hi + 1, lambda x: ~rare(x)) + 1})
    far = lambda x, start: _ln_hypergeometric(x) < _ln_hypergeometric(F.col(start)) - DROP
    first = F.when(F.col("_left") >= lo, _search(lo - 1, F.col("_left") + 1, lambda x: far(x, "_left")) + 1)
    last = F.when(F.col("_right") <= hi, _search(F.col("_right") - 1, hi + 1, lambda x: ~far(x, "_right")))
    base = base.withColumns({"_first": first, "_last": last})
    sides = F.array(F.struct(F.col("_first").alias("from"), F.col("_left").alias("to")),
                    F.struct(F.col("_right").alias("from"), F.col("_last").alias("to")))
    return base.select(*id_cols, "_n1", "_N", "_K", F.explode(F.filter(
        sides, lambda s: s["from"] <= s["to"])).alias("_side")).select(
        *id_cols, "_n1", "_N", "_K", F.col("_side.from").alias("_from"), F.col("_side.to").alias("_to"))


def _ln_hypergeometric(x: Column) -> Column:
    n, total, hits = F.col("_n1"), F.col("_N"), F.col("_K")
    p = n / total
    # an empty arm leaves one possible table
    return F.when((n == 0) | (n == total), F.lit(0.0)).otherwise(
        _ln_binomial(x, hits, p) + _ln_binomial(n - x, total - hits, p) - _ln_binomial(n, total, p))


def fisher_exact_two_sided(df: DataFrame, id_cols: list[str], a: str, n1: str, c: str, n0: str,
                           chunk: int = 50_000) -> DataFrame:
    """O3: two-sided Fisher exact p for each row's 2x2 table
    [[a, n1 - a], [c, n0 - c]]: the sum of hypergeometric probabilities of all
    tables with the same margins that are no more likely than the observed
    one (relative tolerance 1e-7), over the ranges of ``fisher_tails``.

    A range is expanded in chunks of ``chunk`` values that are spread over tasks, then summed
    back by ``id_cols``."""
    step = F.lit(chunk).cast("long")
    e = fisher_tails(df, id_cols, a, n1, c, n0).withColumn("_c0", F.explode(F.sequence(F.col("_from"), F.col("_to"), step)))
    e = e.repartition(*id_cols, "_c0")
    e = e.withColumn("_x", F.explode(F.sequence(F.col("_c0"), F.least(F.col("_c0") + step - 1, F.col("_to")))))
    p = e.groupBy(*id_cols).agg(F.sum(F.exp(_ln_hypergeometric(F.col("_x")))).alias("p_value"))
    return p.withColumn("p_value", F.least(F.lit(1.0), F.col("p_value")))
