"""Nearest-neighbour matching on a propensity score (PS3, and PS4 on one feature;
PS4 on several is in ``metric``).

Spark has no nearest-value join, and the study used an in-memory tree on the
driver. ``nearest_score_match`` is an exact 1-nearest-neighbour join on one
score, built from DataFrame operations with no cartesian product:

1. The pool is reduced to distinct scores, each keeping its lowest key (tie
   rule: equal distance -> lower score, equal score -> lower key). The query
   side is reduced to distinct scores too, so a score shared by a third of
   all rows is still one row here.
2. Scores are cut into buckets at approximate quantiles of their own group, so
   each bucket holds a similar number of distinct scores wherever a group's
   scores lie. The split points are one row per group in the plan.
3. Within (group, bucket), ordered by score with pool rows first, each query
   score takes the last pool score at or below it and the first above it.
4. A query at a bucket edge falls back to the nearest pool score of an
   adjacent bucket: one row per (group, bucket).
5. The nearer of the two wins; the matches join back to the query rows on
   (group, score), where AQE splits a hot score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_BUCKETS = 64


def add_buckets(df: DataFrame, col: str, group: list[str], buckets: int) -> DataFrame:
    """``df`` with ``_b``: how many of its group's split points are at or below ``col``.
    The points are approximate quantiles, so a group's buckets hold similar row counts."""
    probs = [i / buckets for i in range(1, buckets)]
    if not probs:
        return df.withColumn("_b", F.lit(0))
    points = df.groupBy(*group).agg(
        F.percentile_approx(col, probs, max(10_000, 20 * buckets)).alias("_points"))
    # one row per group (comparisons), a bounded list
    return df.join(F.broadcast(points), group, "inner").withColumn(
        "_b", F.size(F.filter("_points", lambda x: x <= F.col(col)))).drop("_points")


def nearest_score_match(query: DataFrame, pool: DataFrame, score: str, key: list[str],
                        group: list[str] | None = None, buckets: int | None = None,
                        carry: list[str] | None = None) -> DataFrame:
    """For every ``query`` row: its ``group``, ``key``, ``carry`` columns and ``score`` plus
    the nearest ``pool`` row of the same group as ``m_<key>`` and ``m_<score>``.
    Rows with a NULL score do not take part; a group without pool rows gives
    no output. One output row per matched query row. ``buckets`` (per group) defaults
    to the shuffle partitions, which grow with the data; at least 64."""
    if not group:
        one = F.lit(0)
        return nearest_score_match(query.withColumn("_grp", one), pool.withColumn("_grp", one), score, key,
                                   ["_grp"], buckets, carry).drop("_grp")
    spark = query.sparkSession
    if buckets is None:
        buckets = max(DEFAULT_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = query.filter(F.col(score).isNotNull()).withColumn(score, F.col(score).cast("double"))
    p = pool.filter(F.col(score).isNotNull()).withColumn(score, F.col(score).cast("double"))

    pool_best = p.groupBy(*group, score).agg(F.min(F.struct(*key)).alias("_pk"))
    q_scores = q.select(*group, score).distinct()
    u = pool_best.select(*group, score, F.lit(0).alias("_is_q"), "_pk").unionByName(
        q_scores.select(*group, score, F.lit(1).alias("_is_q"),
                        F.lit(None).cast(pool_best.schema["_pk"].dataType).alias("_pk")))

    u = cut_lineage(u)  # read by the quantile pass, the scan and the edge table
    u = add_buckets(u, score, group, buckets)
    part = [*group, "_b"]
    # Both neighbours come from running frames (unbounded preceding .. current
    # row), which Spark evaluates incrementally; a frame reaching to the end of
    # the partition would be re-aggregated for every row (quadratic).
    # Ascending, pool before query at an equal score: last pool row = the
    # nearest score at or below. Descending, query before pool at an equal
    # score: last pool row = the nearest score strictly above.
    up = Window.partitionBy(*part).orderBy(F.col(score).asc(), F.col("_is_q").asc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*part).orderBy(F.col(score).desc(), F.col("_is_q").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = F.struct(F.col(score).alias("s"), F.col("_pk").alias("k"))
    pool_cell = F.when(F.col("_is_q") == 0, cell)
    scan = u.select(*part, score, "_is_q",
                    F.last(pool_cell, ignorenulls=True).over(up).alias("_prev"),
                    F.last(pool_cell, ignorenulls=True).over(down).alias("_next"))
    qs = scan.filter(F.col("_is_q") == 1)

    # Bucket-edge fallback: the nearest pool entry in a lower / higher bucket.
    stats = u.filter(F.col("_is_q") == 0).groupBy(*part).agg(
        F.max(cell).alias("_bmax"), F.min(cell).alias("_bmin"))
    all_b = u.select(*part).distinct().join(stats, part, "left")
    wb = Window.partitionBy(*group).orderBy("_b")
    edges = all_b.select(
        *part,
        F.last("_bmax", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_lo"),
        F.first("_bmin", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_hi"))
    # edges has one row per (group, bucket); adaptive execution broadcasts it by its size
    qs = qs.join(edges, part, "left")
    prev = F.coalesce(F.col("_prev"), F.col("_lo"))
    nxt = F.coalesce(F.col("_next"), F.col("_hi"))
    take_prev = nxt.isNull() | (prev.isNotNull() & ((F.col(score) - prev.s) <= (nxt.s - F.col(score))))
    best = qs.select(*group, score, F.when(take_prev, prev).otherwise(nxt).alias("_m")) \
             .filter(F.col("_m").isNotNull())

    m = best.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col(score).alias("_qs"),
                    *[F.col(f"_m.k.{k}").alias(f"m_{k}") for k in key],
                    F.col("_m.s").alias(f"m_{score}"))
    qq = q.select(*group, *key, *(carry or []), score)
    cond = [qq[score] == m["_qs"]] + [qq[g] == m[f"_g_{g}"] for g in group]
    out = qq.join(m, cond, "inner")
    return out.drop("_qs", *[f"_g_{g}" for g in group])


def match_direction(df: DataFrame, treatment: str, group: list[str]) -> DataFrame:
    """Per group: treated rows are the queries iff controls outnumber them."""
    sizes = df.groupBy(*group).agg(
        F.sum(F.when(F.col(treatment) == 1, 1).otherwise(0)).alias("_n1"),
        F.sum(F.when(F.col(treatment) == 0, 1).otherwise(0)).alias("_n0"))
    return sizes.select(*group, (F.col("_n0") > F.col("_n1")).alias("_treated_query"))


def propensity_score_matching(df: DataFrame, treatment: str, score: str, key: list[str],
                              group: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """PS3: 1-NN on the score, with replacement, no caliper. Per group, if
    controls outnumber treated rows each treated row takes its nearest
    control, otherwise each control takes its nearest treated row.

    Returns the matched rows of both arms in long form, repeats kept:
    ``match_id`` (the last key column of the query row), ``<treatment>``, the
    key columns and the score; 2 x (smaller arm) rows per group."""
    g = list(group or [])
    d = df if g else df.withColumn("_grp", F.lit(0))
    gg = g or ["_grp"]
    direction = match_direction(d, treatment, gg)
    # one row per group (comparisons), a bounded list
    d = cut_lineage(d.join(F.broadcast(direction), gg, "inner")
                    .select(*gg, *key, score, treatment, "_treated_query"))
    is_q = (F.col(treatment) == 1) == F.col("_treated_query")
    q = d.filter(is_q).select(*gg, *key, score, treatment)
    p = d.filter(~is_q).select(*gg, *key, score)
    pairs = nearest_score_match(q, p, score, key, gg, buckets, carry=[treatment])
    match_id = F.col(key[-1]).alias("match_id")
    q_rows = pairs.select(*gg, match_id, F.col(treatment), *key, score)
    p_rows = pairs.select(*gg, match_id, (1 - F.col(treatment)).alias(treatment),
                          *[F.col(f"m_{k}").alias(k) for k in key],
                          F.col(f"m_{score}").alias(score))
    out = q_rows.unionByName(p_rows)
    return out if g else out.drop("_grp")


def nn_match_scaled(treated: DataFrame, controls: DataFrame, features: list[str],
                    key: list[str], scaled: bool = True) -> DataFrame:
    """PS4: for each treated row its Euclidean nearest control (with replacement), on features
    standardised over both arms or (``scaled=False``) as they are. Returns one matched control
    row per treated row: ``match_id`` (the treated row's last key column), the control's key
    and feature values.

    For one feature, standardising is an increasing linear map, so the nearest control is the
    nearest raw value and the bucketed score join applies; several features go through a
    metric partition (``metric``). Ties go to the lower value of one feature, to the lowest
    key in several; rows with a missing feature are in no pair."""
    if len(features) == 1:
        f = features[0]
        pairs = nearest_score_match(treated.select(*key, f), controls.select(*key, f), f, key)
    else:
        from .metric import nearest_rows
        pairs = nearest_rows(treated, controls, features, key, scaled)
    return pairs.select(F.col(key[-1]).alias("match_id"), *[F.col(f"m_{k}").alias(k) for k in key],
                        *[F.col(f"m_{f}").alias(f) for f in features])


def shared_pool_matching(treated_long: DataFrame, controls: DataFrame, treatment: str, score: str,
                         key: list[str], group: list[str]) -> DataFrame:
    """PS3 for many comparisons that share one control pool with one score per
    control (a fixed score). Output as ``propensity_score_matching(..., group=group)``.

    The directions are one row per comparison. Where
    controls outnumber the treated rows, the treated rows are the queries:
    each is matched once, whatever the number of its comparisons, and the
    pool is not copied. Controls are copied only for comparisons in the
    reverse direction, where each control is a query of its own."""
    t_rows = treated_long.select(*group, *key, score)
    n0 = F.lit(controls.count())
    direction = cut_lineage(t_rows.groupBy(*group).agg((n0 > F.count(F.lit(1))).alias("_forward")))
    t_rows = t_rows.join(direction.select(*group, "_forward"), group, "inner")
    forward = t_rows.filter("_forward").drop("_forward")
    pairs = nearest_score_match(forward.select(*key, score).dropDuplicates(key),
                                controls.select(*key, score), score, key)
    pairs = forward.join(cut_lineage(pairs).drop(score), key, "inner").withColumn(treatment, F.lit(1))

    # one row per comparison: a bounded list, which the controls are exploded by without a join
    reverse = direction.filter(~F.col("_forward")).collect()
    j = pairs
    if reverse:
        names = F.array(*[F.struct(*[F.lit(r[g]).cast(t_rows.schema[g].dataType).alias(g) for g in group]) for r in reverse])
        queries = controls.select(*key, score, F.explode(names).alias("_c")).select(*key, score, "_c.*")
        back = nearest_score_match(queries, t_rows.filter(~F.col("_forward")).drop("_forward"), score, key, group)
        j = pairs.unionByName(back.withColumn(treatment, F.lit(0)))
    match_id = F.col(key[-1]).alias("match_id")
    q_rows = j.select(*group, match_id, treatment, *key, score)
    p_rows = j.select(*group, match_id, (1 - F.col(treatment)).alias(treatment),
                      *[F.col(f"m_{k}").alias(k) for k in key], F.col(f"m_{score}").alias(score))
    return q_rows.unionByName(p_rows)
