"""Nearest-score matching: golden cases (FIXTURES.md 3.4), brute-force
equivalence with ties and groups, output size, and plan shape."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators.matching import nearest_score_match, propensity_score_matching


def brute(queries, pool):
    out = {}
    for g, qk, qs in queries:
        cands = [(abs(qs - ps), ps, pk) for pg, pk, ps in pool if pg == g]
        if cands:
            out[(g, qk)] = min(cands)[2]
    return out


def test_golden(spark):
    pool = spark.createDataFrame([(1, 0.125), (2, 0.375), (3, 0.5625), (4, 1.0), (5, 0.3), (6, 0.1)],
                                 "id long, s double")
    q = spark.createDataFrame([(10, 0.25), (11, 0.5), (12, 0.875), (13, 0.0), (14, 1.5), (15, 0.2)],
                              "id long, s double")
    p1 = pool.filter(F.col("id") <= 4)
    got = {r.id: r.m_id for r in nearest_score_match(q.filter(F.col("id") <= 14), p1, "s", ["id"]).collect()}
    assert got == {10: 1, 11: 3, 12: 4, 13: 1, 14: 4}
    got2 = {r.id: r.m_id for r in nearest_score_match(q.filter(F.col("id") == 15),
                                                      pool.filter(F.col("id") >= 5), "s", ["id"]).collect()}
    assert got2 == {15: 5}  # 0.3 - 0.2 < 0.2 - 0.1 in binary


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    grid = [round(rnd.random(), 3) for _ in range(60)]  # few distinct values: many ties
    pool = [(rnd.choice("ab"), i, rnd.choice(grid)) for i in range(400)]
    queries = [(rnd.choice("abc"), 10_000 + i, rnd.choice(grid + [rnd.random()])) for i in range(300)]
    pdf = spark.createDataFrame(pool, "g string, id long, s double")
    qdf = spark.createDataFrame(queries, "g string, id long, s double")
    got = {(r.g, r.id): r.m_id for r in nearest_score_match(qdf, pdf, "s", ["id"], ["g"], buckets=7).collect()}
    assert got == brute(queries, pool)


def test_direction_and_size(spark):
    rnd = random.Random(7)
    rows = [(i, 1 if i % 5 == 0 else 0, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "episode_id long, t int, s double")
    out = propensity_score_matching(df, "t", "s", ["episode_id"])
    n_treated = sum(1 for r in rows if r[1] == 1)
    assert out.count() == 2 * n_treated
    assert out.filter(F.col("t") == 1).count() == n_treated
    rev = propensity_score_matching(df.withColumn("t", 1 - F.col("t")), "t", "s", ["episode_id"])
    assert rev.count() == 2 * n_treated
    assert rev.filter(F.col("t") == 0).count() == n_treated  # controls are the queries now


def test_no_cartesian_or_python(spark):
    rows = [(i, i % 3, (i * 37 % 101) / 101.0) for i in range(200)]
    df = spark.createDataFrame(rows, "episode_id long, t int, s double").withColumn("t", (F.col("t") == 0).cast("int"))
    plan = propensity_score_matching(df, "t", "s", ["episode_id"])._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_shared_pool_equals_grouped(spark):
    from cohortlab.operators.matching import shared_pool_matching
    rnd = random.Random(21)
    controls = [(i, round(rnd.random(), 3)) for i in range(300)]
    treated = [(1000 + i, round(rnd.random(), 3)) for i in range(360)]
    groups = ["all", "g1", "g2"]  # "all" has more treated rows than controls: matched in reverse
    t_long = [(g, k, s) for k, s in treated for g in groups if g == "all" or (k + len(g)) % 2 == 0]
    c_long = [(g, k, s) for k, s in controls for g in groups]
    long = spark.createDataFrame([(g, 1, k, s) for g, k, s in t_long] + [(g, 0, k, s) for g, k, s in c_long],
                                 "comparison string, t int, episode_id long, s double")
    grouped = propensity_score_matching(long, "t", "s", ["episode_id"], group=["comparison"])
    shared = shared_pool_matching(long.filter(F.col("t") == 1), spark.createDataFrame(controls, "episode_id long, s double"),
                                  "t", "s", ["episode_id"], ["comparison"])
    cols = ["comparison", "match_id", "t", "episode_id", "s"]
    assert sorted(map(tuple, grouped.select(*cols).collect())) == sorted(map(tuple, shared.select(*cols).collect()))
