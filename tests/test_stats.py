"""Risk ratio, Katz interval and Fisher's exact test (FIXTURES.md 3.3)."""

import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import stats as S

TABLES = [
    (8, 10, 1, 6, 4.8, 0.780971, 29.501752, 0.034965035),
    (30, 200, 20, 250, 1.875, 1.098825, 3.199441, 0.023194788),
    (5, 100, 5, 100, 1.0, 0.298734, 3.347464, 1.0),
    (120, 1000, 300, 4000, 1.6, 1.309919, 1.954319, 0.000010089),
]


def _fisher_brute(a, n1, c, n0):
    N, K = n1 + n0, a + c

    def pmf(x):
        return math.comb(K, x) * math.comb(N - K, n1 - x) / math.comb(N, n1)
    obs = pmf(a)
    lo, hi = max(0, n1 - (N - K)), min(K, n1)
    return min(1.0, sum(pmf(x) for x in range(lo, hi + 1) if pmf(x) <= obs * (1 + 1e-7)))


@pytest.fixture(scope="module")
def table_df(spark):
    return spark.createDataFrame([(i, *t[:4]) for i, t in enumerate(TABLES)],
                                 "id int, a long, n1 long, c long, n0 long")


def test_rr_ci(table_df):
    a, n1, c, n0 = F.col("a"), F.col("n1"), F.col("c"), F.col("n0")
    lo, hi = S.katz_interval(a, n1, c, n0)
    got = table_df.select("id", S.relative_risk(a, n1, c, n0).alias("rr"), lo.alias("lo"),
                          hi.alias("hi")).orderBy("id").collect()
    for r, t in zip(got, TABLES):
        assert r.rr == pytest.approx(t[4], rel=1e-9)
        assert r.lo == pytest.approx(t[5], abs=1e-6)
        assert r.hi == pytest.approx(t[6], abs=1e-6)
        assert r.lo <= r.rr <= r.hi


def test_fisher_golden(table_df):
    p = S.fisher_exact_two_sided(table_df, ["id"], "a", "n1", "c", "n0").orderBy("id").collect()
    for r, t in zip(p, TABLES):
        assert r.p_value == pytest.approx(t[7], abs=5e-10)  # golden values carry 9 decimals


def test_fisher_matches_brute_force_and_is_symmetric(spark):
    rows = [(a, n1, c, n0) for a, n1, c, n0 in product([0, 1, 3, 7], [7, 12], [0, 2, 5], [5, 9])
            if a <= n1 and c <= n0]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a long, n1 long, c long, n0 long")
    swapped = df.select("id", F.col("c").alias("a"), F.col("n0").alias("n1"), F.col("a").alias("c"),
                        F.col("n1").alias("n0"))
    p = {r.id: r.p_value for r in S.fisher_exact_two_sided(df, ["id"], "a", "n1", "c", "n0").collect()}
    q = {r.id: r.p_value for r in S.fisher_exact_two_sided(swapped, ["id"], "a", "n1", "c", "n0").collect()}
    for i, r in enumerate(rows):
        want = _fisher_brute(*r)
        assert p[i] == pytest.approx(want, rel=1e-9, abs=1e-12)
        assert p[i] == pytest.approx(q[i], rel=1e-9, abs=1e-12)
        assert 0 < p[i] <= 1


def test_stirling_error(spark):
    df = spark.range(1, 400).select(F.col("id"), S.stirling_error(F.col("id")).alias("e"))
    for r in df.collect():
        n = r.id
        main = (n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)
        assert r.e + main == pytest.approx(math.lgamma(n + 1), abs=1e-10)


def test_fisher_ties_at_a_billion_rows(spark):
    """Equal arms make the tables a and K - a equally likely: both tails count."""
    half, hits = 500_000_000, 100_000
    df = spark.createDataFrame([(0, 2, half, 4, half), (1, 49_900, half, hits - 49_900, half)],
                               "id int, a long, n1 long, c long, n0 long")
    p = {r.id: r.p_value for r in S.fisher_exact_two_sided(df, ["id"], "a", "n1", "c", "n0").collect()}
    assert p[0] == pytest.approx(1 - 20 / 64, abs=1e-6)
    sd = math.sqrt(hits / 4 * (1 - hits / (2 * half)))
    assert p[1] == pytest.approx(math.erfc(99.5 / sd / math.sqrt(2)), abs=2e-5)


def test_zero_counts(spark):
    df = spark.createDataFrame([(0, 10, 3, 10), (3, 10, 0, 10), (0, 10, 0, 10)], "a long, n1 long, c long, n0 long")
    a, n1, c, n0 = F.col("a"), F.col("n1"), F.col("c"), F.col("n0")
    lo, hi = S.katz_interval(a, n1, c, n0)
    r = df.select(S.relative_risk(a, n1, c, n0).alias("rr"), lo.alias("lo"), hi.alias("hi")).collect()
    assert (r[0].rr, r[0].lo) == (0.0, 0.0) and math.isnan(r[0].hi)
    assert (r[1].rr, r[1].hi) == (math.inf, math.inf) and math.isnan(r[1].lo)
    assert all(math.isnan(v) for v in r[2])
