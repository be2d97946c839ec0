"""Many-column matching, positions, grouped fits and Fisher tails against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import stats as S
from cohortlab.operators import grouped_logit as GL
from cohortlab.operators.matching import nn_match_scaled
from cohortlab.operators.metric import MetricIndex, _vectors, nearest_rows
from cohortlab.operators.ordering import with_position
from cohortlab.operators.propensity import propensity_score
from cohortlab.session import cut_lineage

FEATURES = ["x", "y", "z"]
SCHEMA = "p int, id int, x double, y double, z int"


def some_rows(rnd, n, first):
    """Clustered values with many ties, a hot vector (a third of the rows), NULLs and NaN."""
    out = []
    for i in range(n):
        v = (1.0, 2.0, 3) if i % 3 == 0 else (rnd.choice([0.0, 5.0, 9.5]) + rnd.randrange(8) / 4, rnd.gauss(0, 2), rnd.randrange(12))
        out.append([i % 2, first + i, *v])
    for r, k, v in zip(out[1::37], (2, 3, 4) * 40, (None, float("nan"), None) * 40):
        r[k] = v
    return [tuple(r) for r in out]


def known(r):
    return all(v is not None and not math.isnan(v) for v in r[2:])


def brute(queries, pool, scaled):
    q, p = [r for r in queries if known(r)], [r for r in pool if known(r)]
    w = [1.0] * 3
    if scaled:
        w = []
        for c in range(2, 5):
            values = np.array([r[c] for r in queries + pool if r[c] is not None], float)
            var = np.var(values)
            w.append(1 / var if var > 0 else 1.0)
    return {r[1]: min((sum(w[c] * (r[2 + c] - s[2 + c]) * (r[2 + c] - s[2 + c]) for c in range(3)), s[:2]) for s in p)[1] for r in q}


@pytest.mark.parametrize("scaled, pivots, rings", [(True, None, None), (False, 9, 5), (True, 1, 1)])
def test_nearest_rows(spark, scaled, pivots, rings):
    rnd = random.Random(6)
    pool, queries = some_rows(rnd, 900, 0), some_rows(rnd, 400, 5000)
    if scaled:  # NaN has no variance
        fix = lambda rows: [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
        pool, queries = fix(pool), fix(queries)
    p, q = spark.createDataFrame(pool, SCHEMA), spark.createDataFrame(queries, SCHEMA)
    got = {r.id: (r.m_p, r.m_id) for r in nearest_rows(q, p, FEATURES, ["p", "id"], scaled, pivots, rings).collect()}
    assert got == brute(queries, pool, scaled)


def test_match_of_several_columns_returns_the_controls(spark):
    rnd = random.Random(8)
    t = [(1, i, rnd.random(), rnd.random(), rnd.randrange(4)) for i in range(60)]
    c = [(0, 100 + i, rnd.random(), rnd.random(), rnd.randrange(4)) for i in range(200)]
    out = nn_match_scaled(spark.createDataFrame(t, SCHEMA), spark.createDataFrame(c, SCHEMA), FEATURES, ["p", "id"])
    assert out.columns == ["match_id", "p", "id", *FEATURES]
    by_id = {r[1]: r for r in c}
    rows = out.collect()
    assert {r.match_id for r in rows} == {r[1] for r in t} and all(by_id[r.id][2:] == (r.x, r.y, r.z) for r in rows)
    assert nn_match_scaled(spark.createDataFrame(t, SCHEMA), spark.createDataFrame([], SCHEMA), FEATURES, ["p", "id"]).count() == 0


def test_few_pairs_are_examined(spark):
    """20,000 controls in three columns: the work is well below all pairs, and grows slower than the pool."""
    def columns(n, seed):
        return spark.range(n).select(F.lit(0).alias("p"), F.col("id").cast("int").alias("id"),
                                     *[F.rand(seed + i).alias(f) for i, f in enumerate(FEATURES)])
    q = cut_lineage(_vectors(columns(500, 50), FEATURES, ["p", "id"]))
    work = {}
    for n in (5_000, 20_000):
        work[n] = MetricIndex(columns(n, 70), FEATURES, ["p", "id"], [1.0] * 3).examined(q)
    assert work[20_000] < 0.08 * 500 * 20_000
    assert work[20_000] < 4 * work[5_000]


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), rnd.choice(["a", "b", "é", None]), rnd.randrange(50)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(7)
    got = [tuple(r)[:3] for r in sorted(with_position(df, ["a", "b"]).collect(), key=lambda r: r.position)]
    key = lambda r: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v.encode()) for v in r)
    want = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, (r[1] or "").encode()), r[2]))
    assert got == want and key(got[0]) == key(want[0])
    assert with_position(df.limit(0), ["a"]).count() == 0
    ranged = with_position(df, ["a", "b"])
    assert sorted(r.position for r in ranged.collect()) == list(range(1, 3001))


def test_grouped_fits_reach_the_optimum(spark):
    rng = np.random.default_rng(4)
    n, k = 1500, 4
    x = np.column_stack([rng.integers(0, 4, n), rng.integers(0, 2, n), rng.normal(size=n), rng.normal(100, 30, n)])
    groups = ["a", "b", "c"]
    arm = rng.integers(0, 5, n)  # 0-2: treated of a comparison, else control
    own = [(int(i), groups[arm[i]], 1, *map(float, x[i])) for i in range(n) if arm[i] < 3]
    shared = [(int(i), "*", 0, *map(float, x[i])) for i in range(n) if arm[i] >= 3]
    schema = "id int, g string, t int, " + ", ".join(f"x{i} double" for i in range(k))
    names = [f"x{i}" for i in range(k)]
    o, s = spark.createDataFrame(own, schema), spark.createDataFrame(shared, schema)
    got = {(r.g, r.id): r.propensity_score for r in GL.propensity_scores(o, s, "t", names, "g", groups, cut_lineage).collect()}
    assert len(got) == len(own) + 3 * len(shared)
    for c, g in enumerate(groups):
        rows = np.flatnonzero((arm == c) | (arm >= 3))
        d, y, w = np.column_stack([np.ones(len(rows)), x[rows]]), (arm[rows] == c).astype(float), np.zeros(k + 1)
        ridge = np.diag([0, *[1e-6] * k])
        for _ in range(40):
            p = 1 / (1 + np.exp(-d @ w))
            w += np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + ridge, d.T @ (y - p) - ridge @ w)
        want = 1 / (1 + np.exp(-d @ w))
        assert max(abs(got[g, int(i)] - v) for i, v in zip(rows, want)) < 1e-9
        alone = o.filter(F.col("g") == g).unionByName(s)
        ml = {r.id: r.propensity_score for r in propensity_score(alone, "t", names, tol=1e-12).collect()}
        assert max(abs(ml[int(i)] - got[g, int(i)]) for i in rows) < 1e-6


def test_separated_fit_ends(spark):
    """A covariate that only controls have: the weak penalty bounds its weight."""
    rows = [(i, "a" if i < 20 else "*", int(i < 20), float(i >= 20 and i % 2), float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, g string, t int, u double, v double")
    own, shared = df.filter("t = 1"), df.filter("t = 0")
    flat = cut_lineage(df.select(F.when(F.col("t") == 1, F.lit(0)).cast("int").alias("g"), F.col("t").cast("double").alias("y"), F.array("u", "v").alias("x")))
    w, scans = GL.fit_groups(flat, 2, 1)
    assert scans < 60 and w[0, 1] < -10
    out = GL.propensity_scores(own, shared, "t", ["u", "v"], "g", ["a"], cut_lineage)
    assert abs(out.agg(F.sum("propensity_score")).first()[0] - 20) < 1e-4


def test_fisher_terms_at_a_billion(spark):
    tables = [(0, 250_001_000, 500_000_000, 250_000_000, 500_000_000), (1, 5, 10, 3, 10), (2, 250_000_000, 500_000_000, 250_000_000, 500_000_000)]
    df = spark.createDataFrame(tables, "id int, a long, n1 long, c long, n0 long")
    sizes = S.fisher_tails(df, ["id"], "a", "n1", "c", "n0").select(F.sum(F.col("_to") - F.col("_from") + 1)).first()[0]
    assert sizes < 500_000  # of half a billion possible tables each
    p = {r.id: r.p_value for r in S.fisher_exact_two_sided(df, ["id"], "a", "n1", "c", "n0").collect()}
    assert abs(p[2] - 1) < 1e-9
    z = 500 / math.sqrt(1e9 / 16)
    assert abs(p[0] / math.erfc(z / math.sqrt(2)) - 1) < 0.02  # the normal law, up to its continuity term
