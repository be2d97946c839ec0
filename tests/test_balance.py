"""Weighted moments: a row that counts w times equals w copies of it."""

import math
import random

from pyspark.sql import functions as F

from cohortlab.operators.balance import arm_cells, arm_stats, cohen_d, effect_from_stats, weighted_stats


def _rows(n=400):
    rnd = random.Random(17)
    out = [("abc"[i % 3], i % 2, rnd.choice([0, 0, 1, 1, 2, 5, 40]),
            1e6 + rnd.random(), None if i % 5 == 0 else rnd.randint(0, 1), 3.0) for i in range(n)]
    return out + [("one", 0, 1, 5.0, None, 1.0), ("one", 1, 0, 6.0, 1, 1.0), ("none", 1, 0, 7.0, 1, None)]


SCHEMA = "g string, arm int, w long, x double, y int, z double"


def _close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9))


def _same(got, want, key):
    got = {tuple(r[k] for k in key): r for r in got.collect()}
    want = {tuple(r[k] for k in key): r for r in want.collect()}
    assert got.keys() == want.keys() and got
    for k, r in want.items():
        assert all(_close(got[k][c], r[c]) for c in r.asDict()), (k, got[k], r)


def test_weighted_moments_equal_copies(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    cells = arm_cells(df, "arm", ["x", "y", "z"], "w", ["g"])
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest("w", F.lit(1))))).where("w > 0")
    key = ["g", "arm", "variable"]
    _same(weighted_stats(cells, "arm", F.col("w"), ["g"]), arm_stats(copies, "arm", ["x", "y", "z"], ["g"]), key)
    _same(weighted_stats(cells, "arm", F.lit(1), ["g"]), arm_stats(df, "arm", ["x", "y", "z"], ["g"]), key)
    effects = effect_from_stats(weighted_stats(cells, "arm", F.col("w"), ["g"]), "arm", ["g"])
    _same(effects.where("variable != 'z'"), cohen_d(copies, "arm", ["x", "y"], ["g"]), ["g", "variable"])
    assert effects.where("variable = 'z' and effect_size is not null").isEmpty()  # constant: no spread


def test_no_rows_no_cells(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert weighted_stats(arm_cells(df, "arm", ["x"], "w", ["g"]), "arm", F.col("w"), ["g"]).count() == 0
