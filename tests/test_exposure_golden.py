"""Golden vectors for exposure periods and durations (FIXTURES.md 3.1)."""

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import exposure as X

# s, e, ga, period, d0, d1, d2, d3 (reference mode)
GOLDEN = [
    (-200, -190, 280, -1, 0, 0, 0, 0),
    (-200, -10, 280, -1, -189, 0, 0, 0),
    (-200, 30, 280, -1, 180, 31, 0, 0),
    (-90, 30, 280, 0, 91, 31, 0, 0),
    (-90, -30, 280, 0, 61, 0, 0, 0),
    (0, 10, 280, 1, 0, 11, 0, 0),
    (80, 100, 280, 1, 0, 5, 17, 0),
    (85, 100, 280, 2, 0, 0, 0, 0),
    (91, 100, 280, 2, 0, 0, 10, 0),
    (85, 200, 280, 2, 0, 0, 105, 12),
    (-300, 400, 280, -1, 180, 84, 105, 92),
    (200, 300, 280, 3, 0, 0, 0, 81),
    (200, 260, 280, 3, 0, 0, 0, 61),
    (285, 300, 280, 3, 0, 0, 0, 0),
    (189, 189, 280, 3, 0, 0, 0, 1),
    (321, 330, 280, 4, 0, 0, 0, 0),
    (10, -5, 280, 1, None, 0, 0, 0),
    (100, 250, 185, 2, 0, 0, 90, 0),
]

EDGES = [(-181, -1), (-180, 0), (-1, 0), (0, 1), (83, 1), (84, 2), (188, 2), (189, 3), (320, 3), (321, 4)]


@pytest.fixture(scope="module")
def golden_df(spark):
    return spark.createDataFrame(GOLDEN, "s int, e int, ga int, period int, d0 int, d1 int, d2 int, d3 int")


def test_reference_mode(golden_df):
    s, e, ga = F.col("s"), F.col("e"), F.col("ga")
    out = golden_df.select(
        "*", X.exposure_period(s).alias("p"), X.exposure0_duration(s, e).alias("x0"),
        X.exposure1_duration(s, e).alias("x1"), X.exposure2_duration(s, e).alias("x2"),
        X.exposure3_duration(s, e, ga).alias("x3")).collect()
    for r in out:
        assert (r.p, r.x0, r.x1, r.x2, r.x3) == (r.period, r.d0, r.d1, r.d2, r.d3), r


def test_period_edges(spark):
    df = spark.createDataFrame(EDGES, "d int, want int")
    for r in df.select("want", X.exposure_period(F.col("d")).alias("got")).collect():
        assert r.got == r.want


def test_clipped_mode_is_overlap(spark):
    rows = [(s, e, 280) for s in range(-250, 340, 17) for e in range(-250, 340, 23) if e >= s]
    df = spark.createDataFrame(rows, "s int, e int, ga int")
    s, e, ga = F.col("s"), F.col("e"), F.col("ga")
    out = df.select("s", "e", X.exposure0_duration(s, e, "clipped").alias("c0"),
                    X.exposure1_duration(s, e, "clipped").alias("c1"),
                    X.exposure2_duration(s, e, "clipped").alias("c2"),
                    X.exposure3_duration(s, e, ga, "clipped").alias("c3")).collect()
    for r in out:
        days = set(range(r.s, r.e + 1))
        assert r.c0 == len(days & set(range(-180, 0)))
        assert r.c1 == len(days & set(range(0, 84)))
        assert r.c2 == len(days & set(range(84, 189)))
        assert r.c3 == len(days & set(range(189, 281)))
