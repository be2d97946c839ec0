"""Interval union, bit-set flags and exposures against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import conditions as C
from cohortlab.operators import exposure as X

DAY0 = dt.date(2020, 1, 1)
SCHEMA = "pat_id long, instance int, noted_date date, resolved_date date, risk_factor string"


def day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def some_intervals(rnd, n, patients, factors, span=60):
    out = []
    for _ in range(n):
        a, b = rnd.randrange(span), rnd.randrange(span)  # may end before it starts
        out.append((rnd.randrange(patients), 1000, day(None if rnd.random() < .08 else a),
                    day(None if rnd.random() < .08 else b), rnd.choice(factors)))
    return out


def covers(interval, d):
    """The study's test: a NULL date passes only an interval open at both ends."""
    _, _, a, b, _ = interval
    return (a is None or (d is not None and d >= a)) and (b is None or (d is not None and d <= b))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_union_covers_the_same_days(spark, seed):
    rnd = random.Random(seed)
    ivs = some_intervals(rnd, 300, 12, ["f1", "f2", "f3"])
    got = [tuple(r) for r in C.interval_union(spark.createDataFrame(ivs, SCHEMA)).select(
        "pat_id", "instance", "noted_date", "resolved_date", "risk_factor", "always").collect()]
    for p in range(12):
        for f in ("f1", "f2", "f3"):
            own = [i for i in ivs if i[0] == p and i[4] == f]
            united = [g for g in got if g[0] == p and g[4] == f]
            for d in map(day, range(-3, 64)):
                met = [g for g in united if covers(g[:5], d)]
                assert len(met) == any(covers(i, d) for i in own)  # one interval at most
            assert any(g[5] for g in united) == any(covers(i, None) for i in own)


def test_join_equals_the_studys_test(spark):
    rnd = random.Random(7)
    ivs = some_intervals(rnd, 400, 15, ["f1", "f2"])
    dates = [(rnd.randrange(15), 1000, day(rnd.choice([None, *range(-3, 64)]))) for _ in range(200)]
    cohort = spark.createDataFrame(dates, "pat_id long, instance int, decided_index_date date")
    hits = C.active_interval_join(cohort, spark.createDataFrame(ivs, SCHEMA))
    want = sorted((p, str(d), f) for p, _, d in dates for f in ("f1", "f2")
                  if any(i[0] == p and i[4] == f and covers(i, d) for i in ivs))
    assert sorted((r.pat_id, str(r.decided_index_date), r.risk_factor) for r in hits.collect()) == want


def test_hot_patient_joins_fewer_rows(spark):
    """One patient with thousands of overlapping diagnoses: a few islands reach the join."""
    rnd = random.Random(9)
    ivs = [(1, 1000, day(rnd.randrange(3000)), None, "f1") if k % 50 == 0 else
           (1, 1000, day(n := rnd.randrange(3000)), day(n + rnd.randrange(40)), rnd.choice(["f1", "f2"])) for k in range(4000)]
    df = spark.createDataFrame(ivs, SCHEMA)
    assert C.interval_union(df).count() < 40
    cohort = spark.createDataFrame([(1, 1000, day(d)) for d in range(0, 3000, 3)], "pat_id long, instance int, decided_index_date date")
    joined = cohort.join(df, ["pat_id", "instance"]).filter(C.active_at(F.col("decided_index_date"), F.col("noted_date"), F.col("resolved_date")))
    assert 20 * C.active_interval_join(cohort, df).count() < joined.count()


def test_flags_of_many_factors(spark):
    factors = [f"f{i}" for i in range(150)]
    hits = [(p, 1000, DAY0, f"f{i}") for p in range(5) for i in range(150) if (i * 7 + p) % 5 == 0] + [(9, 1000, None, "f149"), (9, 1000, None, "other")]
    df = spark.createDataFrame(hits, "pat_id long, instance int, decided_index_date date, risk_factor string")
    for r in C.risk_flag_table(df, factors).collect():
        own = {f for p, _, d, f in hits if p == r.pat_id and d == r.decided_index_date}
        assert [r[f] for f in factors] == [1 if f in own else None for f in factors]


def test_pivot_of_many_classes(spark):
    meds = [f"m{i}" for i in range(32)]
    rnd = random.Random(3)
    rows = [(p, 1000, DAY0, 280, rnd.choice([*meds, None]), *[rnd.choice([0, 0, 1, None]) for _ in X.STATUSES]) for p in range(20) for _ in range(12)]
    df = spark.createDataFrame(rows, "pat_id long, instance int, lmp date, gestational_days int, med_name string, "
                               + ", ".join(f"{s} int" for s in X.STATUSES))
    got = X.exposure_pivot(df, meds).collect()
    assert len(got) == 20
    for r in got:
        for m in meds:
            for k, s in enumerate(X.STATUSES):
                assert r[f"{m}_{s}"] == max([x[5 + k] or 0 for x in rows if x[0] == r.pat_id and x[4] == m], default=0)
