"""Hot keys: one key holds a third of all rows. Results must stay exact (the
skew handling only changes how work is spread, never the answer)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators.conditions import active_interval_join, risk_flag_table
from cohortlab.operators.diagnoses import diagnosis_concept_map, diagnosis_first_contact, diagnosis_full_name
from cohortlab.operators.exposure import medication_orders
from cohortlab.operators.skew import full_outer_join
from cohortlab.operators.matching import add_buckets, nearest_score_match
from cohortlab.session import split_hot_keys


@pytest.mark.parametrize("split_rows", [1 << 20, 100, 7, 1])
def test_split_full_outer_equals_full_outer(spark, split_rows):
    rnd = random.Random(3)
    left = [(1 if i % 3 == 0 else rnd.randint(2, 40), rnd.randint(1, 5), f"l{i}") for i in range(600)]
    right = [(1 if i % 3 == 0 else rnd.randint(20, 60), rnd.randint(1, 5), f"r{i}") for i in range(600)]
    left.append((None, 1, "lnull"))
    right.append((None, 1, "rnull"))
    right += [(1, 1, "same")] * 40  # a hot key of identical rows
    left += [(70, 1, "lonely")] * 50  # hot on one side, missing on the other
    right += [(71, 1, "lonely")] * 50
    left += [(72, 1, "few")] * 2  # hot on the right only
    right += [(72, 1, "many")] * 60
    right += [(None, 1, "rnull")] * 30
    l = spark.createDataFrame(left, "k long, d int, a string")
    r = spark.createDataFrame(right, "k long, d int, b string")
    got = sorted(map(tuple, full_outer_join(l, r, ["k", "d"], split_rows)
                     .select("k", "d", "a", "b").collect()), key=repr)
    want = sorted(map(tuple, l.join(r, ["k", "d"], "full_outer").select("k", "d", "a", "b").collect()),
                  key=repr)
    assert got == want


def test_hot_key_of_a_full_outer_join_is_spread(spark, low_skew_limits):
    """One key holds a third of the left rows: after the join no task holds more than a few
    parts of it, and each source is scanned by one job only."""
    n = 30_000
    left = spark.range(0, n, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(0, n, numPartitions=4).select((F.col("id") - 1).alias("k"), F.col("id").alias("b"))
    got = full_outer_join(left, right, ["k"], split_rows=500)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and plan.count("FullOuter") == 1  # it reads the stage table only
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = got.withColumn("t", F.spark_partition_id()).where("k = -1").groupBy("t").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in tasks) == n // 3 and max(r["count"] for r in tasks) < n // 6
    want = left.join(right, "k", "full_outer")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_interval_flags_with_hot_patient(spark):
    rnd = random.Random(5)
    base = dt.date(2020, 1, 1)
    cohort = [(1 if i % 3 == 0 else rnd.randint(2, 50), 1000, base + dt.timedelta(days=rnd.randint(0, 400)))
              for i in range(450)]
    ivs = []
    for i in range(900):
        p = 1 if i % 3 == 0 else rnd.randint(2, 50)
        n = None if i % 7 == 0 else base + dt.timedelta(days=rnd.randint(0, 400))
        r = None if i % 5 == 0 else (n or base) + dt.timedelta(days=rnd.randint(0, 120))
        ivs.append((p, 1000, n, r, rnd.choice(["f1", "f2", "f3"])))
    c = spark.createDataFrame(cohort, "pat_id long, instance int, decided_index_date date")
    iv = spark.createDataFrame(ivs, "pat_id long, instance int, noted_date date, resolved_date date, "
                                    "risk_factor string")
    flags = risk_flag_table(active_interval_join(c, iv), ["f1", "f2", "f3"])
    got = {(r.pat_id, r.decided_index_date): (r.f1, r.f2, r.f3) for r in flags.collect()}
    want = {}
    for p, inst, d in cohort:
        hit = {f for (q, qi, n, r, f) in ivs if q == p and qi == inst and (n is None or d >= n)
               and (r is None or d <= r)}
        if hit:
            want[(p, d)] = tuple(1 if f in hit else None for f in ["f1", "f2", "f3"])
    assert got == want


def test_matching_with_hot_score(spark):
    rnd = random.Random(11)
    pool = [(i, 0.5 if i % 3 == 0 else round(rnd.random(), 4)) for i in range(900)]
    queries = [(10_000 + i, 0.5 if i % 3 == 0 else rnd.random()) for i in range(600)]
    p = spark.createDataFrame(pool, "id long, s double")
    q = spark.createDataFrame(queries, "id long, s double")
    got = {r.id: r.m_id for r in nearest_score_match(q, p, "s", ["id"], buckets=9).collect()}
    for qid, qs in queries:
        best = min((abs(qs - ps), ps, pid) for pid, ps in pool)
        assert got[qid] == best[2]
    assert got[10_000] == 0  # the hot score matches its lowest key


def _final_plan(df):
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


@pytest.fixture
def low_skew_limits(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
            "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    split_hot_keys(spark)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _half_hot(spark, n):
    """Ids 0..n-1 over four tasks, ``k`` = 1 for every other row."""
    return spark.range(0, n, numPartitions=4).withColumn(
        "k", F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).cast("long"))


def test_hot_diagnosis_is_split(spark, low_skew_limits):
    """D4 + D6: half the rows hold one diagnosis."""
    diag = _half_hot(spark, 20_000).select(
        F.col("id").alias("pat_id"), F.col("k").alias("dx_id"), F.lit(1000).alias("instance"),
        F.to_date(F.lit("2020-01-01")).alias("CONTACT_DATE"), F.lit(None).cast("date").alias("NOTED_DATE"),
        F.lit(None).cast("date").alias("RESOLVED_DATE"), F.concat(F.lit("dx "), F.hex("id")).alias("DIAGNOSISNAME"))
    mapping = spark.range(0, 20_000, numPartitions=4).select(
        F.col("id").alias("value"), F.lit(1000).alias("instance"), F.lit("dx").alias("name"),
        F.concat(F.lit("SNOMED#"), "id").alias("concept"))
    got = diagnosis_first_contact(diagnosis_full_name(diagnosis_concept_map(diag, mapping, dedup=False)))
    assert "skew=true" in _final_plan(got)
    assert got.count() == 20_000


def test_hot_patient_is_split_under_the_flags(spark, low_skew_limits):
    """Half the pregnancies carry one patient id."""
    day = F.date_add(F.to_date(F.lit("2000-01-01")), F.col("id").cast("int"))
    cohort = _half_hot(spark, 20_000).select(F.col("k").alias("pat_id"), F.lit(1000).alias("instance"),
                                             day.alias("decided_index_date"))
    none = F.lit(None).cast("date")
    ivs = spark.range(0, 20_000, numPartitions=4).select(
        F.col("id").alias("pat_id"), F.lit(1000).alias("instance"), none.alias("noted_date"),
        none.alias("resolved_date"), F.lit("f1").alias("risk_factor"))
    got = risk_flag_table(active_interval_join(cohort, ivs), ["f1", "f2"])
    assert "skew=true" in _final_plan(got)
    assert got.filter("f1 = 1 and f2 is null").count() == 20_000


def test_hot_patient_is_split_under_the_orders(spark, low_skew_limits):
    """M1: half the medication orders carry one patient id."""
    date = lambda s: F.to_date(F.lit(s))
    cohort = spark.range(0, 20_000, numPartitions=4).select(
        F.col("id").alias("pat_id"), F.lit(1000).alias("instance"), F.lit(270).alias("gestational_days"),
        date("2020-01-01").alias("lmp"), date("2020-10-01").alias("ob_delivery_delivery_date"))
    orders = _half_hot(spark, 20_000).select(
        F.col("k").alias("pat_id"), F.lit(1000).alias("instance"), F.col("id").alias("dose"),
        date("2020-02-01").alias("start_date"), date("2020-03-01").alias("end_date"),
        F.lit(1).alias("m1"), F.lit("Normal").alias("order_class"))
    got = medication_orders(cohort, orders, ["m1"])
    assert "skew=true" in _final_plan(got)
    assert got.count() == 20_000


def test_buckets_are_even_in_every_group(spark):
    """A group whose scores lie in one narrow range fills its buckets as evenly as others."""
    df = spark.range(0, 8_000).select(
        (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 2 == 0, 0.5 + F.col("id") / 1e9).otherwise(F.col("id") / 8_000).alias("s"))
    sizes = add_buckets(df, "s", ["g"], 16).groupBy("g", "_b").count().collect()
    assert len(sizes) == 32
    assert all(200 <= r["count"] <= 300 for r in sizes)
