"""The flag chain moves its rows as few times as it can, with the same rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cohortlab.functions import bits
from cohortlab.operators import conditions
from cohortlab.operators import diagnoses as D
from cohortlab.operators.skew import full_outer_join

PL = "pat_id long, dx_id long, instance int, RESOLVED_DATE date, NOTED_DATE date"
ENC = "pat_id long, instance int, dx_id long, PAT_ENC_CSN_ID long, DIAGNOSISNAME string"


def _sources(spark):
    rnd = random.Random(4)
    day = lambda: rnd.choice([None, dt.date(2020, 1, rnd.randint(1, 5))])
    key = lambda: rnd.choice([None, 1, 2, 3])
    pl = {(key(), key(), rnd.choice([None, 1000]), day(), day()) for _ in range(300)}
    enc = [(key(), rnd.choice([None, 1000]), key(), rnd.choice([None, 1, 2]), rnd.choice([None, "a", "b"])) for _ in range(300)]
    return spark.createDataFrame(sorted(pl, key=repr), PL), spark.createDataFrame(enc, ENC)


def test_full_outer_is_distinct_without_a_shuffle_of_its_own(spark):
    pl, enc = _sources(spark)
    got = D.diagnosis_full_outer(pl, enc)
    want = pl.join(enc, D.KEY, "full_outer").select(got.columns).distinct()
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(map(tuple, want.collect()), key=repr) and len(rows) == len(set(rows))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, x in enumerate(plan) if "FullOuter" in x)
    assert not any("Aggregate" in x for x in plan[:top])


def test_history_equals_stage_by_stage(spark):
    pl, enc = _sources(spark)
    visits = spark.createDataFrame([(p, 1000, c, dt.date(2020, 2, 1 + p % 2)) for p in (1, 2, 3) for c in (1, 2)],
                                   "pat_id long, instance int, PAT_ENC_CSN_ID long, CONTACT_DATE date")
    mapping = spark.createDataFrame([(v, 1000, n, f"SNOMED#{v}") for v in (1, 2, 3) for n in ("a", "c")],
                                    "value long, instance int, name string, concept string")
    raw = pl.withColumn("DATE_OF_ENTRY", F.lit(None).cast("date"))
    got = D.diagnosis_history(raw, enc, visits, mapping)
    d = D.diagnosis_contact_date(D.diagnosis_full_outer(D.problemlist_clean(raw), enc), visits)
    want = D.diag_snomed(D.diagnosis_first_contact(D.diagnosis_full_name(D.diagnosis_concept_map(d, mapping))))
    assert got.count() and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_visits_are_dated_before_the_merge(spark):
    """Of the rows of the full outer join none moves for the encounters' dates."""
    pl, enc = _sources(spark)
    visits = spark.createDataFrame([(1, 1000, 1, dt.date(2020, 2, 1))], "pat_id long, instance int, PAT_ENC_CSN_ID long, CONTACT_DATE date")
    mapping = spark.createDataFrame([(1, 1000, "a", "SNOMED#1")], "value long, instance int, name string, concept string")
    got = D.diagnosis_history(pl.withColumn("DATE_OF_ENTRY", F.lit(None).cast("date")), enc, visits, mapping)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" in plan and "PAT_ENC_CSN_ID" not in plan


def test_mapped_concepts_give_the_mapped_diagnoses(spark):
    """J6 on the concept mapping keeps the diagnoses that J6 keeps of the whole history."""
    pl, enc = _sources(spark)
    raw = pl.withColumn("DATE_OF_ENTRY", F.lit(None).cast("date"))
    visits = spark.createDataFrame([(p, 1000, c, dt.date(2020, 2, 1 + p % 2)) for p in (1, 2, 3) for c in (1, 2)],
                                   "pat_id long, instance int, PAT_ENC_CSN_ID long, CONTACT_DATE date")
    mapping = spark.createDataFrame([(v, i, n, f"SNOMED#{v}" if n != "c" else f"ICD-10#{v}") for v in (1, 2, 3, None) for i in (1000, None)
                                     for n in ("a", "c", "e")] + [(3, 1000, "d", None)], "value long, instance int, name string, concept string")
    dxmap, dx = (spark.createDataFrame([(v,) for v in ids], "dx_id long") for ids in ([1, 2, 2, None], [2, 3, 1, 1]))
    got = D.diagnosis_history(raw, enc, visits, conditions.mapped_concepts(mapping, dxmap, dx))
    want = conditions.diagnosis_mapped_semi(D.diagnosis_history(raw, enc, visits, mapping), dxmap, dx).select(got.columns)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows and rows == sorted(map(tuple, want.collect()), key=repr) and {r[1] for r in rows} == {1, 2}


def test_flags_move_no_diagnosis_for_the_dictionaries(spark):
    """The diagnoses' dictionary tables meet the concept mapping, not the diagnoses."""
    from cohortlab.plans.study import Study
    plan = Study(spark, "/root/testdata/sf0.001").intervals()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, x in enumerate(plan) if "min(struct(CONTACT_DATE" in x)
    assert not any("LeftSemi" in x for x in plan[:top]) and any("LeftSemi" in x for x in plan[top:])


def test_cohort_rows_move_once(spark):
    """Flags join the cohort, equal rows and missing dates included, in one shuffle of its rows."""
    day = lambda n: None if n is None else dt.date(2020, 1, n)
    keys = [(1, 1000, day(3)), (1, 1000, day(9)), (2, 1000, day(None)), (3, 1000, day(5)), (3, None, day(5)), (None, 1000, day(5))]
    rows = [(*k, note) for k in keys for note in ("a", "a", "b", None, None)]
    cohort = spark.createDataFrame(rows, "pat_id long, instance int, decided_index_date date, note string").repartition(7)
    none = None
    diag = [(1, 7, 1000, day(2), day(4), "7"), (1, 8, 1000, day(8), none, "8"), (2, 7, 1000, none, none, "7"), (3, 8, 1000, day(6), none, "8")]
    d = spark.createDataFrame(diag, "pat_id long, dx_id long, instance int, noted_date date, resolved_date date, SNOMED_ids string")
    codes = spark.createDataFrame([("f1", "7"), ("f2", "8")], "risk_factor string, code string")
    ids = spark.createDataFrame([(7,), (8,)], "dx_id long")
    got = conditions.add_risk_words(cohort, ["f1", "f2"], d, codes, ids, ids)
    want = {(1, day(3)): 1, (1, day(9)): 2, (2, None): 1}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        {(*r, want.get((r[0], r[2]), 0) if r[1] else 0) for r in rows}, key=repr)
    assert conditions.add_risk_words(cohort, ["f1", "f2"], d, codes, ids, ids, dedup_rows=False).count() == len(rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = conditions.add_risk_words(cohort, ["f1", "f2"], d, codes, ids, ids)._jdf.queryExecution().executedPlan()
        shuffles = [x for x in plan.toString().splitlines() if "Exchange" in x and "ENSURE_REQUIREMENTS" in x]
        assert not any("note#" in x for x in shuffles)  # none by whole rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_key_is_counted_where_no_slot_is_hot(spark, monkeypatch):
    """Keys are counted only in slots that hold a hot key's number of rows."""
    from cohortlab.operators import skew
    kept = []
    cut = skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    left = spark.range(5000).select(F.col("id").alias("k"), F.col("id").alias("a"))
    right = spark.range(5000).select((F.col("id") + 100).alias("k"), F.col("id").alias("b"))
    assert full_outer_join(left, right, ["k"], split_rows=500).count() == 5100
    assert [df.columns for df in kept[1:]] == [["__slot__"], ["k", "__parts__", "__deal_left__", "__both__"]]
    assert kept[1].count() == 0 and kept[2].count() == 0


def test_flags_pack_into_words(spark):
    rnd = random.Random(9)
    names = [f"f{i}" for i in range(73)]
    rows = [tuple(rnd.randrange(2) for _ in names) for _ in range(50)] + [(1,) * 73, (0,) * 73]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    packed = df.select(*bits.pack(names))
    assert packed.columns == bits.word_names(73) and len(packed.columns) == 2
    assert sorted(map(tuple, packed.select(*bits.unpack(names)).collect())) == sorted(rows)


def test_stage_tables_hold_words(spark):
    """A stage table of the cohort has a column a word, not one a condition, and the intervals
    are united by hashed aggregates."""
    from cohortlab.plans.study import Study
    s = Study(spark, "/root/testdata/sf0.001")
    for df in (s.flagged_cohort, s.study_cohort):
        file = df.inputFiles()[0]
        assert set(s.FACTORS) <= set(df.columns) and not set(s.FACTORS) & set(spark.read.parquet(file).columns)
        assert {r[0] for r in df.select(F.explode(F.array(*s.FACTORS))).distinct().collect()} == {0, 1}
    rows = spark.range(5).selectExpr("id AS pat_id", "1000 AS instance", "1S AS risk_factor", "date'2020-01-01' + cast(id AS int) AS noted_date",
                                     "cast(NULL AS date) AS resolved_date")
    assert "SortAggregate" not in conditions.interval_union(rows)._jdf.queryExecution().executedPlan().toString()
