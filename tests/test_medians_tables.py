"""Exact medians against NumPy, and catalog tables by name."""

import random

import numpy as np

from cohortlab.operators.features import median_impute
from cohortlab.sources.tables import read_table, save_table, table_name


def test_medians_match_numpy(spark):
    rnd = random.Random(17)
    rows, want = [], {}
    for g, n in enumerate([1, 2, 3, 4, 7, 10, 101, 500, 30_000]):
        for c in range(2):
            vals = [float(rnd.randint(0, 3)) if c else rnd.random() for _ in range(n)]
            want[g, c] = (vals, float(np.median(vals)))
        rows += [(g, i, *(want[g, c][0][i] for c in range(2))) for i in range(n)]
        rows += [(g, -1, None, float("nan"))] * 3
    rows.append((99, -1, None, None))  # a group without values keeps its NULLs
    df = spark.createDataFrame(rows, "g int, i int, a double, b double")
    filled = median_impute(df, ["a", "b"], ["g"])
    assert filled.count() == len(rows)
    got = {r.g: (r.a, r.b) for r in filled.filter("i = -1").collect()}
    assert got.pop(99) == (None, None)
    assert got == {g: (want[g, 0][1], want[g, 1][1]) for g in got} and len(got) == 9


def test_median_of_the_whole_frame(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 8), (4, 5), (5, 9)], "i int, v int")
    assert {r.i: r.v for r in median_impute(df, ["v"]).collect()}[2] == 6.5
    assert median_impute(df.filter("i > 9"), ["v"]).collect() == []


def test_catalog_tables_by_name(spark, tmp_path):
    name = table_name("matched", "v2", "crohn's disease", schema="cohort_t")
    assert name == "cohort_t.matched_v2_crohn_s_disease"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS cohort_t LOCATION '{tmp_path}'")
    try:
        save_table(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), name)
        assert read_table(spark, name).count() == 3
        assert sorted(map(tuple, read_table(spark, name, "k", distinct=True).collect())) == [(1,), (2,)]
        save_table(spark.createDataFrame([(7,)], "n int"), name)  # replaced, columns too
        assert [tuple(r) for r in read_table(spark, name).collect()] == [(7,)]
    finally:
        spark.sql("DROP DATABASE cohort_t CASCADE")
