"""Golden vectors for the covariate encoders (FIXTURES.md 3.2 and 3.5)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from cohortlab.functions import encoders as E
from cohortlab.functions.dates import fill_noted_date


def run(spark, fn, values, dtype):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_bmi(spark):
    ins = [None, float("nan"), 12.0, 15.0, 18.4, 18.9, 19.0, 24.9, 25.0, 29.9, 30.0, 35.0, 39.9, 40.0]
    want = [-1, -1, 1, 0, 0, 0, 1, 1, 2, 2, 3, 4, 4, -1]
    assert run(spark, E.encode_bmi, ins, "double") == want


def test_age(spark):
    assert run(spark, E.encode_age, [24.0, 25.0, 29.9, 30.0, 35.0, 40.0, 44.0, 45.0, None], "double") == \
        [0, 1, 1, 2, 3, 4, 4, -1, -1]


def test_parity_gravidity(spark):
    assert run(spark, E.format_parity, [None, 0, 1, 2, 4, 5, -1], "int") == [0, 0, 0, 1, 1, 2, 0]
    assert run(spark, E.format_gravidity, [None, 1, 2, 5, 6, -1], "int") == [0, 0, 1, 1, 2, 0]


def test_preterm_history(spark):
    df = spark.createDataFrame([(None, 250), (0, 270), (1, 258), (1, 259), (2, 250)], "h int, ga int")
    got = [r[0] for r in df.select(E.format_preterm_history(F.col("h"), F.col("ga"))).collect()]
    assert got == [0, 0, 0, 1, 1]


def test_ruca(spark):
    ins = [None, 1.0, 3.0, 4.0, 7.0, 10.0, 98.0, 99.0, 100.0, float("nan")]
    want = [None, "Metropolitan", "Metropolitan", "Micropolitan", "SmallTown", "Rural", "Rural",
            "NotCoded", None, None]
    assert run(spark, E.categorize_ruca, ins, "double") == want
    assert run(spark, E.encode_ruca, ["Rural", "SmallTown", "Micropolitan", "Metropolitan", "NotCoded", None],
               "string") == [0, 1, 2, 3, -1, -1]


def test_race(spark):
    ins = [None, ["White"], ["Declined"], ["Unable to Determine"], ["Asian"], ["White", "Declined"], []]
    assert run(spark, E.format_race, ins, "array<string>") == \
        ["Unknown", "White or Caucasian", "Unknown", "Unknown", "Asian", "Multiracial", "Unknown"]
    ins2 = [["White", "Declined"], ["Declined"], ["Other"], ["Other", "Asian"], ["Other", "Asian", "White"]]
    assert run(spark, E.handle_multiracial_exceptions, ins2, "array<string>") == \
        ["White or Caucasian", "Multiracial", "Other", "Asian", "Multiracial"]
    got = run(spark, E.consolidate_race_responses, [["White", "White or Caucasian", "Unknown", "Asian"]],
              "array<string>")
    assert got == [["Asian", "White or Caucasian"]]


def test_ethnic_delivery(spark):
    assert run(spark, E.format_ethnic_group, [None, "Samoan", "None", "Hispanic"], "string") == \
        ["Unknown", "Not Hispanic or Latino", "Unknown", "Hispanic"]
    assert run(spark, E.encode_delivery_method,
               ["VBAC, Spontaneous", "C-Section, Classical", None, "other"], "string") == [0, 1, -1, -1]


def test_pval_signal(spark):
    ins = [0.2, 0.1, 0.05, 0.01, 0.001, 0.0001, float("nan"), None]
    assert run(spark, E.pval_signal, ins, "double") == ["ns", "+", "*", "**", "***", "****", "****", None]


def test_sentinel(spark):
    got = run(spark, E.clean_sentinel, [-999.0, 0.5, None, 0.0], "double")
    assert got[0] is None and math.isclose(got[1], 0.5) and got[2] is None and got[3] == 0.0


def test_noted_date_fill(spark):
    d = dt.date
    rows = [(d(2020, 1, 1), None, d(2020, 3, 1), d(2020, 1, 1)),
            (None, None, d(2020, 1, 5), d(2020, 1, 5)),
            (None, d(2020, 2, 1), d(2020, 1, 5), d(2020, 1, 5)),
            (None, d(2020, 1, 5), d(2020, 1, 5), d(2020, 1, 5)),
            (None, d(2020, 1, 1), d(2020, 1, 5), None),
            (None, d(2020, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "n date, r date, c date, want date")
    for r in df.select("want", fill_noted_date(F.col("n"), F.col("r"), F.col("c")).alias("got")).collect():
        assert r.got == r.want
