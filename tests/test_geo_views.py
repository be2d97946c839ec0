"""All geography on the patient row at once, against table by table; temp views."""

from collections import Counter

from pyspark.sql import functions as F

from cohortlab.operators.geo import add_all_geo, add_geo_features
from cohortlab.plans.study import Study
from cohortlab.sources.tables import register_view
from cohortlab.vocab import RUCA_COLUMN, SVI_COLUMNS

SF = "/root/testdata/sf0.001"


def test_all_geography_at_once(spark):
    s = Study.shared(spark, SF)
    patients = s.src("patient")
    cohort = patients.select("pat_id", "instance").withColumn("row", F.explode(F.array(F.lit(1), F.lit(2)))) \
        .unionByName(spark.createDataFrame([(-5, 1000, 1)], "pat_id long, instance int, row int"))  # not a patient
    assert patients.groupBy("pat_id", "instance").count().filter("count > 1").isEmpty()
    svi, ruca = s.src("svi2018_us"), s.src("ruca2010revised")
    cols = ["pat_id", "instance", "row", *SVI_COLUMNS, RUCA_COLUMN]
    want = add_geo_features(cohort, patients, svi, "svi2018_us").select(*cols[:3], *SVI_COLUMNS)
    want = add_geo_features(want, patients, ruca, "ruca2010revised").select(*cols)
    got = add_all_geo(cohort, patients, {"svi2018_us": (svi, SVI_COLUMNS), "ruca2010revised": (ruca, [RUCA_COLUMN])}).select(*cols)
    rows = got.collect()
    assert Counter(map(repr, rows)) == Counter(map(repr, want.collect()))
    assert any(r[RUCA_COLUMN] is not None for r in rows) and any(r[RUCA_COLUMN] is None for r in rows)


def test_temp_view(spark):
    df = spark.range(5).withColumn("sq", F.col("id") * F.col("id"))
    assert register_view(df, "squares_view") is df
    assert spark.sql("select sum(sq) from squares_view").first()[0] == 30
    register_view(df.filter("id < 2"), "squares_view")  # the later one replaces it
    assert spark.table("squares_view").count() == 2
    spark.catalog.dropTempView("squares_view")
