"""Tasks hold as many rows at any size of the tables."""

import time

from pyspark.sql import functions as F

from cohortlab import session
from cohortlab.session import cut_lineage, fit_tasks

NAMES = [*session.TASK_BYTES, session.INITIAL, "spark.sql.shuffle.partitions"]


def test_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    old = {n: spark.conf.get(n, None) for n in NAMES}
    try:
        for n in NAMES[:3]:
            spark.conf.unset(n)
        spark.range(200_000).select(F.rand(1).alias("x")).write.parquet(str(tmp_path / "a.parquet"))
        fit_tasks(spark, str(tmp_path))
        for n, (_, value) in session.TASK_BYTES.items():
            assert spark.conf.get(n) == value
        assert spark.conf.get(session.INITIAL, None) is None  # a small folder keeps the session's number
        monkeypatch.setattr(session, "PARTITION_BYTES", 100_000)
        fit_tasks(spark, str(tmp_path))
        assert 12 <= int(spark.conf.get(session.INITIAL)) <= 20
        spark.conf.set(NAMES[0], "1m")
        spark.conf.set(session.INITIAL, "77")  # the caller's own settings stay
        fit_tasks(spark, str(tmp_path))
        assert spark.conf.get(NAMES[0]) == "1m" and spark.conf.get(session.INITIAL) == "77"
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
        session._INITIAL_SET.clear()


def test_a_scan_counts_as_its_rows(spark, tmp_path):
    """Two million keys in a file of a few MB are no table to broadcast; few rows still are."""
    name = session.SCAN_FACTOR[0]
    old = {n: spark.conf.get(n, None) for n in [*NAMES, name, "spark.sql.autoBroadcastJoinThreshold"]}
    try:
        for n in (name, "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(n)
        ids = spark.range(2_000_000, numPartitions=1)
        ids.select((F.col("id") % 30_000).alias("k")).write.parquet(str(tmp_path / "many.parquet"))
        spark.range(1000).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "few.parquet"))
        fit_tasks(spark, str(tmp_path))
        many, few = (spark.read.parquet(str(tmp_path / f"{x}.parquet")) for x in ("many", "few"))
        assert sum(f.stat().st_size for f in (tmp_path / "many.parquet").glob("*.parquet")) < 10 << 20
        plan = lambda right: ids.withColumnRenamed("id", "k").join(right, "k", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan(many) and "BroadcastHashJoin" in plan(few)
        spark.conf.set(name, "3.0")  # the caller's own setting stays
        fit_tasks(spark, str(tmp_path))
        assert spark.conf.get(name) == "3.0"
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
        session._INITIAL_SET.clear()


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_a_stage_table_leaves_no_shuffle_files(spark):
    """What a stage table was dealt by goes when it is written, and the session's setting stays."""
    before, old = _shuffle_files(spark), spark.conf.get(session.FREE, None)
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    kept = cut_lineage(df)
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and spark.conf.get(session.FREE, None) == old
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) and kept.count() == 10
