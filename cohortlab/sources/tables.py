"""Sources and sinks.

Tables are read lazily as parquet, so column pruning and filter pushdown reach
the scan. The sink writes a whole table in one overwrite; the format is a
parameter (the study wrote Delta tables, which this image does not ship).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

def table_name(base: str, *parts: str, schema: str | None = None) -> str:
    """S3: the name of a catalog table from its base and the version, disease or date it
    is for: ``table_name("matched", "v2", "asthma", schema="study")`` is
    ``study.matched_v2_asthma``. Characters that names cannot hold become ``_``."""
    name = "_".join(re.sub(r"\W", "_", p) for p in (base, *parts) if p)
    return f"{schema}.{name}" if schema else name


class Tables:
    """Lazy parquet reader for the tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Drop-and-replace sink. ``mode('overwrite')`` replaces the whole
    table in one job, which is what DROP TABLE + saveAsTable did."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_table(df: DataFrame, name: str, fmt: str = "parquet", partition_by=None) -> None:
    """Drop-and-replace sink for a managed catalog table."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def read_table(spark: SparkSession, name: str, *columns: str, distinct: bool = False) -> DataFrame:
    """A catalog table by name, whole or ``columns`` only, optionally distinct."""
    df = spark.table(name)
    df = df.select(*columns) if columns else df
    return df.distinct() if distinct else df


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Temp view registration, for callers who prefer SQL."""
    df.createOrReplaceTempView(name)
    return df
