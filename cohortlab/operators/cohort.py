"""Cohort selection and arm construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATIENT = ["pat_id", "instance"]
EPISODE = ["pat_id", "instance", "episode_id"]
PREGNANCY_DEDUP_KEY = ["pat_id", "instance", "lmp", "gestational_days", "ob_hx_infant_sex"]


def any_flag(df: DataFrame, flags: list[str]) -> DataFrame:
    """P5: rows where any flag equals 1 (NULL flags do not select)."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) == 1 for c in flags]))


def filter_delivery_year(df: DataFrame, min_year_exclusive: int) -> DataFrame:
    """``delivery_year > min_year_exclusive``."""
    return df.filter(F.col("delivery_year") > min_year_exclusive)


def split_arms(df: DataFrame, flags: list[str]) -> tuple[DataFrame, DataFrame]:
    """Treated = rows with any flag; controls = rows of patients with no
    treated row at all (J1: patient-level LEFT ANTI join, so every pregnancy of
    a patient with any treated pregnancy is excluded)."""
    treated = any_flag(df, flags)
    controls = df.join(treated.select(*PATIENT), PATIENT, "left_anti")
    return treated, controls


def subcohort_by_flag(df: DataFrame, flags: list[str], id_cols: list[str]) -> DataFrame:
    """One long frame of (comparison, ids...) for every row with flag = 1,
    instead of one filtered frame per flag."""
    long = df.select(*id_cols, *[F.col(f).cast("int").alias(f) for f in flags]) \
             .unpivot(id_cols, flags, "comparison", "flag")
    return long.filter(F.col("flag") == 1).drop("flag")


def intersection(lst1: list[str], lst2: list[str]) -> list[str]:
    """Names of ``lst1`` also in ``lst2``, in ``lst1`` order, repeats kept."""
    s2 = set(lst2)
    return [v for v in lst1 if v in s2]


def align_and_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """P3 + union: project both frames on their common columns, then union by name."""
    cols = intersection(a.columns, b.columns)
    return a.select(*cols).unionByName(b.select(*cols))


def arm_union(controls: DataFrame, treated: DataFrame, label: str) -> DataFrame:
    """A12/PS2: label arms 0/1 and union by name; a column missing from one arm
    becomes NULL there. The study's random row shuffle is not needed: the
    matching tie rule makes results independent of row order."""
    return controls.withColumn(label, F.lit(0)).unionByName(
        treated.withColumn(label, F.lit(1)), allowMissingColumns=True)


def cohort_counts(df: DataFrame) -> DataFrame:
    """A2/A3: distinct patients and rows."""
    return df.agg(F.countDistinct("pat_id").alias("n_patients"), F.count(F.lit(1)).alias("n_rows"))


def dedup_pregnancy(df: DataFrame, key: list[str] | None = None, order_by: str = "episode_id") -> DataFrame:
    """A5: one row per pregnancy key. The study kept an arbitrary row; here the
    row with the lowest ``order_by`` is kept, chosen by a hash aggregate of
    ``min(struct)`` so partial aggregation runs before the shuffle."""
    key = key or PREGNANCY_DEDUP_KEY
    rest = [c for c in df.columns if c not in key and c != order_by]
    g = df.groupBy(*key).agg(F.min(F.struct(order_by, *rest)).alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [order_by] + rest]).select(*df.columns)


def match_back(rows: DataFrame, matched_keys: DataFrame, keys: list[str] | None = None,
               extra: list[str] | None = None) -> DataFrame:
    """Rows INNER JOIN matched keys. Matching is with replacement, so a
    key matched k times yields k rows (no DISTINCT). ``extra`` columns of the
    matched keys (e.g. the comparison) are carried along."""
    keys = keys or EPISODE
    return rows.join(matched_keys.select(*keys, *(extra or [])), keys, "inner")
