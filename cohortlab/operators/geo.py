"""Area-level geography.

A patient's address is joined to a geography table on a key cut from the
census block group (or ZIP), and the result is LEFT-joined to the cohort so
every cohort row is kept. Geography tables are bounded by the number of
census areas (about 85k tracts, 3.2k counties, 42k ZIPs in the US); Spark
broadcasts them where their measured bytes are under its limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import GEO_TABLES

BG = "PATIENT_ADDR_CENSUS_BLOCKGROUP_DERIVED"
STATE = "PATIENT_STATE_CD"


def _bg_cut(start: int, length_expr: str) -> F.Column:
    # Spark treats substring start 0 as 1; write 1 explicitly.
    return F.expr(f"substring({BG}, {start}, {length_expr})")


def geo_key(geo_name: str) -> tuple[str, F.Column, callable]:
    """(key column name, patient-side key expression, geo-side key transform)."""
    is_ca = F.col(STATE) == "CA"
    if geo_name == "ruca2010revised":
        # tract: CA drops the leading 0 and the last digit, others the last digit only
        pk = F.when(is_ca, _bg_cut(2, f"length({BG}) - 2")).otherwise(_bg_cut(1, f"length({BG}) - 1"))
        return "FIPS", pk, lambda g: g.withColumn(
            "FIPS", F.col("State_County_Tract_FIPS_Code").cast("string")
        ).drop("State_County_Tract_FIPS_Code")
    if geo_name == "svi2018_us":
        return "FIPS", _bg_cut(1, f"length({BG}) - 1"), lambda g: g
    if geo_name in ("countytypologycodes2015", "urbaninfluencecodes2013"):
        pk = F.when(is_ca, _bg_cut(2, "4")).otherwise(_bg_cut(1, "5"))
        return "FIPS4", pk, lambda g: g.withColumn("FIPS4", F.col("FIPStxt").cast("string")).drop("FIPStxt")
    if geo_name in ("svi2018_us_county", "ruralurbancontinuumcodes2013"):
        return "FIPS5", _bg_cut(1, "5"), lambda g: g.withColumn("FIPS5", F.col("FIPS").cast("string"))
    if geo_name == "farcodeszip2010":
        return "ZIP5", F.expr("substring(ZIP, 1, 5)"), \
            lambda g: g.withColumn("ZIP5", F.col("ZIP").cast("string")).drop("ZIP")
    raise ValueError(f"unknown geography table {geo_name!r}; expected one of {GEO_TABLES}")


def patient_geo(patients: DataFrame, geo: DataFrame, geo_name: str) -> DataFrame:
    """Patients INNER JOIN the geography table on the derived key."""
    key, pk, gt = geo_key(geo_name)
    p = patients.select("pat_id", "instance", STATE, BG, "ZIP")
    if geo_name == "farcodeszip2010":
        p = p.withColumn(key, pk).drop("ZIP")
    else:
        p = p.withColumn(key, pk)
    return p.join(gt(geo), key, "inner")


def add_geo_features(cohort: DataFrame, patients: DataFrame, geo: DataFrame, geo_name: str,
                     join_cols: list[str] | None = None) -> DataFrame:
    """Cohort LEFT JOIN (patients JOIN geography) on ``join_cols``."""
    join_cols = join_cols or ["pat_id", "instance"]
    if geo_name not in GEO_TABLES:
        raise ValueError(f"unknown geography table {geo_name!r}; expected one of {GEO_TABLES}")
    return cohort.join(patient_geo(patients, geo, geo_name), join_cols, "left")


def add_all_geo(cohort: DataFrame, patients: DataFrame, geos: dict[str, tuple[DataFrame, list[str]]],
                join_cols: list[str] | None = None) -> DataFrame:
    """G6 for several geography tables, ``geos``: name -> (table, columns wanted). Each patient
    row is given the columns of all tables first, so patients move to the cohort once, whatever
    the number of tables. Where ``join_cols`` name one patient row, the rows are those of
    ``add_geo_features`` table by table; a patient with several rows gives one row for each,
    not each combination of them."""
    join_cols = join_cols or ["pat_id", "instance"]
    p, wanted = patients.select(*join_cols, STATE, BG, "ZIP"), []
    for i, (name, (geo, columns)) in enumerate(geos.items()):
        if name not in GEO_TABLES:
            raise ValueError(f"unknown geography table {name!r}; expected one of {GEO_TABLES}")
        key, pk, gt = geo_key(name)
        g = gt(geo).select(F.col(key).alias(f"_geo{i}"), *columns)
        p = p.join(g, pk == F.col(f"_geo{i}"), "left").drop(f"_geo{i}")
        wanted += columns
    return cohort.join(p.select(*join_cols, *wanted), join_cols, "left")
