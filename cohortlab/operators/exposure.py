"""Medication exposure.

The study collected the order rows to the driver to find each order's class
(``idxmax``), uploaded them again, grouped twice and built 160 columns one
``withColumn`` at a time. Here: one overlap join, column expressions, and one
grouped aggregate; per-order rows never leave the executors.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import exposure as X
from ..vocab import HISTORICAL_ORDER_CLASS, ORDER_ADMIN_COLUMNS

PREGNANCY_KEY = ["pat_id", "instance", "lmp", "gestational_days"]
COHORT_COLUMNS = ["pat_id", "instance", "gestational_days", "lmp", "ob_delivery_delivery_date"]
STATUSES = ["exposure_total_status", "exposure0_status", "exposure1_status",
            "exposure2_status", "exposure3_status"]
DURATIONS = ["exposure_total_duration", "exposure1_duration", "exposure2_duration",
             "exposure3_duration"]


def any_flag(cols: list[str]) -> Column:
    """P5: ``c1 == 1 OR c2 == 1 ...``; NULL flags do not select."""
    return reduce(lambda a, b: a | b, [F.col(c) == 1 for c in cols])


def medication_overlap_join(cohort: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of the same patient that overlap the pregnancy,
    ``end_date > lmp AND start_date < delivery`` (strict; NULL dates drop)."""
    c = cohort.select(*COHORT_COLUMNS)
    j = c.join(orders, ["pat_id", "instance"], "inner")
    return j.filter((F.col("end_date") > F.col("lmp")) &
                    (F.col("start_date") < F.col("ob_delivery_delivery_date")))


def medication_orders(cohort: DataFrame, orders: DataFrame, meds: list[str],
                      routes: list[str] | None = None) -> DataFrame:
    """Overlapping orders in any listed class, not historical, admin
    columns dropped, distinct; optionally restricted to ``routes``."""
    o = orders.filter(any_flag(meds) & (F.col("order_class") != HISTORICAL_ORDER_CLASS))
    if routes is not None:
        o = o.filter(F.col("route").isin(routes))
    j = medication_overlap_join(cohort, o)
    j = j.drop(*[c for c in ORDER_ADMIN_COLUMNS if c in j.columns])
    return j.distinct()


def cast_flags(df: DataFrame, meds: list[str]) -> DataFrame:
    """Medication flags as int, in one projection."""
    return df.withColumns({m: F.col(m).cast("int") for m in meds})


def med_argmax(meds: list[str]) -> Column:
    """M2: the first class in list order whose flag is 1 (an order in two
    classes is credited to the first only)."""
    return F.coalesce(*[F.when(F.col(m) == 1, F.lit(m)) for m in meds])


def medinfo(df: DataFrame, mode: str = "reference") -> DataFrame:
    """M3: offsets from LMP, order length, start period, four period
    durations, their total (d1+d2+d3) and five 0/1 statuses."""
    s, e, ga = F.col("orderstart_lmp"), F.col("orderend_lmp"), F.col("gestational_days")
    df = df.withColumns({
        "orderstart_lmp": F.datediff("start_date", "lmp"),
        "orderend_lmp": F.datediff("end_date", "lmp"),
        "order_duration": F.datediff("end_date", "start_date") + 1,
    })
    df = df.withColumns({
        "orderstart_lmp_period": X.exposure_period(s),
        "exposure0_duration": X.exposure0_duration(s, e, mode),
        "exposure1_duration": X.exposure1_duration(s, e, mode),
        "exposure2_duration": X.exposure2_duration(s, e, mode),
        "exposure3_duration": X.exposure3_duration(s, e, ga, mode),
    })
    df = df.withColumn("exposure_total_duration", F.col("exposure1_duration") +
                       F.col("exposure2_duration") + F.col("exposure3_duration"))
    return df.withColumns({
        "exposure1_status": X.status(F.col("exposure1_duration")),
        "exposure2_status": X.status(F.col("exposure2_duration")),
        "exposure3_status": X.status(F.col("exposure3_duration")),
        "exposure_total_status": X.status(F.col("exposure_total_duration")),
        "exposure0_status": X.status(F.col("exposure0_duration")),
    })


def exposure_rows(cohort: DataFrame, orders: DataFrame, meds: list[str],
                  routes: list[str] | None = None, mode: str = "reference") -> DataFrame:
    """M1 -> P12 -> M3 -> M2: one row per distinct overlapping order, with its
    durations, statuses and credited class ``med_name``."""
    m = cast_flags(medication_orders(cohort, orders, meds, routes), meds)
    return medinfo(m, mode).withColumn("med_name", med_argmax(meds))


def aggregate_data(df: DataFrame, partition_columns: list[str], aggregation_columns: dict) -> DataFrame:
    """A1: group by ``partition_columns``; each ``{column: function}`` entry
    becomes ``<column>_<function>``."""
    aggs = [getattr(F, fn)(F.col(c)).alias(f"{c}_{fn}") for c, fn in aggregation_columns.items()]
    return df.groupBy(*partition_columns).agg(*aggs)


EXPOSURE_AGGS = {**{d: "sum" for d in DURATIONS}, **{s: "max" for s in STATUSES}}


def exposure_agg(rows: DataFrame) -> DataFrame:
    """M9: per pregnancy and class, summed durations and maximal statuses."""
    return aggregate_data(rows, PREGNANCY_KEY + ["med_name"], EXPOSURE_AGGS)


def exposure_pivot(rows: DataFrame, meds: list[str]) -> DataFrame:
    """One row per pregnancy, ``<med>_<status>`` = 1 if any order
    credited to that class has the status.

    The study's class-level max followed by a pregnancy-level max equals a single max per
    (pregnancy, class). The statuses are 0 or 1, so a class's are a few bits in a word, a
    grouped ``bit_or`` a word unites a pregnancy's orders, and bits become columns at the end.
    """
    width = len(STATUSES)
    names = bits.word_names(len(meds), width)
    own = reduce(add, [F.when(F.col(s) == 1, F.lit(1 << k)).otherwise(0) for k, s in enumerate(STATUSES)])
    masks = bits.words(F.element_at(bits.places(meds), F.col("med_name")), own, len(meds), width)
    p = rows.groupBy(*PREGNANCY_KEY).agg(*[F.bit_or(m).alias(w) for m, w in zip(masks, names)])
    return p.select(*PREGNANCY_KEY, *[
        F.coalesce(bits.flag(names, i, width, k), F.lit(0)).alias(f"{m}_{s}")
        for i, m in enumerate(meds) for k, s in enumerate(STATUSES)])


def cohort_with_exposure(cohort: DataFrame, pivot: DataFrame, meds: list[str]) -> DataFrame:
    """Cohort LEFT JOIN exposure flags; pregnancies without orders get 0."""
    cols = [f"{m}_{s}" for m in meds for s in STATUSES]
    return cohort.join(pivot, PREGNANCY_KEY, "left").fillna(0, subset=cols)
