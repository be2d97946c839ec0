"""Covariate frame for propensity models.

The study collected each arm to the driver twice, encoded it row by row in
pandas, imputed medians, and glued the encoded columns back to the untouched
ones by row position. Here the whole frame is one projection of column
expressions over the arm, the key stays on every row, and the per-arm
medians are one grouped aggregate joined back (one row per arm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import encoders as E

RACE_INDICATORS = [("race_white", V.RACE_WHITE), ("race_asian", V.RACE_ASIAN),
                   ("race_black", V.RACE_BLACK), ("race_other", V.RACE_OTHER)]


def distinct_years(df: DataFrame, col: str = "delivery_year") -> list[int]:
    """Years present in the data: bounded by the calendar span of the study."""
    return sorted(int(r[0]) for r in df.select(col).distinct().collect() if r[0] is not None)


def year_one_hot(years: list[int], col: str = "delivery_year") -> dict:
    """``year_<y>`` 0/1 for every year of the union of arms (the study
    derived them per arm, so arms could disagree)."""
    return {f"year_{y}": F.when(F.col(col) == y, 1).otherwise(0) for y in years}


def missingness(df: DataFrame, cols: list[str], group: list[str] | None = None) -> DataFrame:
    """Percent non-missing per column, one decimal (NaN counts as missing)."""
    g = group or []
    aggs = []
    for c in cols:
        present = F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c)), 0).otherwise(1))
        aggs.append(F.round(F.try_divide(100.0 * present, F.count(F.lit(1))), 1).alias(f"pct_{c}"))
    return df.groupBy(*g).agg(*aggs)


#: Relative rank error of the sketch that brackets a median.
MEDIAN_ACCURACY = 10_000


def exact_medians(df: DataFrame, cols: list[str], group: list[str]) -> DataFrame:
    """One row per group with the exact median of each column as ``_med_<column>``
    (NULL where a column has no values).

    A mergeable sketch gives two values around the middle, whose ranks are off by at
    most one part in ``MEDIAN_ACCURACY``. The rows below them are only counted, and the
    values between them (0.06% of the rows at most, plus repeats) are counted per value and
    ranked. No task holds all distinct values of a column."""
    d = 2.0 / MEDIAN_ACCURACY
    lo, hi = {}, {}
    for c in cols:
        q = F.percentile_approx(c, [0.5 - d, 0.5 + d], MEDIAN_ACCURACY)
        lo[c], hi[c] = q[0].alias(f"_lo_{c}"), q[1].alias(f"_hi_{c}")
    bracket = df.groupBy(*group).agg(*lo.values(), *hi.values())
    # one row per group (arms or comparisons)
    v = df.select(*group, *cols).join(F.broadcast(bracket), group, "inner")
    long = v.select(*group, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v"), F.col(f"_lo_{c}").alias("_lo"),
                 F.col(f"_hi_{c}").alias("_hi")) for c in cols])))
    # below the bracket: one key per column; inside: one key per value; above: one key
    place = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    counts = long.filter(F.col("_v").isNotNull()) \
        .select(*group, "_c", place.alias("_p"), F.when(place == 0, F.col("_v")).alias("_v")) \
        .groupBy(*group, "_c", "_p", "_v").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group, "_c")
    upto = F.sum("_n").over(w.orderBy("_p", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.select(*group, "_c", "_v", "_n", upto.alias("_to"), F.sum("_n").over(w).alias("_total"))

    def at(rank):
        return F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col("_n") < rank), F.col("_v")))

    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    med = ranked.groupBy(*group, "_c").agg(((at(low) + at(high)) / 2).alias("_m"))
    wide = med.groupBy(*group).agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(f"_med_{c}") for c in cols])
    # a group without any value has no counts: keep it, with NULL medians
    return bracket.select(*group).join(wide, group, "left")


def median_impute(df: DataFrame, cols: list[str], group: list[str] | None = None) -> DataFrame:
    """Fill NULL (and NaN) with the exact median of the column
    within ``group`` (the whole frame when no group). A column with no values
    stays NULL."""
    g = group or []
    df = df.withColumns({c: F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)).cast("double") for c in cols})
    if not g:
        df, g = df.withColumn("_all", F.lit(0)), ["_all"]
    # one row per group (arms or comparisons), bounded
    j = df.join(F.broadcast(exact_medians(df.select(*g, *cols), cols, g)), g, "inner").drop("_all")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}) \
            .drop(*[f"_med_{c}" for c in cols])


def covariate_names(select_columns: list[str], years: list[int]) -> list[str]:
    dropped = set(V.FEATURE_DROPPED) | {"delivery_year"}
    base = [c for c in select_columns if c not in dropped]
    return base + [f"year_{y}" for y in years] + [n for n, _ in RACE_INDICATORS] + \
        ["commercial_insurance"]


def psm_features(df: DataFrame, select_columns: list[str], years: list[int], key: list[str],
                 arm: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """encode ``select_columns`` of each row into numeric covariates.

    Returns (frame with ``key`` + ``arm`` + covariates, covariate names).
    SVI medians are taken per arm, as the study did (it ran per frame)."""
    arm = arm or []
    # The formatted race feeds four indicators: computed once in its own
    # projection (Spark does not inline a non-trivial expression into several
    # uses), which also keeps the generated code of the wide projection small.
    df = df.withColumn("_race_fmt", E.format_race(F.col("race")))
    race = F.col("_race_fmt")
    enc = {
        "pregravid_bmi": E.encode_bmi(F.col("pregravid_bmi")),
        "age_at_start_dt": E.encode_age(F.col("age_at_start_dt")),
        "ethnic_group": E.encode_ethnic_group(F.col("ethnic_group")),
        "ob_hx_infant_sex": E.encode_fetal_sex(F.col("ob_hx_infant_sex")),
        "Parity": E.format_parity(F.col("Parity")),
        "Gravidity": E.format_gravidity(F.col("Gravidity")),
        "Preterm_history": E.format_preterm_history(F.col("Preterm_history"),
                                                    F.col("gestational_days")),
        "ruca_categorization": E.encode_ruca(F.col("ruca_categorization")),
    }
    cols = []
    for c in select_columns:
        if c in V.FEATURE_DROPPED or c == "delivery_year":
            continue
        cols.append(enc[c].alias(c) if c in enc else F.col(c))
    cols += [v.alias(k) for k, v in year_one_hot(years).items()]
    cols += [E.race_indicator(race, label).alias(name) for name, label in RACE_INDICATORS]
    cols.append(E.encode_commercial_insurance(F.col("insurance")).alias("commercial_insurance"))
    out = df.select(*key, *arm, *cols)
    svi = [c for c in V.SVI_IMPUTED if c in select_columns]
    if svi:
        out = median_impute(out, svi, arm)
    names = covariate_names(select_columns, years)
    # any remaining NULL -> -1
    out = out.fillna(-1, subset=[c for c in names if c not in svi]).fillna(-1.0, subset=svi)
    return out.select(*key, *arm, *names), names
