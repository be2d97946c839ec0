"""Covariate encoders (F1-F11, F16, G7, P13) as column expressions.

The study ran these as Python functions over collected rows, or as
row-at-a-time UDFs; here each one is a CASE expression that stays inside
whole-stage code generation. Branch order and edge cases follow the study;
where the study would raise (a value missing from a lookup dict, an empty
list) the choice made here is stated in the docstring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def format_race(race: Column) -> Column:
    """NULL -> Unknown; more than one answer -> Multiracial; White ->
    'White or Caucasian'; Declined / Patient Refused / Unable to Determine ->
    Unknown; else the single answer. An empty list (the study would raise)
    -> Unknown."""
    first = F.element_at(race, 1)
    return (F.when(race.isNull(), F.lit(V.RACE_UNKNOWN))
             .when(F.size(race) > 1, F.lit(V.RACE_MULTI))
             .when(F.size(race) == 0, F.lit(V.RACE_UNKNOWN))
             .when(first == V.RACE_WHITE_RAW, F.lit(V.RACE_WHITE))
             .when(first.isin(V.RACE_UNKNOWN_SINGLE), F.lit(V.RACE_UNKNOWN))
             .otherwise(first))


def consolidate_race_responses(race: Column) -> Column:
    """White -> 'White or Caucasian', drop non-answers, distinct. Returned
    sorted (the study's set order is arbitrary)."""
    mapped = F.transform(race, lambda x: F.when(x == V.RACE_WHITE_RAW, F.lit(V.RACE_WHITE))
                         .otherwise(x))
    kept = F.filter(mapped, lambda x: x.isNull() | ~x.isin(V.RACE_DROPPED_RESPONSES))
    return F.array_sort(F.array_distinct(kept))


def handle_multiracial_exceptions(race: Column) -> Column:
    """after F2, a single answer is kept; otherwise 'Other' is removed and a
    single remaining answer kept; otherwise Multiracial (so an empty list gives
    Multiracial, as in the study). NULL input (the study would raise) -> Unknown."""
    c = consolidate_race_responses(race)
    no_other = F.array_remove(c, V.RACE_OTHER)
    return (F.when(race.isNull(), F.lit(V.RACE_UNKNOWN))
             .when(F.size(c) == 1, F.element_at(c, 1))
             .when(F.array_contains(c, V.RACE_OTHER) & (F.size(no_other) == 1),
                   F.element_at(no_other, 1))
             .otherwise(F.lit(V.RACE_MULTI)))


def format_ethnic_group(eth: Column) -> Column:
    """F4."""
    return (F.when(eth.isNull(), F.lit("Unknown"))
             .when(eth.isin(V.ETHNIC_NOT_HISPANIC_GROUPS), F.lit(V.ETHNIC_NOT_HISPANIC))
             .when(eth.isin(V.ETHNIC_UNKNOWN_VALUES), F.lit("Unknown"))
             .otherwise(eth))


def format_parity(p: Column) -> Column:
    """NULL, 0, 1 -> 0; 2-4 -> 1; 5+ -> 2; negative -> 0."""
    i = _trunc(p)
    return F.when(p.isNull(), 0).when(i.isin(0, 1), 0).when((i > 1) & (i < 5), 1) \
            .when(i >= 5, 2).otherwise(0)


def format_gravidity(g: Column) -> Column:
    """NULL, 0, 1 -> 0; 2-5 -> 1; 6+ -> 2; negative -> 0."""
    i = _trunc(g)
    return F.when(g.isNull(), 0).when(i.isin(0, 1), 0).when((i > 1) & (i < 6), 1) \
            .when(i >= 6, 2).otherwise(0)


def format_preterm_history(h: Column, gestational_days: Column) -> Column:
    """NULL -> 0; 0, or 1 when the current birth is itself preterm
    (< 259 days) -> 0; else 1."""
    i = _trunc(h)
    return F.when(h.isNull(), 0) \
            .when((i == 0) | ((i == 1) & (gestational_days < V.TERM_DAYS)), 0).otherwise(1)


def encode_delivery_method(m: Column) -> Column:
    """F8: vaginal labels -> 0, C-section labels -> 1, else -1."""
    return F.when(m.isin(V.DELIVERY_VAGINAL), 0).when(m.isin(V.DELIVERY_CSECTION), 1).otherwise(-1)


def encode_bmi(bmi: Column) -> Column:
    """NULL/NaN -> -1; truncated to an integer first, then 15-18 -> 0,
    < 25 -> 1 (so < 15 also 1), < 30 -> 2, < 35 -> 3, < 40 -> 4, else -1."""
    b = _trunc(bmi)
    return (F.when(bmi.isNull() | F.isnan(bmi), -1)
             .when((b >= 15) & (b < 18.5), 0).when(b < 25, 1).when(b < 30, 2)
             .when(b < 35, 3).when(b < 40, 4).otherwise(-1))


def encode_ruca(cat: Column) -> Column:
    """Rural 0, SmallTown 1, Micropolitan 2, Metropolitan 3, else -1."""
    return (F.when(cat == V.RUCA_RURAL, 0).when(cat == V.RUCA_SMALLTOWN, 1)
             .when(cat == V.RUCA_MICRO, 2).when(cat == V.RUCA_METRO, 3).otherwise(-1))


def encode_age(age: Column) -> Column:
    """< 25 -> 0, < 30 -> 1, < 35 -> 2, < 40 -> 3, < 45 -> 4, else -1
    (NULL -> -1)."""
    return (F.when(age < 25, 0).when(age < 30, 1).when(age < 35, 2).when(age < 40, 3)
             .when(age < 45, 4).otherwise(-1))


def categorize_ruca(code: Column) -> Column:
    """NULL -> NULL; < 4 Metropolitan; < 7 Micropolitan; < 10 SmallTown;
    < 99 Rural; = 99 NotCoded; else NULL (NaN also NULL)."""
    return (F.when(F.isnan(code), F.lit(None).cast("string"))
             .when(code < 4, F.lit(V.RUCA_METRO)).when(code < 7, F.lit(V.RUCA_MICRO))
             .when(code < 10, F.lit(V.RUCA_SMALLTOWN)).when(code < 99, F.lit(V.RUCA_RURAL))
             .when(code == 99, F.lit(V.RUCA_NOTCODED)))


def clean_sentinel(c: Column) -> Column:
    """Cast to float, negative (missing sentinel) -> NULL."""
    f = c.cast("float")
    return F.when(f < 0, F.lit(None).cast("float")).otherwise(f)


# F16: lookup-dict encodings
def race_indicator(race_fmt: Column, label: str) -> Column:
    """1 if the formatted race is ``label``, else 0 (labels outside the study's
    dict also give 0)."""
    return F.when(race_fmt == label, 1).otherwise(0)


def encode_ethnic_group(eth: Column) -> Column:
    """Hispanic_Latino 1, Not_Hispanic_Latino 0, anything else (NULL,
    Unknown_NotReported) -1."""
    return F.when(eth == V.ETHNIC_HISPANIC_CODE, 1).when(eth == V.ETHNIC_NOT_HISPANIC_CODE, 0) \
            .otherwise(-1)


def encode_fetal_sex(sex: Column) -> Column:
    """Male 1, Female 0, else -1."""
    return F.when(sex == V.SEX_MALE, 1).when(sex == V.SEX_FEMALE, 0).otherwise(-1)


def encode_commercial_insurance(ins: Column) -> Column:
    """Commercial 1, else 0."""
    return F.when(ins == V.INSURANCE_COMMERCIAL, 1).otherwise(0)


def pval_signal(p: Column) -> Column:
    """> 0.1 'ns'; > 0.05 '+'; > 0.01 '*'; > 0.001 '**'; > 0.0001 '***';
    else '****'. NaN is tested first (Spark orders NaN above every number,
    while the study's comparisons are all false for NaN)."""
    expr = F.when(F.isnan(p), F.lit(V.PVAL_SMALLEST))
    for thr, label in V.PVAL_THRESHOLDS:
        expr = expr.when(p > thr, F.lit(label))
    return F.when(p.isNull(), F.lit(None).cast("string")).otherwise(
        expr.otherwise(F.lit(V.PVAL_SMALLEST)))


def _trunc(x: Column) -> Column:
    """Truncate toward zero without a cast (a cast would fail on NaN under ANSI)."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
