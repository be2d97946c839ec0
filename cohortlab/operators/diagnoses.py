"""Diagnosis history (D1-D7): problem list and encounter diagnoses merged,
dated, mapped to concepts and reduced to one row per diagnosis name.

Each stage returns the study's de-duplicated frame, and de-duplicates the
projected rows of the table it joins: repeats on both sides of a join would
otherwise multiply from stage to stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import fill_noted_date
from .skew import full_outer_join

KEY = ["pat_id", "dx_id", "instance"]


def problemlist_clean(problemlist: DataFrame) -> DataFrame:
    """Fill a missing noted date from the entry date, then distinct."""
    pl = problemlist.select(
        "pat_id", "dx_id", "instance", F.col("RESOLVED_DATE"),
        fill_noted_date(F.col("NOTED_DATE"), F.col("RESOLVED_DATE"), F.col("DATE_OF_ENTRY"))
        .alias("NOTED_DATE"))
    return pl.distinct()


def diagnosis_full_outer(problemlist_c: DataFrame, encdx: DataFrame, visit: str = "PAT_ENC_CSN_ID") -> DataFrame:
    """Problem list FULL OUTER encounter diagnoses on (pat_id, dx_id,
    instance); keys are merged (left value, else right), as a USING join does.
    Rows with a NULL key never match and come through from their own side.
    The result is distinct, as in the study: both sides are, and the join needs no shuffle of
    its own for it.

    With ``visit="CONTACT_DATE"`` the encounter diagnoses have been given their dates
    (``visit_dates``) and are not made distinct again, nor is the result."""
    enc = encdx.select("pat_id", "instance", "dx_id", visit, "DIAGNOSISNAME")
    dated = visit != "PAT_ENC_CSN_ID"
    j = full_outer_join(problemlist_c, enc if dated else enc.distinct(), KEY, distinct=not dated)
    return j.select(*KEY, visit, "NOTED_DATE", "RESOLVED_DATE", "DIAGNOSISNAME")


def visit_dates(rows: DataFrame, encounter: DataFrame) -> DataFrame:
    """``rows`` LEFT JOIN the encounters' contact dates on (pat_id, encounter id, instance)."""
    enc = encounter.select("pat_id", "instance", "PAT_ENC_CSN_ID", "CONTACT_DATE").distinct()
    return rows.join(enc, on=["pat_id", "PAT_ENC_CSN_ID", "instance"], how="left")


def diagnosis_contact_date(diag: DataFrame, encounter: DataFrame, dedup: bool = True) -> DataFrame:
    """LEFT join the encounter on (pat_id, encounter id, instance). ``dedup=False`` leaves
    the last distinct to a caller that groups the rows anyway: only diagnoses repeated in
    encounters of one date are more rows then."""
    out = visit_dates(diag, encounter).select(*KEY, "CONTACT_DATE", "NOTED_DATE", "RESOLVED_DATE", "DIAGNOSISNAME")
    return out.distinct() if dedup else out


def diagnosis_concept_map(diag: DataFrame, mapping: DataFrame, dedup: bool = True) -> DataFrame:
    """LEFT join the external concept mapping (dx_id = value, instance).
    ``dedup=False`` leaves the last distinct to a caller that groups the rows anyway."""
    m = mapping.select(F.col("value").alias("dx_id"), "instance", "name", "concept").distinct()
    j = diag.join(m, on=["dx_id", "instance"], how="left")
    out = j.select(*KEY, "CONTACT_DATE", "NOTED_DATE", "RESOLVED_DATE", "DIAGNOSISNAME",
                   "name", "concept")
    return out.distinct() if dedup else out


def full_diagnosis_name(diagnosisname, name):
    """Keep the diagnosis name if it contains the mapped name, else join
    both with '_'. A NULL in either gives NULL."""
    return F.when(diagnosisname.contains(name), diagnosisname).otherwise(
        F.concat(diagnosisname, F.lit("_"), name))


def diagnosis_full_name(diag: DataFrame) -> DataFrame:
    """Add full_diagnosis_name, drop the two name parts."""
    return diag.withColumn("full_diagnosis_name",
                           full_diagnosis_name(F.col("DIAGNOSISNAME"), F.col("name"))
                           ).drop("DIAGNOSISNAME", "name")


def diagnosis_first_contact(diag: DataFrame) -> DataFrame:
    """Earliest contact per (pat_id, dx_id, instance, full name), then
    fill a missing noted date from that contact date.

    The earliest row is taken with ``min(struct(...))`` in a grouped aggregate
    (sort-based, with a partial aggregate before the shuffle): struct order
    sorts NULL first, like the study's ascending window, and the partial step
    keeps a hot key from sending all its rows to one task. Ties on
    the contact date are broken by concept, noted and resolved date (nulls
    first), so the pick is deterministic.
    """
    g = diag.groupBy(*KEY, "full_diagnosis_name").agg(
        F.min(F.struct("CONTACT_DATE", "concept", "NOTED_DATE", "RESOLVED_DATE")).alias("m"))
    return g.select(
        *KEY,
        F.col("full_diagnosis_name").alias("diagnosis_name"),
        fill_noted_date(F.col("m.NOTED_DATE"), F.col("m.RESOLVED_DATE"), F.col("m.CONTACT_DATE"))
        .alias("noted_date"),
        F.col("m.RESOLVED_DATE").alias("RESOLVED_DATE"),
        F.col("m.concept").alias("concept"),
    )


def diag_snomed(diag: DataFrame) -> DataFrame:
    """Keep SNOMED-mapped rows and strip the 7-character vocabulary prefix."""
    d = diag.where(F.lower(F.col("concept")).contains("snomed"))
    return d.withColumn("SNOMED_ids", F.expr("substring(concept, 8, length(concept))")) \
            .withColumnRenamed("RESOLVED_DATE", "resolved_date")


def diagnosis_history(problemlist: DataFrame, encdx: DataFrame, encounter: DataFrame,
                      mapping: DataFrame) -> DataFrame:
    """D1-D7 as one plan (the study's ``qw_diag_snomed`` view).

    Only a row of the encounter diagnoses has an encounter, of its own pat_id and instance. So
    D3's join may stand before D2's: then it moves these rows alone, not also the problem list's,
    and leaves them where equal rows meet, so their distinct needs no shuffle. D6 groups the
    rows, so repeats left by encounters of one date change nothing."""
    dated = visit_dates(encdx.select("pat_id", "instance", "dx_id", "PAT_ENC_CSN_ID", "DIAGNOSISNAME"), encounter)
    d = diagnosis_full_outer(problemlist_clean(problemlist), dated.distinct(), "CONTACT_DATE")
    d = diagnosis_concept_map(d, mapping, dedup=False)
    d = diagnosis_first_contact(diagnosis_full_name(d))
    return diag_snomed(d)
