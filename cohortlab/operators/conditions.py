"""Conditions active at an index date (R1, with J6, J7, J8).

The study ran one SQL job per risk factor (85 of them), each with its own
driver round trips, left join and de-duplication. Because a match always sets
the flag to 1, the 85 rounds equal 85 EXISTS tests, which are answered here in
one pass:

  semi joins of the concept mapping to the two dictionary tables
  -> diagnoses JOIN code sets (broadcast where adaptive execution measures them small)
  -> union of the intervals of each (patient, factor)
  -> JOIN cohort keys on (pat_id, instance) with the interval as a residual
  -> group by (patient, index date), one bit a factor, one bit_or a word
  -> LEFT JOIN back to the cohort, bits to columns, missing flags = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..session import cut_lineage

FACTOR_KEY = ["pat_id", "instance", "risk_factor"]
OPEN = 1 << 40  # the number of a day beyond all dates
NO_DAY = -1 << 31  # the number of a missing index date, before all dates


def diagnosis_mapped_semi(diag: DataFrame, dxmap: DataFrame, dx: DataFrame) -> DataFrame:
    """The study's INNER joins to the mapping and diagnosis tables only test
    existence (the GROUP BY removes their multiplicity), so they are semi joins."""
    return diag.join(dxmap.select("dx_id"), "dx_id", "left_semi") \
               .join(dx.select("dx_id"), "dx_id", "left_semi")


def mapped_concepts(mapping: DataFrame, dxmap: DataFrame, dx: DataFrame) -> DataFrame:
    """J6 at the size of the dictionaries: the external concept mapping of the diagnoses that
    both tables hold. A diagnosis without a concept is no SNOMED diagnosis, and D4 to D7 never
    mix the rows of two dx_ids. So the diagnosis history of this mapping is that of the whole
    one, semi-joined (``diagnosis_mapped_semi``), and no diagnosis row moves for it."""
    return diagnosis_mapped_semi(mapping.withColumnRenamed("value", "dx_id"), dxmap, dx).withColumnRenamed("dx_id", "value")


def coded_intervals(diag_snomed: DataFrame, codes: DataFrame, dxmap: DataFrame | None = None, dx: DataFrame | None = None,
                    only_instance_1k: bool = False) -> DataFrame:
    """(pat_id, instance, noted_date, resolved_date, risk_factor) for every
    mapped diagnosis whose SNOMED code is in the factor's code set. Without ``dxmap`` and
    ``dx``, ``diag_snomed`` holds mapped diagnoses only (``mapped_concepts``).

    The code set is small (factors x descendant codes) but computed, so no
    hint is given: adaptive execution broadcasts it after measuring it."""
    d = diag_snomed
    if only_instance_1k:
        d = d.filter(F.col("instance") == 1000)
    c = codes.select(F.col("code").alias("SNOMED_ids"), "risk_factor")
    m = d.select("pat_id", "dx_id", "instance", "noted_date", "resolved_date", "SNOMED_ids") \
         .join(c, "SNOMED_ids")
    if dxmap is not None:
        m = diagnosis_mapped_semi(m, dxmap, dx)
    return m.select("pat_id", "instance", "noted_date", "resolved_date", "risk_factor")


def interval_union(intervals: DataFrame, key: list[str] = FACTOR_KEY) -> DataFrame:
    """The union of each key's closed intervals [noted_date, resolved_date] (NULL: open) as
    intervals of which no two share a day, with ``always``: whether one of an interval's parts
    was open at both ends (only such a part covers a NULL date). Intervals that end before
    they start cover nothing and go.

    Intervals that start on the same day are merged by a grouped aggregate first, so a key has
    at most a row for each day of the calendar when its rows are put in order: that many, and
    not its number of diagnoses, meet in one task. In order of their start, an interval opens
    a new island if all before it ended before it starts.

    Days are numbers here, an open end one beyond all dates: an aggregate of numbers is
    hashed, one of structs is sorted."""
    noted, resolved = F.col("noted_date"), F.col("resolved_date")
    real = noted.isNull() | resolved.isNull() | (noted <= resolved)
    start, reach = (F.coalesce(F.unix_date(c).cast("long"), F.lit(end)) for c, end in ((noted, -OPEN), (resolved, OPEN)))
    days = intervals.filter(real).groupBy(*key, "noted_date").agg(
        F.max(reach).alias("_reach"), F.max(noted.isNull() & resolved.isNull()).alias("_always"))
    order = Window.partitionBy(*key).orderBy(noted.asc_nulls_first())
    before = F.max("_reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = before.isNull() | (before < start)
    islands = days.withColumn("_opens", opens.cast("int")) \
        .withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy(*key, "_island").agg(F.min(start).alias("_first"), F.max("_reach").alias("_last"),
                                                  F.max("_always").alias("always"))

    def day(number: str) -> Column:
        return F.when(F.abs(number) < OPEN, F.date_from_unix_date(F.col(number).cast("int")))

    return joined.select(*key, day("_first").alias("noted_date"), day("_last").alias("resolved_date"), "always")


def active_at(index_date: Column, noted: Column, resolved: Column) -> Column:
    """Index date within [noted, resolved]; a missing bound is open."""
    return ((index_date >= noted) | noted.isNull()) & ((index_date <= resolved) | resolved.isNull())


def active_interval_join(cohort_keys: DataFrame, intervals: DataFrame,
                         index_col: str = "decided_index_date") -> DataFrame:
    """(pat_id, instance, index date, risk_factor) where an interval of that factor covers
    the index date. The intervals are united first, so a date meets one interval of a factor
    at most and each row is a flag. Equi keys (pat_id, instance) drive a hash-partitioned
    join; the interval test is a residual condition."""
    k = cohort_keys.select("pat_id", "instance", index_col)
    iv = interval_union(intervals).withColumnsRenamed({"pat_id": "_pid", "instance": "_inst"})
    cond = (k.pat_id == iv._pid) & (k.instance == iv._inst) & \
        active_at(k[index_col], iv.noted_date, iv.resolved_date) & (k[index_col].isNotNull() | iv.always)
    return k.join(iv, cond, "inner").select("pat_id", "instance", index_col, "risk_factor")


def risk_flag_words(hits: DataFrame, factors: list[str],
                    index_col: str = "decided_index_date") -> DataFrame:
    """The factors (names, or their places as smallint) of each (patient, index date) as bits of
    a few words: a grouped ``bit_or`` with partial aggregation, as wide as the words and not as
    the factors."""
    place = F.col("risk_factor") if dict(hits.dtypes)["risk_factor"] == "smallint" else \
        F.element_at(bits.places(factors), F.col("risk_factor"))
    masks = bits.words(place, F.lit(1), len(factors))
    return hits.groupBy("pat_id", "instance", index_col).agg(
        *[F.bit_or(m).alias(w) for m, w in zip(masks, bits.word_names(len(factors)))])


def risk_flag_table(hits: DataFrame, factors: list[str],
                    index_col: str = "decided_index_date") -> DataFrame:
    """One column per factor (a fixed list, so factors with no hits still get a column), 1 or
    NULL."""
    names = bits.word_names(len(factors))
    return risk_flag_words(hits, factors, index_col).select("pat_id", "instance", index_col, *[
        F.when(bits.flag(names, i) == 1, F.lit(1)).alias(f) for i, f in enumerate(factors)])


def add_risk_words(cohort: DataFrame, factors: list[str], diag_snomed: DataFrame, codes: DataFrame,
                   dxmap: DataFrame | None = None, dx: DataFrame | None = None, only_instance_1k: bool = False,
                   index_col: str = "decided_index_date", dedup_rows: bool = True) -> DataFrame:
    """R1 with the flags as the bits of a few words (``bits.word_names``), none NULL. With
    ``dedup_rows`` the cohort is whole-row de-duplicated, as the study's per-factor loop did.

    The intervals are a stage table, at which the shuffles of the diagnosis chain end. The cohort
    is de-duplicated after the join: a row meets one row of flags at most, so equal rows stay
    equal, and the join has brought them together. The index date is a number, a missing one
    too, as a plain key is what the de-duplication finds its rows dealt by."""
    # factors travel by their place in the list; a code of no listed factor sets no flag
    codes = codes.withColumn("risk_factor", F.element_at(bits.places(factors), F.col("risk_factor")).cast("smallint")) \
        .where(F.col("risk_factor").isNotNull())
    iv = cut_lineage(coded_intervals(diag_snomed, codes, dxmap, dx, only_instance_1k))
    hits = active_interval_join(cohort, iv, index_col)
    names = bits.word_names(len(factors))
    day = F.coalesce(F.unix_date(F.col(index_col)), F.lit(NO_DAY))
    f = risk_flag_words(hits, factors, index_col).select(
        F.col("pat_id").alias("_fp"), F.col("instance").alias("_fi"), day.alias("_fd"), *names)
    base = cohort.withColumn("_day", day)
    cond = (base.pat_id == f._fp) & (base.instance == f._fi) & (base._day == f._fd)
    out = base.join(f, cond, "left").select(*[base[c] for c in base.columns], *[
        F.coalesce(f[w], F.lit(0).cast("long")).alias(w) for w in names])
    return (out.dropDuplicates() if dedup_rows else out).drop("_day")


def add_risk_factors_active_at_index(cohort: DataFrame, factors: list[str], diag_snomed: DataFrame,
                                     codes: DataFrame, dxmap: DataFrame | None = None, dx: DataFrame | None = None,
                                     only_instance_1k: bool = False,
                                     index_col: str = "decided_index_date",
                                     dedup_rows: bool = True) -> DataFrame:
    """The cohort plus one 0/1 column per factor (see ``add_risk_words``)."""
    return add_risk_words(cohort, factors, diag_snomed, codes, dxmap, dx, only_instance_1k, index_col, dedup_rows) \
        .select(*cohort.columns, *bits.unpack(factors))
