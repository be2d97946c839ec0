"""The study's stages wired to the proxy sources.

``Study(spark, folder)`` builds a DataFrame for each stage on first use. Those that are
stage tables (the flagged cohort, the study cohort, the matching inputs) and the list of
years run jobs when they are built; all others run when a caller acts on them. The proxy views stand in for the warehouse
tables; a deployment passes its own ``sources`` (an object with a function of the tables for
each name that ``src`` is asked for) and vocabularies.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import concepts, conditions, diagnoses
from ..operators.cohort import filter_delivery_year
from ..operators.exposure import any_flag, cohort_with_exposure, exposure_pivot
from ..session import cut_lineage, fit_tasks, split_hot_keys
from ..sources import proxy
from ..sources.tables import Tables
from ..vocab import IMIDS, MEDICATIONS, RISK_FACTORS


class Study:
    _shared: dict = {}

    FACTORS = proxy.PROXY_RISK_FACTORS
    MEDS = proxy.PROXY_MEDS

    def __init__(self, spark: SparkSession, folder: str, sources=proxy):
        self.spark = spark
        self.t = Tables(spark, folder)
        self.sources = sources

    @classmethod
    def shared(cls, spark: SparkSession, folder: str) -> "Study":
        """One Study per (session, folder), so a materialised stage table (the study
        cohort) is written once and read by every later query of the session, as the
        study reused its saved tables. Entries of ended applications are dropped; after
        the files of a folder change, call ``release`` first."""
        app = spark.sparkContext.applicationId
        for k in [k for k in cls._shared if k[0] != app]:
            del cls._shared[k]
        key = cls._key(spark, folder)
        if key not in cls._shared:
            split_hot_keys(spark)
            cls._shared[key] = cls(spark, folder)
        fit_tasks(spark, folder)
        return cls._shared[key]

    @classmethod
    def release(cls, spark: SparkSession, folder: str) -> None:
        """Forget the stage tables of ``folder``: the next query builds them anew."""
        cls._shared.pop(cls._key(spark, folder), None)

    @classmethod
    def _key(cls, spark: SparkSession, folder: str) -> tuple[str, str, str, str]:
        return spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID(), folder, cls.__name__

    # ------------------------------------------------------------- sources
    @cached_property
    def pregnancy(self) -> DataFrame:
        return self.src("pregnancy")

    @cached_property
    def cohort(self) -> DataFrame:
        """Index date := LMP."""
        return self.pregnancy.withColumn("decided_index_date", F.col("lmp"))

    def src(self, name: str) -> DataFrame:
        return getattr(self.sources, name)(self.t)

    # ------------------------------------------------------------- diagnoses
    @cached_property
    def d1(self) -> DataFrame:
        return diagnoses.problemlist_clean(self.src("problemlist"))

    @cached_property
    def d2(self) -> DataFrame:
        return diagnoses.diagnosis_full_outer(self.d1, self.src("encounterdiagnosis"))

    @cached_property
    def d3(self) -> DataFrame:
        return diagnoses.diagnosis_contact_date(self.d2, self.src("encounter"))

    @cached_property
    def d4(self) -> DataFrame:
        return diagnoses.diagnosis_concept_map(self.d3, self.src("externalconceptmapping"))

    @cached_property
    def d5(self) -> DataFrame:
        return diagnoses.diagnosis_full_name(self.d4)

    @cached_property
    def d6(self) -> DataFrame:
        return diagnoses.diagnosis_first_contact(self.d5)

    @cached_property
    def diag_snomed(self) -> DataFrame:
        """D1-D7 in one plan."""
        return diagnoses.diagnosis_history(self.src("problemlist"), self.src("encounterdiagnosis"),
                                           self.src("encounter"), self.src("externalconceptmapping"))

    @cached_property
    def mapped_diagnoses(self) -> DataFrame:
        """``diag_snomed`` of the diagnoses that the two dictionary tables hold."""
        mapping = conditions.mapped_concepts(self.src("externalconceptmapping"), self.src("diagnosismapping"), self.src("diagnosis"))
        return diagnoses.diagnosis_history(self.src("problemlist"), self.src("encounterdiagnosis"), self.src("encounter"), mapping)

    # ------------------------------------------------------------- concepts, flags
    @cached_property
    def descendants(self) -> DataFrame:
        return concepts.concept_descendants(self.src("condition_registry"), self.src("concept"),
                                            self.src("concept_ancestor"))

    @cached_property
    def codes(self) -> DataFrame:
        return concepts.risk_code_set(self.descendants, self.src("condition_patch"))

    def intervals(self, only_instance_1k: bool = False) -> DataFrame:
        return conditions.coded_intervals(self.mapped_diagnoses, self.codes, only_instance_1k=only_instance_1k)

    def risk_flags(self, only_instance_1k: bool = False, cohort: DataFrame | None = None,
                   factors: list[str] | None = None) -> DataFrame:
        return conditions.add_risk_factors_active_at_index(
            self.cohort if cohort is None else cohort, factors or self.FACTORS,
            self.mapped_diagnoses, self.codes, only_instance_1k=only_instance_1k)

    @cached_property
    def flagged_words(self) -> DataFrame:
        """Stage A output: the cohort with its condition flags, materialised
        once in the checkpoint folder (the study wrote this table too) and
        read by the flag report and every later stage. The flags are the bits of a few
        words, so a stage table is as wide as these and a reader unpacks what it uses."""
        return cut_lineage(conditions.add_risk_words(self.cohort, self.FACTORS, self.mapped_diagnoses, self.codes))

    @cached_property
    def flagged_cohort(self) -> DataFrame:
        """``flagged_words`` with one 0/1 column per condition."""
        return self.flagged_words.select(*self.cohort.columns, *bits.unpack(self.FACTORS))

    # ------------------------------------------------------------- exposure
    @cached_property
    def med_orders(self) -> DataFrame:
        return self.src("medication_order")

    @cached_property
    def imid_cohort(self) -> DataFrame:
        from ..vocab import IMIDS
        from ..operators.exposure import any_flag
        return self.cohort.filter(any_flag(IMIDS))

    def exposure_rows(self, routed: bool = False, mode: str = "reference") -> DataFrame:
        from ..operators import exposure
        from ..vocab import ROUTES
        if routed:
            return exposure.exposure_rows(self.imid_cohort, self.med_orders, self.MEDS, ROUTES, mode)
        return exposure.exposure_rows(self.cohort, self.med_orders, self.MEDS, None, mode)

    @cached_property
    def exposure_flags(self) -> DataFrame:
        from ..operators import exposure
        return exposure.exposure_pivot(self.exposure_rows(), self.MEDS)

    # ------------------------------------------------------------- matching stage
    COMORBIDITIES = proxy.PROXY_COMORBIDITIES
    KEY = ["pat_id", "instance", "episode_id"]

    @cached_property
    def study_cohort(self) -> DataFrame:
        """Pregnancies delivered after the cut-off year, with condition flags
        (the proxy's comorbidities) and area-level SVI / rural-urban codes."""
        from ..functions.encoders import categorize_ruca, clean_sentinel
        from ..operators import cohort as C
        from ..operators.geo import add_all_geo
        from ..vocab import RUCA_COLUMN, SVI_COLUMNS
        c = C.filter_delivery_year(self.flagged_words, proxy.PROXY_MIN_DELIVERY_YEAR)
        words = bits.word_names(len(self.FACTORS))
        base_cols = [x for x in c.columns if x not in words]
        c = add_all_geo(c, self.src("patient"), {
            "svi2018_us": (self.src("svi2018_us"), SVI_COLUMNS),
            "ruca2010revised": (self.src("ruca2010revised"), [RUCA_COLUMN])}).select(*base_cols, *words, *SVI_COLUMNS, RUCA_COLUMN)
        c = c.withColumn("ruca_categorization", categorize_ruca(F.col(RUCA_COLUMN)))
        c = c.withColumns({s: clean_sentinel(F.col(s)) for s in SVI_COLUMNS})
        # Stage boundary (the study wrote this table too): every later stage
        # reads it several times, so it is materialised once in the shared
        # checkpoint folder instead of being recomputed from the sources. It holds the
        # flags as words, of which a reader unpacks what it uses.
        return cut_lineage(c).select(*base_cols, *bits.unpack(self.FACTORS), *SVI_COLUMNS, RUCA_COLUMN, "ruca_categorization")

    @cached_property
    def arms(self) -> tuple[DataFrame, DataFrame]:
        from ..operators import cohort as C
        from ..vocab import IMIDS
        return C.split_arms(self.study_cohort, IMIDS)

    @cached_property
    def years(self) -> list[int]:
        """Delivery years present in the union of the arms."""
        from ..operators.features import distinct_years
        treated, controls = self.arms
        return distinct_years(treated.select("delivery_year").unionByName(controls.select("delivery_year")))

    def overall(self) -> DataFrame:
        """The comparison of all diseases ('IMID') alone: ``comparisons_long`` of it,
        without copying the controls for the others."""
        treated, controls = self.arms
        return controls.withColumn("IMID_status", F.lit(0)) \
            .unionByName(treated.withColumn("IMID_status", F.lit(1))) \
            .withColumn("comparison", F.lit("IMID"))

    @staticmethod
    def treated_long(treated: DataFrame) -> DataFrame:
        """Treated rows once per comparison they belong to: 'IMID' (any of the diseases) and
        each disease flagged."""
        return treated.withColumn("comparison", F.explode(F.filter(F.array(
            F.lit("IMID"), *[F.when(F.col(d) == 1, F.lit(d)) for d in IMIDS]), lambda x: x.isNotNull()))) \
            .withColumn("IMID_status", F.lit(1))

    def comparisons_long(self, cohort: DataFrame | None = None) -> DataFrame:
        """Treated rows once per comparison they belong to ('IMID' = any of the
        diseases, plus each disease flagged), control rows once per comparison;
        ``IMID_status`` labels the arm."""
        from ..operators import cohort as C
        from ..vocab import IMIDS
        if cohort is None:
            treated, controls = self.arms
        else:
            treated, controls = C.split_arms(cohort, IMIDS)
        cl = controls.withColumn("comparison", F.explode(F.array(
            F.lit("IMID"), *[F.lit(d) for d in IMIDS])))
        return cl.withColumn("IMID_status", F.lit(0)).unionByName(self.treated_long(treated))

    @property
    def select_columns(self) -> list[str]:
        from ..vocab import MATCH_BASE_COLUMNS
        return MATCH_BASE_COLUMNS + self.COMORBIDITIES

    def features(self, long: DataFrame, sensitivity: bool = False, extra: list[str] | None = None):
        from ..operators.features import psm_features
        from ..vocab import MATCH_BASE_COLUMNS
        cols = MATCH_BASE_COLUMNS if sensitivity else self.select_columns
        key = self.KEY + (extra or [])
        return psm_features(long, cols, self.years, key, arm=["comparison", "IMID_status"])

    def matched(self, score: str = "px_score", long: DataFrame | None = None) -> DataFrame:
        """PS3 per comparison on a fixed score column, which is the same for a control
        in every comparison: see ``shared_pool_matching``."""
        from ..operators.matching import shared_pool_matching
        long = self.comparisons_long() if long is None else long
        treated = long.filter(F.col("IMID_status") == 1).select("comparison", *self.KEY, score)
        _, controls = self.arms
        return shared_pool_matching(treated, controls.select(*self.KEY, score), "IMID_status",
                                    score, self.KEY, ["comparison"])

    def outcome_table(self, analysis: str, matched: DataFrame | None = None) -> DataFrame:
        """Risk table per comparison and outcome for one analysis:
        'adjusted' (matched controls, fixed score), 'sensitivity' (matched on
        the sensitivity score), 'unadjusted' (all controls)."""
        from ..operators import cohort as C
        from ..operators import outcomes as O
        from ..vocab import IMIDS
        # only the columns the counts need go through the de-duplication
        need = [*C.PREGNANCY_DEDUP_KEY, "episode_id", *IMIDS,
                "preterm_category", "LBW", "SGA", "delivery_method"]
        cohort_c = C.dedup_pregnancy(self.study_cohort.select(*need))
        long_c = self.comparisons_long(cohort_c)
        treated_counts = O.outcome_counts(long_c.filter(F.col("IMID_status") == 1), ["comparison"])
        if analysis == "unadjusted":
            # every comparison uses all controls: count them once, then repeat
            # the single count row per comparison
            _, controls_c = C.split_arms(cohort_c, IMIDS)
            control_counts = O.outcome_counts(controls_c, []).withColumn(
                "comparison", F.explode(F.array(*[F.lit(c) for c in ["IMID", *IMIDS]])))
        else:
            score = "px_score" if analysis == "adjusted" else "px_score_sa"
            m = self.matched(score) if matched is None else matched
            mc = m.filter(F.col("IMID_status") == 0).select("comparison", *self.KEY)
            _, controls = self.arms
            # Matched control keys (repeats kept) joined back to the control rows
            rows = C.match_back(
                controls.select(*self.KEY, "preterm_category", "LBW", "SGA", "delivery_method"),
                mc, self.KEY, extra=["comparison"])
            control_counts = O.outcome_counts(rows, ["comparison"])
        long = O.outcome_long(treated_counts, control_counts, ["comparison"])
        return O.risk_table(long, ["comparison"]).withColumn("analysis", F.lit(analysis))


class WholeStudy(Study):
    """The stages at their full width, each fed by the one before: R1 flags all 85 conditions,
    its 12 disease columns choose the disease cohort, whose routed orders give 32 classes x 5
    exposures; flags and exposures are joined to the cohort and the arms are split from that.
    The cohort's own disease columns, if any, are not read."""

    FACTORS = RISK_FACTORS
    MEDS = MEDICATIONS

    @cached_property
    def cohort(self) -> DataFrame:
        return super().cohort.drop(*IMIDS)

    def src(self, name: str) -> DataFrame:
        if name in ("condition_registry", "condition_patch"):
            return getattr(self.sources, name)(self.t, self.FACTORS)
        if name == "medication_order":
            return self.sources.medication_order(self.t, whole=True)
        return super().src(name)

    @cached_property
    def imid_cohort(self) -> DataFrame:
        return self.flagged_cohort.filter(any_flag(IMIDS))

    @cached_property
    def study_cohort(self) -> DataFrame:
        """Flags (R1) and the disease cohort's exposures (J15) on the pregnancies after the cut-off year."""
        pivot = exposure_pivot(self.exposure_rows(routed=True), self.MEDS)
        both = cohort_with_exposure(self.flagged_cohort, pivot, self.MEDS)
        return cut_lineage(filter_delivery_year(both, proxy.PROXY_MIN_DELIVERY_YEAR))
