"""Registered queries: one per operator of the study, each a function
``(spark, folder) -> DataFrame`` over the whole proxy tables.

Output columns are aliased to the names used by the SQL oracle
(``oracle/queries.py``); doubles that come from arithmetic are rounded to 6
places so both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import fill_noted_date
from ..operators import concepts, conditions
from ..sources import proxy
from .study import Study, WholeStudy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


FLAG_KEY = ["pat_id", "instance", "episode_id", "decided_index_date"]


# ------------------------------------------------------------------ diagnoses
@query("scan_distinct_problemlist")
def q_scan_distinct_problemlist(spark, folder):
    s = Study.shared(spark, folder)
    return s.src("problemlist").select("pat_id", "dx_id", "instance", "NOTED_DATE",
                                       "RESOLVED_DATE", "DATE_OF_ENTRY").distinct()


@query("noted_date_fill")
def q_noted_date_fill(spark, folder):
    s = Study.shared(spark, folder)
    p = s.src("problemlist")
    return p.select("pat_id", "dx_id", "instance", "NOTED_DATE", "RESOLVED_DATE", "DATE_OF_ENTRY",
                    fill_noted_date(F.col("NOTED_DATE"), F.col("RESOLVED_DATE"),
                                    F.col("DATE_OF_ENTRY")).alias("new_noted_date"))


@query("problemlist_clean")
def q_problemlist_clean(spark, folder):
    return Study.shared(spark, folder).d1


@query("diagnosis_full_outer")
def q_diagnosis_full_outer(spark, folder):
    return Study.shared(spark, folder).d2


@query("diagnosis_contact_date")
def q_diagnosis_contact_date(spark, folder):
    return Study.shared(spark, folder).d3


@query("diagnosis_concept_map")
def q_diagnosis_concept_map(spark, folder):
    return Study.shared(spark, folder).d4


@query("diagnosis_full_name")
def q_diagnosis_full_name(spark, folder):
    return Study.shared(spark, folder).d5


@query("diagnosis_first_contact")
def q_diagnosis_first_contact(spark, folder):
    return Study.shared(spark, folder).d6


@query("diag_snomed")
def q_diag_snomed(spark, folder):
    return Study.shared(spark, folder).diag_snomed


@query("diagnosis_mapped_semi")
def q_diagnosis_mapped_semi(spark, folder):
    s = Study.shared(spark, folder)
    return conditions.diagnosis_mapped_semi(s.diag_snomed, s.src("diagnosismapping"),
                                            s.src("diagnosis"))


# ------------------------------------------------------------------ concepts, flags
@query("concept_descendants")
def q_concept_descendants(spark, folder):
    return Study.shared(spark, folder).descendants


@query("concept_descendants_ordered")
def q_concept_descendants_ordered(spark, folder):
    return concepts.ordered_descendants(Study.shared(spark, folder).descendants)


@query("risk_code_set")
def q_risk_code_set(spark, folder):
    return Study.shared(spark, folder).codes


@query("active_interval_join")
def q_active_interval_join(spark, folder):
    s = Study.shared(spark, folder)
    return conditions.active_interval_join(s.cohort, s.intervals()).distinct()  # pregnancies may share an index date


@query("risk_flags")
def q_risk_flags(spark, folder):
    s = Study.shared(spark, folder)
    return s.flagged_cohort.select(*FLAG_KEY, *proxy.PROXY_RISK_FACTORS)


@query("riskflags_instance_1000")
def q_riskflags_instance_1000(spark, folder):
    s = Study.shared(spark, folder)
    return s.risk_flags(only_instance_1k=True).select(*FLAG_KEY, *proxy.PROXY_RISK_FACTORS)


@query("risk_flags_whole")
def q_risk_flags_whole(spark, folder):
    """R1 with all 85 conditions."""
    s = WholeStudy.shared(spark, folder)
    return s.flagged_cohort.select(*FLAG_KEY, *s.FACTORS)


# ------------------------------------------------------------------ exposure
from ..operators import exposure as EX  # noqa: E402
from ..vocab import ROUTES  # noqa: E402

ORDER_OUT = ["pat_id", "instance", "gestational_days", "lmp", "ob_delivery_delivery_date",
             "start_date", "end_date", "route"]


@query("medication_overlap_join")
def q_medication_overlap_join(spark, folder):
    s = Study.shared(spark, folder)
    return EX.medication_overlap_join(s.cohort, s.med_orders)


@query("medication_orders")
def q_medication_orders(spark, folder):
    s = Study.shared(spark, folder)
    return EX.medication_orders(s.cohort, s.med_orders, proxy.PROXY_MEDS)


@query("medication_orders_routed")
def q_medication_orders_routed(spark, folder):
    s = Study.shared(spark, folder)
    return EX.medication_orders(s.imid_cohort, s.med_orders, proxy.PROXY_MEDS, ROUTES)


@query("filter_any_flag")
def q_filter_any_flag(spark, folder):
    s = Study.shared(spark, folder)
    return s.med_orders.filter(EX.any_flag(proxy.PROXY_MEDS))


@query("med_argmax")
def q_med_argmax(spark, folder):
    s = Study.shared(spark, folder)
    return s.exposure_rows().select(*ORDER_OUT, *proxy.PROXY_MEDS, "med_name")


@query("exposure_period")
def q_exposure_period(spark, folder):
    s = Study.shared(spark, folder)
    return s.exposure_rows().select(*ORDER_OUT, "orderstart_lmp", "orderstart_lmp_period")


@query("exposure_durations")
def q_exposure_durations(spark, folder):
    from ..functions import exposure as X
    s = Study.shared(spark, folder)
    r = s.exposure_rows()
    st, en, ga = F.col("orderstart_lmp"), F.col("orderend_lmp"), F.col("gestational_days")
    return r.select(*ORDER_OUT, "orderstart_lmp", "orderend_lmp",
                    "exposure0_duration", "exposure1_duration", "exposure2_duration",
                    "exposure3_duration",
                    X.exposure0_duration(st, en, "clipped").alias("clipped0_duration"),
                    X.exposure1_duration(st, en, "clipped").alias("clipped1_duration"),
                    X.exposure2_duration(st, en, "clipped").alias("clipped2_duration"),
                    X.exposure3_duration(st, en, ga, "clipped").alias("clipped3_duration"))


@query("medinfo_exposure")
def q_medinfo_exposure(spark, folder):
    s = Study.shared(spark, folder)
    return s.exposure_rows(routed=True).drop(*proxy.PROXY_MEDS)


@query("exposure_agg")
def q_exposure_agg(spark, folder):
    return EX.exposure_agg(Study.shared(spark, folder).exposure_rows())


@query("aggregate_data_sum_max")
def q_aggregate_data_sum_max(spark, folder):
    s = Study.shared(spark, folder)
    return EX.aggregate_data(s.exposure_rows(), ["pat_id", "instance"],
                             {"order_duration": "sum", "orderstart_lmp": "min",
                              "exposure_total_status": "max"})


@query("exposure_pivot")
def q_exposure_pivot(spark, folder):
    return Study.shared(spark, folder).exposure_flags


@query("exposure_pivot_whole")
def q_exposure_pivot_whole(spark, folder):
    """M10 with all 32 classes x 5 exposures."""
    return WholeStudy.shared(spark, folder).exposure_flags


@query("arms_from_flags")
def q_arms_from_flags(spark, folder):
    """Arms from R1's disease columns with J15's exposures: each row's diseases, and how many
    of its 160 exposures are set."""
    s = WholeStudy.shared(spark, folder)
    treated, controls = s.arms
    both = C.arm_union(controls, treated, "IMID_status")
    exposed = [f"{m}_{x}" for m in s.MEDS for x in EX.STATUSES]
    return both.select(*KEY, "IMID_status", *IMIDS, F.aggregate(
        F.array(*exposed), F.lit(0), lambda a, x: a + x).alias("n_exposures"))


@query("cohort_with_exposure")
def q_cohort_with_exposure(spark, folder):
    s = Study.shared(spark, folder)
    c = s.cohort.select("pat_id", "instance", "episode_id", "lmp", "gestational_days")
    return EX.cohort_with_exposure(c, s.exposure_flags, proxy.PROXY_MEDS)


# ------------------------------------------------------------------ cohort and arms
from ..functions import encoders as E  # noqa: E402
from ..operators import balance as BAL  # noqa: E402
from ..operators import cohort as C  # noqa: E402
from ..operators import features as FT  # noqa: E402
from ..operators import geo as G  # noqa: E402
from ..operators import matching as M  # noqa: E402
from ..operators import outcomes as O  # noqa: E402
from ..operators.propensity import propensity_score  # noqa: E402
from ..session import cut_lineage  # noqa: E402
from ..sources.tables import read_table, save_table, table_name  # noqa: E402
from ..vocab import IMIDS, SVI_IMPUTED  # noqa: E402

KEY = ["pat_id", "instance", "episode_id"]
OUTC = ["preterm_category", "LBW", "SGA", "delivery_method"]


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


@query("filter_delivery_year")
def q_filter_delivery_year(spark, folder):
    s = Study.shared(spark, folder)
    return C.filter_delivery_year(s.pregnancy, proxy.PROXY_MIN_DELIVERY_YEAR) \
            .select(*KEY, "delivery_year")


@query("control_anti_join")
def q_control_anti_join(spark, folder):
    s = Study.shared(spark, folder)
    _, controls = C.split_arms(s.pregnancy, IMIDS)
    return controls.select(*KEY, "lmp")


@query("subcohort_by_flag")
def q_subcohort_by_flag(spark, folder):
    s = Study.shared(spark, folder)
    return C.subcohort_by_flag(s.pregnancy, IMIDS, KEY)


@query("align_columns_union")
def q_align_columns_union(spark, folder):
    s = Study.shared(spark, folder)
    treated, controls = C.split_arms(s.pregnancy, IMIDS)
    a = controls.select(*KEY, "delivery_year", "px_score", "ibd")
    b = treated.select("episode_id", "pat_id", "instance", "px_score", "lmp", "ibd")
    return C.align_and_union(a, b)


@query("arm_union")
def q_arm_union(spark, folder):
    s = Study.shared(spark, folder)
    treated, controls = C.split_arms(s.pregnancy, IMIDS)
    return C.arm_union(controls.select(*KEY, "px_score"),
                       treated.select(*KEY, "px_score", "ibd"), "IMID_status")


@query("cohort_counts")
def q_cohort_counts(spark, folder):
    s = Study.shared(spark, folder)
    return C.cohort_counts(s.pregnancy)


@query("dedup_pregnancy_key")
def q_dedup_pregnancy_key(spark, folder):
    s = Study.shared(spark, folder)
    d = C.dedup_pregnancy(s.pregnancy.select(*C.PREGNANCY_DEDUP_KEY, "episode_id", "px_score"))
    return d


@query("sink_roundtrip")
def q_sink_roundtrip(spark, folder):
    """Save the flag table under a versioned catalog name and read it by that name."""
    import uuid
    from ..session import ensure_checkpoint_dir
    s = Study.shared(spark, folder)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS cohortlab LOCATION '{ensure_checkpoint_dir(spark)}/catalog'")
    name = table_name("risk_flags", uuid.uuid4().hex, schema="cohortlab")
    save_table(s.risk_flags().select(*FLAG_KEY, *proxy.PROXY_RISK_FACTORS), name)
    return read_table(spark, name)


# ------------------------------------------------------------------ geography
GEO_PAYLOAD = {
    "ruca2010revised": ("FIPS", ["SecondaryRUCACode2010"]),
    "svi2018_us": ("FIPS", ["RPL_THEMES", "RPL_THEME1", "RPL_THEME2", "RPL_THEME3", "RPL_THEME4"]),
    "countytypologycodes2015": ("FIPS4", ["Economic_Type"]),
    "urbaninfluencecodes2013": ("FIPS4", ["UIC_2013"]),
    "svi2018_us_county": ("FIPS5", ["RPL_THEMES_COUNTY"]),
    "ruralurbancontinuumcodes2013": ("FIPS5", ["RUCC_2013"]),
    "farcodeszip2010": ("ZIP5", ["FAR_LEVEL1"]),
}


def _geo_query(*names):
    def run(spark, folder):
        s = Study.shared(spark, folder)
        out = None
        for n in names:
            key, payload = GEO_PAYLOAD[n]
            g = G.patient_geo(s.src("patient"), s.src(n), n)
            g = g.select("pat_id", "instance", F.col(key).alias("geo_key"),
                         F.col(payload[0]).cast("double").alias("value"),
                         *[F.col(p).cast("double").alias(p) for p in payload[1:]],
                         F.lit(n).alias("geo_table"))
            out = g if out is None else out.unionByName(g)
        return out
    return run


QUERIES["geo_ruca"] = _geo_query("ruca2010revised")
QUERIES["geo_svi_tract"] = _geo_query("svi2018_us")
QUERIES["geo_county_fips4"] = _geo_query("countytypologycodes2015", "urbaninfluencecodes2013")
QUERIES["geo_county_fips5"] = _geo_query("svi2018_us_county", "ruralurbancontinuumcodes2013")
QUERIES["geo_zip_far"] = _geo_query("farcodeszip2010")


@query("geo_features")
def q_geo_features(spark, folder):
    s = Study.shared(spark, folder)
    c = s.pregnancy.select(*KEY)
    out = G.add_geo_features(c, s.src("patient"), s.src("ruca2010revised"), "ruca2010revised")
    return out.select(*KEY, "SecondaryRUCACode2010")


@query("categorize_ruca")
def q_categorize_ruca(spark, folder):
    s = Study.shared(spark, folder)
    r = s.src("ruca2010revised")
    return r.select("State_County_Tract_FIPS_Code", "SecondaryRUCACode2010",
                    E.categorize_ruca(F.col("SecondaryRUCACode2010")).alias("ruca_categorization"))


@query("encode_ruca")
def q_encode_ruca(spark, folder):
    s = Study.shared(spark, folder)
    r = s.src("ruca2010revised")
    cat = E.categorize_ruca(F.col("SecondaryRUCACode2010"))
    return r.select("State_County_Tract_FIPS_Code", E.encode_ruca(cat).alias("ruca_code"))


@query("svi_clean_sentinel")
def q_svi_clean_sentinel(spark, folder):
    s = Study.shared(spark, folder)
    v = s.src("svi2018_us")
    return _r6(v.select("FIPS", *[E.clean_sentinel(F.col(c)).alias(c) for c in
                                  ["RPL_THEMES", *SVI_IMPUTED]]), ["RPL_THEMES", *SVI_IMPUTED])


# ------------------------------------------------------------------ encoders
def _enc(name, cols):
    """Register an encoder query: pregnancy id, inputs and the encoded value.
    ``cols`` builds the columns when the query runs (a session is needed)."""
    def run(spark, folder):
        p = Study.shared(spark, folder).pregnancy
        return p.select("episode_id", *cols())
    QUERIES[name] = run


def _race_in():
    return F.concat_ws("|", F.col("race")).alias("race_in")


_enc("encode_race", lambda: [_race_in(), E.format_race(F.col("race")).alias("race_fmt")])
_enc("race_consolidate", lambda: [
    _race_in(), F.concat_ws("|", E.consolidate_race_responses(F.col("race"))).alias("race_list")])
_enc("race_multiracial", lambda: [
    _race_in(), E.handle_multiracial_exceptions(F.col("race")).alias("race_fmt")])
_enc("ethnic_group_fmt", lambda: [
    F.col("ethnic_group"), E.format_ethnic_group(F.col("ethnic_group")).alias("ethnic_fmt")])
_enc("encode_parity", lambda: [F.col("Parity"), E.format_parity(F.col("Parity")).alias("parity_code")])
_enc("encode_gravidity", lambda: [
    F.col("Gravidity"), E.format_gravidity(F.col("Gravidity")).alias("gravidity_code")])
_enc("encode_preterm_history", lambda: [
    F.col("Preterm_history"), F.col("gestational_days"),
    E.format_preterm_history(F.col("Preterm_history"), F.col("gestational_days"))
    .alias("preterm_history_code")])
_enc("encode_bmi", lambda: [F.col("pregravid_bmi"), E.encode_bmi(F.col("pregravid_bmi")).alias("bmi_code")])
_enc("encode_age", lambda: [F.col("age_at_start_dt"), E.encode_age(F.col("age_at_start_dt")).alias("age_code")])
_enc("pval_signal", lambda: [F.round("px_score", 6).alias("p"),
                             E.pval_signal(F.col("px_score")).alias("signal")])

# A delivery label per pregnancy, cycling through every study label plus one
# outside them and a NULL, so each branch of the encoder is exercised.
from ..vocab import DELIVERY_CSECTION, DELIVERY_VAGINAL  # noqa: E402

DELIVERY_LABELS = DELIVERY_VAGINAL + DELIVERY_CSECTION + ["Unknown"]


def _delivery_cols():
    dl = F.try_element_at(F.array(*[F.lit(x) for x in DELIVERY_LABELS]),
                          (F.col("episode_id") % (len(DELIVERY_LABELS) + 1) + 1).cast("int"))
    return [dl.alias("delivery_label"), E.encode_delivery_method(dl).alias("delivery_code")]


_enc("encode_delivery_method", _delivery_cols)


@query("year_one_hot")
def q_year_one_hot(spark, folder):
    """F15 for the years present, one row per pregnancy and indicator."""
    p = Study.shared(spark, folder).pregnancy
    hot = FT.year_one_hot(FT.distinct_years(p))
    return p.select("episode_id", "delivery_year", F.inline(F.array(*[
        F.struct(F.lit(k).alias("indicator"), v.alias("value")) for k, v in hot.items()])))


@query("median_impute_svi")
def q_median_impute_svi(spark, folder):
    s = Study.shared(spark, folder)
    long = s.overall()
    out = FT.median_impute(long.select(*KEY, "IMID_status", *SVI_IMPUTED), SVI_IMPUTED, ["IMID_status"])
    return _r6(out, SVI_IMPUTED)


@query("median_impute_all")
def q_median_impute_all(spark, folder):
    p = Study.shared(spark, folder).pregnancy
    cols = ["pregravid_bmi", "Parity", "Gravidity", "Preterm_history", "smoker", "illegal_drug_user"]
    out = FT.median_impute(p.select(*KEY, *cols), cols)
    return _r6(out, cols)


@query("missingness_report")
def q_missingness_report(spark, folder):
    s = Study.shared(spark, folder)
    return FT.missingness(s.overall(), SVI_IMPUTED + ["pregravid_bmi"], ["IMID_status"])


@query("psm_features")
def q_psm_features(spark, folder):
    """F14; the year indicators (as many as years) are reported as the names that are set."""
    s = Study.shared(spark, folder)
    f, names = s.features(s.overall())
    hot = [n for n in names if n.startswith("year_")]
    f = f.withColumn("years_set", F.concat_ws("|", *[F.when(F.col(n) == 1, F.lit(n)) for n in hot]))
    return _r6(f.drop("comparison", *hot), SVI_IMPUTED)


# ------------------------------------------------------------------ matching, balance
def _overall(s: Study) -> DataFrame:
    return s.overall()


@query("psm_match_1nn")
def q_psm_match_1nn(spark, folder):
    s = Study.shared(spark, folder)
    long = _overall(s).select(*KEY, "IMID_status", "px_score")
    return M.propensity_score_matching(long, "IMID_status", "px_score", KEY)


@query("psm_match_reverse")
def q_psm_match_reverse(spark, folder):
    """The reverse direction (more treated than controls, so each control takes
    its nearest treated row), on the whole overall comparison with the arm
    labels swapped."""
    s = Study.shared(spark, folder)
    long = _overall(s).select(*KEY, (1 - F.col("IMID_status")).alias("IMID_status"), "px_score")
    return M.propensity_score_matching(long, "IMID_status", "px_score", KEY)


@query("match_back_join")
def q_match_back_join(spark, folder):
    s = Study.shared(spark, folder)
    m = s.matched("px_score").filter((F.col("comparison") == "IMID") & (F.col("IMID_status") == 0))
    _, controls = s.arms
    return C.match_back(controls.select(*KEY, "lmp", *OUTC), m, KEY)


@query("cohen_d")
def q_cohen_d(spark, folder):
    s = Study.shared(spark, folder)
    f, names = s.features(_overall(s))
    return _r6(BAL.cohen_d(f, "IMID_status", names), ["effect_size"])


def _balance(s: Study, score: str, comparisons: list[str] | None):
    """E2 per comparison. Treated rows are encoded per comparison; the control pool is the same
    in every comparison (same rows, same medians) and encoded once. Matched rows are counted
    per key first, so a feature row is joined once, however often it was matched: treated
    rows give both effect sizes in one pass, controls one pass each."""
    comps = comparisons or ["IMID", *IMIDS]
    group = ["comparison"]
    long = s.comparisons_long().filter(F.col("comparison").isin(comps))
    _, controls = s.arms
    ft, names = s.features(long.filter(F.col("IMID_status") == 1))
    fc, _ = s.features(controls.withColumn("comparison", F.lit("*")).withColumn("IMID_status", F.lit(0)))
    fc = cut_lineage(fc)  # read by both passes
    times = cut_lineage(s.matched(score, long).groupBy("comparison", "IMID_status", *KEY)
                        .agg(F.count(F.lit(1)).alias("times")))
    treated = times.filter(F.col("IMID_status") == 1).drop("IMID_status")
    matched = times.filter(F.col("IMID_status") == 0).drop("IMID_status")
    cells_t = cut_lineage(BAL.arm_cells(ft.join(treated, ["comparison", *KEY], "left").fillna(0, ["times"]),
                                        "IMID_status", names, "times", group))
    cells_c = BAL.arm_cells(fc.drop("comparison").join(matched, KEY, "inner"), "IMID_status", names, "times", group)
    every = F.explode(F.array(*[F.lit(c) for c in comps]))
    before = BAL.weighted_stats(cells_t, "IMID_status", F.lit(1), group).unionByName(
        BAL.arm_stats(fc, "IMID_status", names, group).withColumn("comparison", every))
    after = BAL.weighted_stats(cells_t.unionByName(cells_c), "IMID_status", F.col("times"), group)
    return BAL.effect_from_stats(before, "IMID_status", group).withColumn("matching", F.lit("before")).unionByName(
        BAL.effect_from_stats(after, "IMID_status", group).withColumn("matching", F.lit("after")))


@query("effect_size_before_after")
def q_effect_size_before_after(spark, folder):
    s = Study.shared(spark, folder)
    return _r6(_balance(s, "px_score", ["IMID"]), ["effect_size"])


@query("balance_by_comparison")
def q_balance_by_comparison(spark, folder):
    s = Study.shared(spark, folder)
    return BAL.balance_table(_balance(s, "px_score", None), ["comparison"])


# ------------------------------------------------------------------ outcomes
@query("outcome_counts")
def q_outcome_counts(spark, folder):
    s = Study.shared(spark, folder)
    return O.outcome_counts(s.comparisons_long(), ["comparison", "IMID_status"])


def _unadjusted_long(s: Study) -> DataFrame:
    long = s.comparisons_long()
    t = O.outcome_counts(long.filter(F.col("IMID_status") == 1), ["comparison"])
    _, controls = s.arms
    # all controls serve every comparison: counted once, repeated per comparison
    c = O.outcome_counts(controls, []).withColumn(
        "comparison", F.explode(F.array(*[F.lit(x) for x in ["IMID", *IMIDS]])))
    return O.outcome_long(t, c, ["comparison"])


@query("relative_risk_ci")
def q_relative_risk_ci(spark, folder):
    from ..functions import stats as ST
    lg = _unadjusted_long(Study.shared(spark, folder))
    a, n1, c, n0 = F.col("a"), F.col("n1"), F.col("c"), F.col("n0")
    lo, hi = ST.katz_interval(a, n1, c, n0)
    return _r6(lg.select("comparison", "outcome", "a", "n1", "c", "n0",
                         ST.relative_risk(a, n1, c, n0).alias("rr"), lo.alias("lower"),
                         hi.alias("upper")), ["rr", "lower", "upper"])


@query("fisher_exact_p")
def q_fisher_exact_p(spark, folder):
    from ..functions import stats as ST
    lg = _unadjusted_long(Study.shared(spark, folder))
    p = ST.fisher_exact_two_sided(lg, ["comparison", "outcome"], "a", "n1", "c", "n0")
    return _r6(p, ["p_value"])


@query("outcomes_adjusted")
def q_outcomes_adjusted(spark, folder):
    return Study.shared(spark, folder).outcome_table("adjusted")


@query("outcomes_unadjusted")
def q_outcomes_unadjusted(spark, folder):
    return Study.shared(spark, folder).outcome_table("unadjusted")


@query("outcomes_sensitivity")
def q_outcomes_sensitivity(spark, folder):
    return Study.shared(spark, folder).outcome_table("sensitivity")


# ------------------------------------------------------------------ fitted scores
@query("propensity_score")
def q_propensity_score(spark, folder):
    """PS1: logistic fit on the overall comparison. Reported per covariate (and
    intercept): the sum of score x value, which at the optimum equals the sum of
    the treated rows' values. The area ranks are fractions and left out."""
    s = Study.shared(spark, folder)
    f, names = s.features(_overall(s))
    scored = propensity_score(f, "IMID_status", names).withColumn("intercept", F.lit(1))
    shown = ["intercept"] + [n for n in names if not n.startswith("RPL_")]
    sums = scored.agg(*[F.round(F.sum(F.col("propensity_score") * F.col(n)), 2).alias(n) for n in shown])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("variable"), F.col(n).alias("score_sum")) for n in shown])))


@query("psm_by_comparison")
def q_psm_by_comparison(spark, folder):
    """One logistic model per comparison (fitted together), then
    1-NN matching per comparison on the fitted score."""
    from .fitted import fitted_matches
    return fitted_matches(Study.shared(spark, folder))


@query("psm_fit_equations")
def q_psm_fit_equations(spark, folder):
    """O7's fits per comparison and covariate (and intercept): the sum of score x value, which
    at the optimum equals the sum of the treated rows' values. Area ranks are left out."""
    from ..operators.grouped_logit import score_sums
    from .fitted import fitted_models
    rows, weights, groups, names = fitted_models(Study.shared(spark, folder))
    sums = score_sums(rows, weights, groups, ["intercept", *names])
    return sums.where(~F.col("variable").startswith("RPL_")).withColumn("score_sum", F.round("score_sum", 2))


@query("psm_fitted_pairs")
def q_psm_fitted_pairs(spark, folder):
    """O7's matches per comparison: pairs, the sum of the query arm's ids, and whether every
    match is in the other arm."""
    from .fitted import fitted_matches
    m = fitted_matches(Study.shared(spark, folder))
    arm = lambda v, x: F.sum(F.when(F.col("IMID_status") == v, x))
    return m.groupBy("comparison").agg(arm(1, F.lit(1)).alias("n_treated"), arm(0, F.lit(1)).alias("n_controls"),
                                       arm(1, F.col("episode_id")).alias("treated_ids"))


@query("outcomes_fitted_counts")
def q_outcomes_fitted_counts(spark, folder):
    """O5-O7's tables from fitted scores, as far as the fit does not decide them: the arms'
    sizes and the treated arm's outcomes."""
    from .fitted import fitted_outcomes
    return fitted_outcomes(Study.shared(spark, folder), ("adjusted", "sensitivity")) \
        .select("analysis", "comparison", "outcome", "a", "n1", "n0")


@query("outcomes_fitted")
def q_outcomes_fitted(spark, folder):
    """O5-O7 end to end with fitted propensity scores (adjusted and
    sensitivity analyses; unadjusted needs no score)."""
    from .fitted import fitted_outcomes
    return fitted_outcomes(Study.shared(spark, folder), ("adjusted", "sensitivity"))


@query("nn_match_scaled")
def q_nn_match_scaled(spark, folder):
    s = Study.shared(spark, folder)
    long = _overall(s)
    treated = long.filter(F.col("IMID_status") == 1)
    controls = long.filter(F.col("IMID_status") == 0)
    return M.nn_match_scaled(treated, controls, ["px_score"], KEY)


MATCH_COLUMNS = ["px_score", "gestational_days", "age_at_start_dt", "pregravid_bmi"]


@query("nn_match_many")
def q_nn_match_many(spark, folder):
    """PS4/J13 on four standardised columns."""
    treated, controls = Study.shared(spark, folder).arms
    return M.nn_match_scaled(treated, controls, MATCH_COLUMNS, KEY)


@query("nn_match_many_raw")
def q_nn_match_many_raw(spark, folder):
    """PS4 without the scaler, on the columns as they are."""
    treated, controls = Study.shared(spark, folder).arms
    return M.nn_match_scaled(treated, controls, MATCH_COLUMNS[1:], KEY, scaled=False)
