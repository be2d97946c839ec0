"""DuckDB SQL for each registered query (same column names as the Spark side)."""

from __future__ import annotations

from cohortlab.sources.proxy import PROXY_RISK_FACTORS
from cohortlab.vocab import IMIDS

from .proxy_sql import with_ctes

ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, ctes: list[str]) -> None:
    ORACLE[name] = with_ctes(body, ctes)


_RF = ", ".join(PROXY_RISK_FACTORS)

# ------------------------------------------------------------------ diagnoses
oracle("scan_distinct_problemlist",
       "SELECT DISTINCT pat_id, dx_id, instance, NOTED_DATE, RESOLVED_DATE, DATE_OF_ENTRY "
       "FROM px_problemlist", ["px_problemlist"])
oracle("noted_date_fill", """
SELECT pat_id, dx_id, instance, NOTED_DATE, RESOLVED_DATE, DATE_OF_ENTRY,
  CASE WHEN NOTED_DATE IS NULL AND (RESOLVED_DATE IS NULL OR RESOLVED_DATE >= DATE_OF_ENTRY)
       THEN DATE_OF_ENTRY ELSE NOTED_DATE END AS new_noted_date
FROM px_problemlist""", ["px_problemlist"])
oracle("problemlist_clean", "SELECT * FROM d1_problemlist", ["d1_problemlist"])
oracle("diagnosis_full_outer", "SELECT * FROM d2_full_outer", ["d2_full_outer"])
oracle("diagnosis_contact_date", "SELECT * FROM d3_contact", ["d3_contact"])
oracle("diagnosis_concept_map", "SELECT * FROM d4_concept", ["d4_concept"])
oracle("diagnosis_full_name", "SELECT * FROM d5_full_name", ["d5_full_name"])
oracle("diagnosis_first_contact", "SELECT * FROM d6_first_contact", ["d6_first_contact"])
oracle("diag_snomed", "SELECT * FROM d7_snomed", ["d7_snomed"])
oracle("diagnosis_mapped_semi", """
SELECT * FROM d7_snomed d
WHERE d.dx_id IN (SELECT dx_id FROM px_dxmap) AND d.dx_id IN (SELECT dx_id FROM px_dx)""",
       ["d7_snomed", "px_dxmap", "px_dx"])

# ------------------------------------------------------------------ concepts, flags
oracle("concept_descendants", "SELECT * FROM c1_descendants", ["c1_descendants"])
oracle("risk_code_set", "SELECT * FROM c2_codes", ["c2_codes"])
oracle("concept_descendants_ordered", """
SELECT *, row_number() OVER (ORDER BY risk_factor NULLS FIRST, ancestor_snomed_code, min_levels_of_separation,
    descendant_concept_name NULLS FIRST, descendant_snomed_code, ancestor_concept_name NULLS FIRST) AS position,
  row_number() OVER (PARTITION BY risk_factor, ancestor_snomed_code ORDER BY min_levels_of_separation,
    descendant_concept_name NULLS FIRST, descendant_snomed_code, ancestor_concept_name NULLS FIRST) AS place
FROM c1_descendants""", ["c1_descendants"])
oracle("risk_flags_whole", "SELECT * FROM r_flags_whole", ["r_flags_whole"])
oracle("exposure_pivot_whole", "SELECT * FROM e_pivot_whole", ["e_pivot_whole"])
_IMIDS = ", ".join(IMIDS)
oracle("arms_from_flags", f"""
SELECT pat_id, instance, episode_id, 1 AS IMID_status, {_IMIDS}, CAST(n_exposures AS INTEGER) AS n_exposures
FROM w_cohort WHERE {" OR ".join(f"{i} = 1" for i in IMIDS)}
UNION ALL
SELECT pat_id, instance, episode_id, 0, {_IMIDS}, CAST(n_exposures AS INTEGER) FROM w_cohort b
WHERE NOT EXISTS (SELECT 1 FROM w_cohort t WHERE t.pat_id = b.pat_id AND t.instance = b.instance
  AND ({" OR ".join(f"t.{i} = 1" for i in IMIDS)}))""", ["w_cohort"])
oracle("active_interval_join", "SELECT * FROM r_hits", ["r_hits"])
oracle("risk_flags", "SELECT * FROM r_flags", ["r_flags"])
oracle("riskflags_instance_1000", "SELECT * FROM r_flags_1k", ["r_flags_1k"])

# ------------------------------------------------------------------ exposure
from cohortlab.sources.proxy import PROXY_MEDS  # noqa: E402

from .proxy_sql import EXPOSURE_FLAG_COLS  # noqa: E402

_ORDER_OUT = ("pat_id, instance, gestational_days, lmp, ob_delivery_delivery_date, "
              "start_date, end_date, route")
_MEDS = ", ".join(PROXY_MEDS)
_ANYMED = " OR ".join(f"{m} = 1" for m in PROXY_MEDS)

oracle("medication_overlap_join", """
SELECT c.pat_id, c.instance, c.gestational_days, c.lmp, c.ob_delivery_delivery_date,
  m.start_date, m.end_date, m.route, m.order_class, """ + ", ".join(f"m.{x}" for x in PROXY_MEDS) + """
FROM px_cohort c JOIN px_med m ON c.pat_id = m.pat_id AND c.instance = m.instance
  AND m.end_date > c.lmp AND m.start_date < c.ob_delivery_delivery_date""", ["px_cohort", "px_med"])
oracle("medication_orders", "SELECT * FROM e_orders", ["e_orders"])
oracle("medication_orders_routed", "SELECT * FROM e_orders_routed", ["e_orders_routed"])
oracle("filter_any_flag", f"SELECT * FROM px_med WHERE {_ANYMED}", ["px_med"])
oracle("med_argmax", f"SELECT {_ORDER_OUT}, {_MEDS}, med_name FROM e_rows", ["e_rows"])
oracle("exposure_period", f"SELECT {_ORDER_OUT}, orderstart_lmp, orderstart_lmp_period FROM e_rows",
       ["e_rows"])
oracle("exposure_durations", f"""
SELECT {_ORDER_OUT}, orderstart_lmp, orderend_lmp, exposure0_duration, exposure1_duration,
  exposure2_duration, exposure3_duration, clipped0_duration, clipped1_duration, clipped2_duration,
  clipped3_duration FROM e_rows""", ["e_rows"])
oracle("medinfo_exposure", f"""
SELECT {_ORDER_OUT}, orderstart_lmp, orderend_lmp, order_duration, orderstart_lmp_period,
  exposure0_duration, exposure1_duration, exposure2_duration, exposure3_duration,
  exposure_total_duration, exposure1_status, exposure2_status, exposure3_status,
  exposure_total_status, exposure0_status, med_name FROM e_rows_routed""", ["e_rows_routed"])
oracle("exposure_agg", """
SELECT pat_id, instance, lmp, gestational_days, med_name,
  CAST(SUM(exposure_total_duration) AS BIGINT) AS exposure_total_duration_sum,
  CAST(SUM(exposure1_duration) AS BIGINT) AS exposure1_duration_sum,
  CAST(SUM(exposure2_duration) AS BIGINT) AS exposure2_duration_sum,
  CAST(SUM(exposure3_duration) AS BIGINT) AS exposure3_duration_sum,
  MAX(exposure_total_status) AS exposure_total_status_max,
  MAX(exposure0_status) AS exposure0_status_max,
  MAX(exposure1_status) AS exposure1_status_max,
  MAX(exposure2_status) AS exposure2_status_max,
  MAX(exposure3_status) AS exposure3_status_max
FROM e_rows GROUP BY pat_id, instance, lmp, gestational_days, med_name""", ["e_rows"])
oracle("aggregate_data_sum_max", """
SELECT pat_id, instance, CAST(SUM(order_duration) AS BIGINT) AS order_duration_sum,
  MIN(orderstart_lmp) AS orderstart_lmp_min, MAX(exposure_total_status) AS exposure_total_status_max
FROM e_rows GROUP BY pat_id, instance""", ["e_rows"])
oracle("exposure_pivot", "SELECT * FROM e_pivot", ["e_pivot"])
oracle("cohort_with_exposure", "SELECT c.pat_id, c.instance, c.episode_id, c.lmp, c.gestational_days, "
       + ", ".join(f"COALESCE(p.{x}, 0) AS {x}" for x in EXPOSURE_FLAG_COLS) + """
FROM px_cohort c LEFT JOIN e_pivot p ON c.pat_id = p.pat_id AND c.instance = p.instance
  AND c.lmp = p.lmp AND c.gestational_days = p.gestational_days""", ["px_cohort", "e_pivot"])

# ------------------------------------------------------------------ cohort and arms
from cohortlab.sources.proxy import PROXY_MIN_DELIVERY_YEAR  # noqa: E402
from cohortlab.vocab import DELIVERY_CSECTION, DELIVERY_VAGINAL, IMIDS  # noqa: E402

from . import proxy_sql as P  # noqa: E402

_KEY = "pat_id, instance, episode_id"
_ANY = " OR ".join(f"{i} = 1" for i in IMIDS)
P.cte("pp_treated", f"SELECT * FROM px_pregnancy WHERE {_ANY}", ["px_pregnancy"])
P.cte("pp_controls", """
SELECT * FROM px_pregnancy b WHERE NOT EXISTS (SELECT 1 FROM pp_treated t
  WHERE t.pat_id = b.pat_id AND t.instance = b.instance)""", ["px_pregnancy", "pp_treated"])

oracle("filter_delivery_year", f"SELECT {_KEY}, delivery_year FROM px_pregnancy "
       f"WHERE delivery_year > {PROXY_MIN_DELIVERY_YEAR}", ["px_pregnancy"])
oracle("control_anti_join", f"SELECT {_KEY}, lmp FROM pp_controls", ["pp_controls"])
oracle("subcohort_by_flag", "\nUNION ALL ".join(
    f"SELECT {_KEY}, '{i}' AS comparison FROM px_pregnancy WHERE {i} = 1" for i in IMIDS),
    ["px_pregnancy"])
oracle("align_columns_union", f"""
SELECT {_KEY}, px_score, ibd FROM pp_controls
UNION ALL SELECT {_KEY}, px_score, ibd FROM pp_treated""", ["pp_controls", "pp_treated"])
oracle("arm_union", f"""
SELECT {_KEY}, px_score, CAST(NULL AS INTEGER) AS ibd, 0 AS IMID_status FROM pp_controls
UNION ALL SELECT {_KEY}, px_score, ibd, 1 AS IMID_status FROM pp_treated""",
       ["pp_controls", "pp_treated"])
oracle("cohort_counts", "SELECT count(DISTINCT pat_id) AS n_patients, count(*) AS n_rows "
       "FROM px_pregnancy", ["px_pregnancy"])
oracle("dedup_pregnancy_key", """
SELECT pat_id, instance, lmp, gestational_days, ob_hx_infant_sex, episode_id, px_score FROM (
  SELECT *, row_number() OVER (PARTITION BY pat_id, instance, lmp, gestational_days, ob_hx_infant_sex
                               ORDER BY episode_id) AS rn FROM px_pregnancy) WHERE rn = 1""",
       ["px_pregnancy"])
oracle("sink_roundtrip", "SELECT * FROM r_flags", ["r_flags"])

# ------------------------------------------------------------------ geography
oracle("geo_ruca", "SELECT * FROM pg_ruca2010revised", ["pg_ruca2010revised"])
oracle("geo_svi_tract", "SELECT * FROM pg_svi2018_us", ["pg_svi2018_us"])
oracle("geo_county_fips4", "SELECT * FROM pg_countytypologycodes2015 UNION ALL "
       "SELECT * FROM pg_urbaninfluencecodes2013",
       ["pg_countytypologycodes2015", "pg_urbaninfluencecodes2013"])
oracle("geo_county_fips5", "SELECT * FROM pg_svi2018_us_county UNION ALL "
       "SELECT * FROM pg_ruralurbancontinuumcodes2013",
       ["pg_svi2018_us_county", "pg_ruralurbancontinuumcodes2013"])
oracle("geo_zip_far", "SELECT * FROM pg_farcodeszip2010", ["pg_farcodeszip2010"])
oracle("geo_features", f"""
SELECT c.pat_id, c.instance, c.episode_id, g.value AS SecondaryRUCACode2010
FROM px_pregnancy c LEFT JOIN pg_ruca2010revised g ON c.pat_id = g.pat_id AND c.instance = g.instance""",
       ["px_pregnancy", "pg_ruca2010revised"])
oracle("categorize_ruca", f"""
SELECT State_County_Tract_FIPS_Code, SecondaryRUCACode2010,
  {P.RUCA_CAT.format(c='SecondaryRUCACode2010')} AS ruca_categorization
FROM geo_ruca2010revised""", ["geo_ruca2010revised"])
oracle("encode_ruca", f"""
SELECT State_County_Tract_FIPS_Code,
  {P.RUCA_CODE.format(c='(' + P.RUCA_CAT.format(c='SecondaryRUCACode2010') + ')')} AS ruca_code
FROM geo_ruca2010revised""", ["geo_ruca2010revised"])
oracle("svi_clean_sentinel", "SELECT FIPS, " + ", ".join(
    f"(round(CAST({P.SVI_CLEAN.format(c=c)} AS DOUBLE), 6) + 0.0) AS {c}"
    for c in ["RPL_THEMES", "RPL_THEME1", "RPL_THEME2", "RPL_THEME3", "RPL_THEME4"])
    + " FROM geo_svi2018_us", ["geo_svi2018_us"])

# ------------------------------------------------------------------ encoders
_RIN = "COALESCE(array_to_string(race, '|'), '') AS race_in"
oracle("encode_race", f"SELECT episode_id, {_RIN}, {P.RACE_FMT.format(r='race')} AS race_fmt "
       "FROM px_pregnancy", ["px_pregnancy"])
oracle("race_consolidate", f"SELECT episode_id, {_RIN}, "
       f"COALESCE(array_to_string({P.RACE_CONS.format(r='race')}, '|'), '') AS race_list "
       "FROM px_pregnancy", ["px_pregnancy"])
oracle("race_multiracial", f"""
SELECT episode_id, race_in, CASE WHEN race IS NULL THEN 'Unknown' WHEN len(c) = 1 THEN c[1]
  WHEN list_contains(c, 'Other') AND len(list_filter(c, lambda x: x <> 'Other')) = 1
    THEN list_filter(c, lambda x: x <> 'Other')[1]
  ELSE 'Multiracial' END AS race_fmt
FROM (SELECT episode_id, race, {_RIN}, {P.RACE_CONS.format(r='race')} AS c FROM px_pregnancy)""",
       ["px_pregnancy"])
oracle("ethnic_group_fmt", f"SELECT episode_id, ethnic_group, {P.ETH_FMT.format(e='ethnic_group')} "
       "AS ethnic_fmt FROM px_pregnancy", ["px_pregnancy"])
oracle("encode_parity", f"SELECT episode_id, Parity, {P.PARITY.format(p='Parity')} AS parity_code "
       "FROM px_pregnancy", ["px_pregnancy"])
oracle("encode_gravidity", f"SELECT episode_id, Gravidity, {P.GRAVIDITY.format(g='Gravidity')} "
       "AS gravidity_code FROM px_pregnancy", ["px_pregnancy"])
oracle("encode_preterm_history", f"SELECT episode_id, Preterm_history, gestational_days, "
       f"{P.PRETERM.format(h='Preterm_history', ga='gestational_days')} AS preterm_history_code "
       "FROM px_pregnancy", ["px_pregnancy"])
oracle("encode_bmi", f"SELECT episode_id, pregravid_bmi, {P.BMI.format(b='pregravid_bmi')} AS bmi_code "
       "FROM px_pregnancy", ["px_pregnancy"])
oracle("encode_age", f"SELECT episode_id, age_at_start_dt, {P.AGE.format(a='age_at_start_dt')} "
       "AS age_code FROM px_pregnancy", ["px_pregnancy"])
oracle("pval_signal", f"SELECT episode_id, (round(px_score, 6) + 0.0) AS p, {P.PSIG.format(p='px_score')} "
       "AS signal FROM px_pregnancy", ["px_pregnancy"])
_LABELS = DELIVERY_VAGINAL + DELIVERY_CSECTION + ["Unknown"]
_LIST = "[" + ", ".join(repr(x) for x in _LABELS) + "]"
oracle("encode_delivery_method", f"""
SELECT episode_id, delivery_label,
  CASE WHEN delivery_label IN ({", ".join(repr(x) for x in DELIVERY_VAGINAL)}) THEN 0
       WHEN delivery_label IN ({", ".join(repr(x) for x in DELIVERY_CSECTION)}) THEN 1 ELSE -1 END
  AS delivery_code
FROM (SELECT episode_id, list_element({_LIST}, CAST(episode_id % {len(_LABELS) + 1} + 1 AS INTEGER))
        AS delivery_label FROM px_pregnancy)""", ["px_pregnancy"])
oracle("year_one_hot", """
SELECT episode_id, delivery_year, 'year_' || CAST(y AS VARCHAR) AS indicator,
  CASE WHEN delivery_year = y THEN 1 ELSE 0 END AS value
FROM px_pregnancy, (SELECT DISTINCT delivery_year AS y FROM px_pregnancy WHERE delivery_year IS NOT NULL)""",
       ["px_pregnancy"])

# ------------------------------------------------------------------ imputation, features
_SVI4 = ["RPL_THEME1", "RPL_THEME2", "RPL_THEME3", "RPL_THEME4"]
oracle("median_impute_svi", f"""
SELECT l.pat_id, l.instance, l.episode_id, l.IMID_status, """ + ", ".join(
    f"(round(COALESCE(CAST(l.{c} AS DOUBLE), m.m_{c}), 6) + 0.0) AS {c}" for c in _SVI4) + f"""
FROM (SELECT * FROM s_long WHERE comparison = 'IMID') l JOIN (
  SELECT IMID_status, """ + ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _SVI4) + """
  FROM s_long WHERE comparison = 'IMID' GROUP BY IMID_status) m ON l.IMID_status = m.IMID_status""",
       ["s_long"])
_NUM = ["pregravid_bmi", "Parity", "Gravidity", "Preterm_history", "smoker", "illegal_drug_user"]
oracle("median_impute_all", f"SELECT {_KEY}, " + ", ".join(
    f"(round(COALESCE(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM px_pregnancy)), 6) + 0.0) AS {c}"
    for c in _NUM) + " FROM px_pregnancy", ["px_pregnancy"])
oracle("missingness_report", "SELECT IMID_status, " + ", ".join(
    f"(round(100.0 * SUM(CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE 1 END) / count(*), 1) + 0.0) AS pct_{c}"
    for c in _SVI4 + ["pregravid_bmi"])
    + " FROM s_long WHERE comparison = 'IMID' GROUP BY IMID_status", ["s_long"])
oracle("psm_features", "SELECT * EXCLUDE (comparison, delivery_year, RPL_THEME1, RPL_THEME2, RPL_THEME3, "
       "RPL_THEME4), COALESCE('year_' || CAST(delivery_year AS VARCHAR), '') AS years_set, "
       + ", ".join(f"(round({c}, 6) + 0.0) AS {c}" for c in _SVI4)
       + " FROM f_all WHERE comparison = 'IMID'", ["f_all"])

# ------------------------------------------------------------------ matching, balance
oracle("psm_match_1nn", "SELECT match_id, IMID_status, pat_id, instance, episode_id, score AS px_score "
       "FROM m_imid", ["m_imid"])
oracle("psm_match_reverse", "SELECT match_id, IMID_status, pat_id, instance, episode_id, "
       "score AS px_score FROM m_rev", ["m_rev"])
oracle("match_back_join", """
SELECT s.pat_id, s.instance, s.episode_id, s.lmp, s.preterm_category, s.LBW, s.SGA, s.delivery_method
FROM s_controls s JOIN (SELECT * FROM m_all WHERE comparison = 'IMID' AND IMID_status = 0) m
  ON s.pat_id = m.pat_id AND s.instance = m.instance AND s.episode_id = m.episode_id""",
       ["s_controls", "m_all"])
oracle("cohen_d", "SELECT variable, (round(effect_size, 6) + 0.0) AS effect_size FROM es_before "
       "WHERE comparison = 'IMID'", ["es_before"])
oracle("effect_size_before_after", """
SELECT comparison, variable, (round(effect_size, 6) + 0.0) AS effect_size, 'before' AS matching
FROM es_before WHERE comparison = 'IMID'
UNION ALL SELECT comparison, variable, (round(effect_size, 6) + 0.0) AS effect_size, 'after' AS matching
FROM es_after WHERE comparison = 'IMID'""", ["es_before", "es_after"])
oracle("balance_by_comparison", "SELECT comparison, variable, round(effect_size, 2) + 0.0 AS effect_size "
       "FROM es_after", ["es_after"])

oracle("propensity_score", "SELECT variable, score_sum FROM f_sums", ["f_sums"])

oracle("psm_fit_equations", f"""
SELECT comparison, variable, CAST(SUM(IMID_status * value) AS DOUBLE) AS score_sum
FROM ({P.long_sql("f_all")}) WHERE NOT starts_with(variable, 'RPL_') GROUP BY comparison, variable
UNION ALL SELECT comparison, 'intercept', CAST(SUM(IMID_status) AS DOUBLE) FROM f_all GROUP BY comparison""",
       ["f_all", "s_years"])
# the smaller arm queries: its rows are matched once each; a reversed comparison (controls no
# more than treated) has as many pairs as controls, and its treated rows come from the fit
oracle("psm_fitted_pairs", """
SELECT comparison, least(n1, n0) AS n_treated, least(n1, n0) AS n_controls, ids AS treated_ids
FROM (SELECT comparison, count(*) FILTER (WHERE IMID_status = 1) AS n1, count(*) FILTER (WHERE IMID_status = 0) AS n0,
        CAST(SUM(episode_id) FILTER (WHERE IMID_status = 1) AS BIGINT) AS ids FROM s_long GROUP BY comparison)""", ["s_long"])
oracle("outcomes_fitted_counts", """
SELECT analysis, comparison, outcome, a, n1, n0 FROM (
  SELECT 'adjusted' AS analysis, * FROM o_adjusted UNION ALL SELECT 'sensitivity' AS analysis, * FROM o_sensitivity)""",
       ["o_adjusted", "o_sensitivity"])

# ------------------------------------------------------------------ outcomes
oracle("outcome_counts", f"SELECT comparison, IMID_status, {P.OUTCOME_AGGS} FROM s_long "
       "GROUP BY comparison, IMID_status", ["s_long"])
oracle("relative_risk_ci", """
SELECT comparison, outcome, a, n1, c, n0, (round(rr, 6) + 0.0) AS rr, (round(lower, 6) + 0.0) AS lower,
  (round(upper, 6) + 0.0) AS upper FROM o_unadj_s_ci""", ["o_unadj_s_ci"])
oracle("fisher_exact_p", "SELECT comparison, outcome, (round(p_value, 6) + 0.0) AS p_value "
       "FROM o_unadj_s_fisher", ["o_unadj_s_fisher"])
oracle("outcomes_adjusted", "SELECT *, 'adjusted' AS analysis FROM o_adjusted", ["o_adjusted"])
oracle("outcomes_unadjusted", "SELECT *, 'unadjusted' AS analysis FROM o_unadjusted", ["o_unadjusted"])
oracle("outcomes_sensitivity", "SELECT *, 'sensitivity' AS analysis FROM o_sensitivity",
       ["o_sensitivity"])
oracle("nn_match_scaled", "SELECT match_id, pat_id, instance, episode_id, score AS px_score "
       "FROM m_imid_nn WHERE IMID_status = 0", ["m_imid_nn"])


def nearest_sql(columns: list[str], scaled: bool) -> str:
    """Every treated row against every control: the nearest, ties by the lowest key."""
    weights = ", ".join(f"CASE WHEN {v} > 0 THEN 1.0 / {v} ELSE 1.0 END AS w{i}" if scaled else f"CAST(max(1.0) AS DOUBLE) AS w{i}"
                        for i, v in enumerate(f"var_pop({c})" for c in columns))
    square = " + ".join(f"(w{i} * (t.{c} - c.{c})) * (t.{c} - c.{c})" for i, c in enumerate(columns))
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    names = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"""
, n_t AS (SELECT pat_id, instance, episode_id, {names} FROM s_treated WHERE {known}),
n_c AS (SELECT pat_id, instance, episode_id, {names} FROM s_controls WHERE {known}),
n_w AS (SELECT {weights} FROM (SELECT {names} FROM s_treated UNION ALL SELECT {names} FROM s_controls)),
n_best AS (SELECT t.pat_id, t.instance, t.episode_id, MIN(ROW({square}, c.pat_id, c.instance, c.episode_id)) AS best
  FROM n_t t, n_c c, n_w GROUP BY t.pat_id, t.instance, t.episode_id)
SELECT b.episode_id AS match_id, c.* FROM n_best b JOIN n_c c
  ON c.pat_id = b.best[2] AND c.instance = b.best[3] AND c.episode_id = b.best[4]"""


_MATCH_COLUMNS = ["px_score", "gestational_days", "age_at_start_dt", "pregravid_bmi"]
oracle("nn_match_many", nearest_sql(_MATCH_COLUMNS, True), ["s_treated", "s_controls"])
oracle("nn_match_many_raw", nearest_sql(_MATCH_COLUMNS[1:], False), ["s_treated", "s_controls"])
