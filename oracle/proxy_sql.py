"""Proxy views and study stages as DuckDB SQL, for the correctness oracle.

Written independently of the Spark code from FIXTURES.md section 2 and the
study's semantics. ``with_ctes(body, names)`` prefixes the body with the
WITH-clause for the named views and everything they depend on.
"""

from __future__ import annotations

from cohortlab.sources.proxy import PROXY_MEDS, PROXY_MIN_DELIVERY_YEAR, PROXY_RISK_FACTORS
from cohortlab.vocab import IMIDS, MEDICATIONS, RISK_FACTORS

_CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    _CTES[name] = (sql, deps or [])


def with_ctes(body: str, names: list[str]) -> str:
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = [f"{n} AS (\n{_CTES[n][0]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body


INST = "CAST(1000 + {c} % 2 AS INTEGER)"

# ------------------------------------------------------------------ patients / geo
cte("px_patient", f"""
SELECT c_custkey AS pat_id, {INST.format(c='c_custkey')} AS instance,
  CASE WHEN c_nationkey = 5 THEN 'CA' ELSE 'S' || CAST(c_nationkey AS VARCHAR) END AS PATIENT_STATE_CD,
  lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 3 + 1 AS VARCHAR), 3, '0')
    || lpad(CAST(c_custkey % 7 + 1 AS VARCHAR), 6, '0') || '1' AS PATIENT_ADDR_CENSUS_BLOCKGROUP_DERIVED,
  lpad(CAST(c_custkey % 60 + 1 AS VARCHAR), 5, '0') || '-0001' AS ZIP
FROM customer""")

cte("px_tracts", """
SELECT n, county, tract, n + 3 * county + tract AS x,
       (n + 1) * 1000000000 + county * 1000000 + tract AS fips_num
FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) nn,
     (SELECT CAST(g AS BIGINT) AS county FROM generate_series(1, 3) s(g)) cc,
     (SELECT CAST(g AS BIGINT) AS tract FROM generate_series(1, 7) s(g)) tt""")


def _theme(k: int) -> str:
    return (f"CASE WHEN x % 9 = 0 THEN CAST(-999 AS DOUBLE) "
            f"ELSE CAST((x * {k} * 7) % 100 AS DOUBLE) / 100.0 END")


cte("geo_ruca2010revised", """
SELECT fips_num AS State_County_Tract_FIPS_Code,
  CASE WHEN x % 13 = 0 THEN CAST(99 AS DOUBLE) ELSE CAST(x % 12 + 1 AS DOUBLE) END AS SecondaryRUCACode2010
FROM px_tracts""", ["px_tracts"])

cte("geo_svi2018_us", f"""
SELECT lpad(CAST(fips_num AS VARCHAR), 11, '0') AS FIPS, {_theme(5)} AS RPL_THEMES,
  {_theme(1)} AS RPL_THEME1, {_theme(2)} AS RPL_THEME2, {_theme(3)} AS RPL_THEME3,
  {_theme(4)} AS RPL_THEME4
FROM px_tracts""", ["px_tracts"])

cte("px_counties", """
SELECT n, county, (n + 1) * 1000 + county AS fips_num
FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) nn,
     (SELECT CAST(g AS BIGINT) AS county FROM generate_series(1, 3) s(g)) cc""")

cte("geo_countytypologycodes2015", """
SELECT fips_num AS FIPStxt, CAST((n + county) % 6 AS INTEGER) AS Economic_Type FROM px_counties""",
    ["px_counties"])
cte("geo_urbaninfluencecodes2013", """
SELECT fips_num AS FIPStxt, CAST((n + 2 * county) % 12 + 1 AS INTEGER) AS UIC_2013 FROM px_counties""",
    ["px_counties"])
cte("geo_svi2018_us_county", """
SELECT fips_num AS FIPS, CAST((n * 7 + county * 3) % 100 AS DOUBLE) / 100.0 AS RPL_THEMES_COUNTY
FROM px_counties""", ["px_counties"])
cte("geo_ruralurbancontinuumcodes2013", """
SELECT fips_num AS FIPS, CAST((n + county) % 9 + 1 AS INTEGER) AS RUCC_2013 FROM px_counties""",
    ["px_counties"])
cte("geo_farcodeszip2010", """
SELECT lpad(CAST(z AS VARCHAR), 5, '0') AS ZIP, CAST(z % 2 AS INTEGER) AS FAR_LEVEL1
FROM (SELECT DISTINCT c_custkey % 50 + 1 AS z FROM customer)""")

# ------------------------------------------------------------------ pregnancies
_race = {1: "['White']", 2: "['White or Caucasian']", 3: "['Asian']",
         4: "['Black or African American']", 5: "['White', 'Asian']", 6: "['Declined']",
         7: "['Other']", 8: "['American Indian or Alaska Native']"}
_eth = {1: "Unknown_NotReported", 2: "Hispanic_Latino", 3: "Not_Hispanic_Latino"}
_sex = {1: "Male", 2: "Female", 3: "Other", 4: "Unknown"}
_ins = {1: "Medicaid", 2: "Medicare", 3: "Uninsured-Self-Pay", 4: "Other", 5: "Commercial"}


def _case(sel: str, m: dict, quote: bool = True) -> str:
    whens = " ".join(f"WHEN {k} THEN {repr(v) if quote else v}" for k, v in m.items())
    return f"CASE {sel} {whens} END"


_imid_cols = ",\n  ".join(
    f"CAST((o_custkey * 13 + {11 * k} + o_orderkey % 2) % 97 = 0 AS INTEGER) AS {name}"
    for k, name in enumerate(IMIDS))

cte("px_pregnancy", f"""
SELECT o_custkey AS pat_id, {INST.format(c='o_custkey')} AS instance, o_orderkey AS episode_id,
  CAST(o_orderdate AS DATE) AS lmp,
  CAST(180 + o_orderkey % 110 AS INTEGER) AS gestational_days,
  CAST(o_orderdate AS DATE) + CAST(180 + o_orderkey % 110 AS INTEGER) AS ob_delivery_delivery_date,
  CAST(year(CAST(o_orderdate AS DATE) + CAST(180 + o_orderkey % 110 AS INTEGER)) AS INTEGER) AS delivery_year,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       ELSE 12.0 + CAST(o_orderkey % 331 AS DOUBLE) / 10.0 END AS pregravid_bmi,
  CAST(16 + (o_orderkey * 7) % 34 AS DOUBLE) AS age_at_start_dt,
  {_case('o_custkey % 6', _ins)} AS insurance,
  {_case('o_orderkey % 9', _race, quote=False)} AS race,
  {_case('o_orderkey % 4', _eth)} AS ethnic_group,
  {_case('o_orderkey % 5', _sex)} AS ob_hx_infant_sex,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS INTEGER) END AS Parity,
  CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS INTEGER) END AS Gravidity,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INTEGER) END AS Preterm_history,
  CASE WHEN o_custkey % 14 = 0 THEN NULL ELSE CAST(o_custkey % 2 AS INTEGER) END AS illegal_drug_user,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INTEGER) END AS smoker,
  CASE WHEN 180 + o_orderkey % 110 < 259 THEN 'preterm' ELSE 'term' END AS preterm_category,
  CASE WHEN o_orderkey % 8 = 0 THEN 'SGA' ELSE 'AGA' END AS SGA,
  CASE WHEN o_totalprice < 60000 THEN 'LBW' ELSE 'NBW' END AS LBW,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'c-section' ELSE 'vaginal' END AS delivery_method,
  'live birth' AS pregnancy_outcome,
  {_imid_cols},
  CAST((o_orderkey * 7919 + o_custkey * 31) % 100003 AS DOUBLE) / 100003.0 AS px_score,
  CAST((o_orderkey * 104729 + o_custkey * 17) % 100003 AS DOUBLE) / 100003.0 AS px_score_sa
FROM orders""")

cte("px_cohort", "SELECT *, lmp AS decided_index_date FROM px_pregnancy", ["px_pregnancy"])

# ------------------------------------------------------------------ medication orders
_med_flags = ",\n  ".join(
    (f"CAST(lower(p_type) = '{m}' OR p_size % 10 = 0 AS INTEGER) AS {m}" if m == "promo"
     else f"CAST(lower(p_type) = '{m}' AS INTEGER) AS {m}") for m in PROXY_MEDS)
cte("px_med", f"""
SELECT o_custkey AS pat_id, {INST.format(c='o_custkey')} AS instance,
  CAST(l_shipdate AS DATE) AS start_date,
  CAST(l_shipdate AS DATE) + CAST(l_quantity * 4 AS INTEGER) AS end_date,
  CASE l_returnflag WHEN 'A' THEN 'Oral' WHEN 'R' THEN 'Rectal' WHEN 'N' THEN 'Topical' END AS route,
  CASE l_linestatus WHEN 'F' THEN 'Historical Med' WHEN 'O' THEN 'Normal' END AS order_class,
  {_med_flags}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")

_whole_flags = ",\n  ".join(
    f"CAST(p_partkey % 37 = {i} OR (p_size % 10 = 0 AND p_partkey % 37 = {(i + 7) % 37}) AS INTEGER) AS {m}"
    for i, m in enumerate(MEDICATIONS))
cte("px_med_whole", _CTES["px_med"][0].replace(_med_flags, _whole_flags))

# ------------------------------------------------------------------ diagnosis sources
cte("px_problemlist", f"""
SELECT o_custkey AS pat_id, l_partkey AS dx_id, {INST.format(c='o_custkey')} AS instance,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS NOTED_DATE,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + 180 END AS RESOLVED_DATE,
  CAST(l_shipdate AS DATE) + CAST(l_quantity - 25 AS INTEGER) AS DATE_OF_ENTRY
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag = 'A' OR (l_returnflag = 'N' AND l_orderkey % 2 = 0)""")

cte("px_encdx", f"""
SELECT o_custkey AS pat_id, {INST.format(c='o_custkey')} AS instance, l_partkey AS dx_id,
  l_orderkey AS PAT_ENC_CSN_ID, p_name AS DIAGNOSISNAME
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' OR (l_returnflag = 'N' AND l_orderkey % 2 = 1)""")

cte("px_encounter", f"""
SELECT o_custkey AS pat_id, {INST.format(c='o_custkey')} AS instance, o_orderkey AS PAT_ENC_CSN_ID,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS CONTACT_DATE
FROM orders""")

PCODE = ("(CASE WHEN p_partkey % 50 = 7 THEN 'OMOP' || CAST(p_partkey AS VARCHAR) "
         "ELSE CAST(p_partkey AS VARCHAR) END)")

cte("px_concept_map", f"""
SELECT p_partkey AS value,
  CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS name,
  inst.instance,
  (CASE WHEN p_partkey % 10 = 0 THEN 'ICD-10#' ELSE 'SNOMED#' END) || {PCODE} AS concept
FROM part, (VALUES (1000), (1001)) inst(instance)""")

cte("px_concept", f"""
SELECT DISTINCT * FROM (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS concept_id, {PCODE} AS concept_code,
         p_name AS concept_name,
         CASE WHEN p_partkey % 23 = 0 THEN 'ICD10CM' ELSE 'SNOMED' END AS vocabulary_id FROM part
  UNION ALL SELECT 'B' || p_type || '/' || p_brand, p_type || '/' || p_brand,
         p_type || ' ' || p_brand, 'SNOMED' FROM part
  UNION ALL SELECT 'T' || p_type, p_type, p_type, 'SNOMED' FROM part)""")

_P, _B, _T = "'P' || CAST(p_partkey AS VARCHAR)", "'B' || p_type || '/' || p_brand", "'T' || p_type"
cte("px_ancestor", f"""
SELECT DISTINCT * FROM (
  SELECT {_P} AS ancestor_concept_id, {_P} AS descendant_concept_id, 0 AS min_levels_of_separation FROM part
  UNION ALL SELECT {_B}, {_P}, 1 FROM part
  UNION ALL SELECT {_T}, {_P}, 2 FROM part
  UNION ALL SELECT {_B}, {_B}, 0 FROM part
  UNION ALL SELECT {_T}, {_B}, 1 FROM part
  UNION ALL SELECT {_T}, {_T}, 0 FROM part)""")

_TYPE_NO = ("CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 "
            "WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END")


def registry_sql(suffix: str, factors: list[str]) -> None:
    names = "[" + ", ".join(f"'{f}'" for f in factors) + "]"
    name = f"{names}[1 + (({_TYPE_NO}) * 25 + CAST(substring(p_brand, 7, 3) AS INTEGER) - 1) % {len(factors)}]"
    cte(f"px_registry{suffix}", f"""
SELECT DISTINCT {name} AS risk_factor, p_type || '/' || p_brand AS concept_code FROM part""")
    cte(f"px_patch{suffix}", f"""
SELECT {name} AS risk_factor, {PCODE} AS concept_code FROM part WHERE p_partkey % 17 = 0""")


registry_sql("", PROXY_RISK_FACTORS)
registry_sql("_whole", RISK_FACTORS)
cte("px_dxmap", "SELECT p_partkey AS dx_id FROM part WHERE p_size > 2")
cte("px_dx", "SELECT p_partkey AS dx_id FROM part WHERE p_size < 49")

# ------------------------------------------------------------------ diagnosis chain
FILL = ("CASE WHEN {n} IS NULL AND ({r} IS NULL OR {r} >= {c}) THEN {c} ELSE {n} END")

cte("d1_problemlist", f"""
SELECT DISTINCT pat_id, dx_id, instance, RESOLVED_DATE,
  {FILL.format(n='NOTED_DATE', r='RESOLVED_DATE', c='DATE_OF_ENTRY')} AS NOTED_DATE
FROM px_problemlist""", ["px_problemlist"])

cte("d2_full_outer", """
SELECT DISTINCT COALESCE(p.pat_id, e.pat_id) AS pat_id, COALESCE(p.dx_id, e.dx_id) AS dx_id,
  COALESCE(p.instance, e.instance) AS instance, e.PAT_ENC_CSN_ID, p.NOTED_DATE, p.RESOLVED_DATE,
  e.DIAGNOSISNAME
FROM d1_problemlist p FULL OUTER JOIN
  (SELECT DISTINCT pat_id, instance, dx_id, PAT_ENC_CSN_ID, DIAGNOSISNAME FROM px_encdx) e
ON p.pat_id = e.pat_id AND p.dx_id = e.dx_id AND p.instance = e.instance""",
    ["d1_problemlist", "px_encdx"])

cte("d3_contact", """
SELECT DISTINCT d.pat_id, d.dx_id, d.instance, e.CONTACT_DATE, d.NOTED_DATE, d.RESOLVED_DATE,
  d.DIAGNOSISNAME
FROM d2_full_outer d LEFT JOIN
  (SELECT DISTINCT pat_id, instance, PAT_ENC_CSN_ID, CONTACT_DATE FROM px_encounter) e
ON d.pat_id = e.pat_id AND d.PAT_ENC_CSN_ID = e.PAT_ENC_CSN_ID AND d.instance = e.instance""",
    ["d2_full_outer", "px_encounter"])

cte("d4_concept", """
SELECT DISTINCT d.pat_id, d.dx_id, d.instance, d.CONTACT_DATE, d.NOTED_DATE, d.RESOLVED_DATE,
  d.DIAGNOSISNAME, m.name, m.concept
FROM d3_contact d LEFT JOIN
  (SELECT DISTINCT value, name, instance, concept FROM px_concept_map) m
ON d.dx_id = m.value AND d.instance = m.instance""", ["d3_contact", "px_concept_map"])

cte("d5_full_name", """
SELECT pat_id, dx_id, instance, CONTACT_DATE, NOTED_DATE, RESOLVED_DATE, concept,
  CASE WHEN contains(DIAGNOSISNAME, name) THEN DIAGNOSISNAME
       ELSE DIAGNOSISNAME || '_' || name END AS full_diagnosis_name
FROM d4_concept""", ["d4_concept"])

cte("d6_first_contact", f"""
SELECT DISTINCT pat_id, dx_id, instance, full_diagnosis_name AS diagnosis_name,
  {FILL.format(n='NOTED_DATE', r='RESOLVED_DATE', c='CONTACT_DATE')} AS noted_date,
  RESOLVED_DATE, concept
FROM (SELECT *, row_number() OVER (
        PARTITION BY pat_id, dx_id, instance, full_diagnosis_name
        ORDER BY CONTACT_DATE ASC NULLS FIRST, concept ASC NULLS FIRST,
                 NOTED_DATE ASC NULLS FIRST, RESOLVED_DATE ASC NULLS FIRST) AS rn
      FROM d5_full_name) WHERE rn = 1""", ["d5_full_name"])

cte("d7_snomed", """
SELECT pat_id, dx_id, instance, diagnosis_name, noted_date, RESOLVED_DATE AS resolved_date, concept,
  substring(concept, 8, length(concept)) AS SNOMED_ids
FROM d6_first_contact WHERE contains(lower(concept), 'snomed')""", ["d6_first_contact"])

# ------------------------------------------------------------------ concept sets, flags
cte("c1_descendants", """
SELECT r.risk_factor, a.concept_code AS ancestor_snomed_code, a.concept_name AS ancestor_concept_name,
  d.concept_code AS descendant_snomed_code, d.concept_name AS descendant_concept_name,
  ca.min_levels_of_separation
FROM px_registry r
JOIN px_concept a ON a.concept_code = r.concept_code AND a.vocabulary_id = 'SNOMED'
JOIN px_ancestor ca ON a.concept_id = ca.ancestor_concept_id
JOIN px_concept d ON ca.descendant_concept_id = d.concept_id""",
    ["px_registry", "px_concept", "px_ancestor"])

cte("c2_codes", """
SELECT DISTINCT risk_factor, descendant_snomed_code AS code FROM c1_descendants c
WHERE NOT starts_with(descendant_snomed_code, 'OMOP')
  AND NOT EXISTS (SELECT 1 FROM px_patch p WHERE p.risk_factor = c.risk_factor
                  AND p.concept_code = c.descendant_snomed_code)""", ["c1_descendants", "px_patch"])


def intervals_sql(only_1k: bool) -> str:
    extra = " AND d.instance = 1000" if only_1k else ""
    return f"""
SELECT DISTINCT d.pat_id, d.instance, d.noted_date, d.resolved_date, c.risk_factor
FROM d7_snomed d JOIN c2_codes c ON d.SNOMED_ids = c.code
WHERE d.dx_id IN (SELECT dx_id FROM px_dxmap) AND d.dx_id IN (SELECT dx_id FROM px_dx){extra}"""


cte("r_intervals", intervals_sql(False), ["d7_snomed", "c2_codes", "px_dxmap", "px_dx"])
cte("r_intervals_1k", intervals_sql(True), ["d7_snomed", "c2_codes", "px_dxmap", "px_dx"])


def hits_sql(iv: str) -> str:
    return f"""
SELECT DISTINCT k.pat_id, k.instance, k.decided_index_date, i.risk_factor
FROM px_cohort k JOIN {iv} i ON k.pat_id = i.pat_id AND k.instance = i.instance
  AND (k.decided_index_date >= i.noted_date OR i.noted_date IS NULL)
  AND (k.decided_index_date <= i.resolved_date OR i.resolved_date IS NULL)"""


cte("r_hits", hits_sql("r_intervals"), ["px_cohort", "r_intervals"])
cte("r_hits_1k", hits_sql("r_intervals_1k"), ["px_cohort", "r_intervals_1k"])


def flags_sql(hits: str, factors=PROXY_RISK_FACTORS) -> str:
    cols = ",\n  ".join(
        f"CAST(COALESCE(MAX(CASE WHEN h.risk_factor = '{f}' THEN 1 END), 0) AS INTEGER) AS {f}"
        for f in factors)
    return f"""
SELECT c.pat_id, c.instance, c.episode_id, c.decided_index_date,
  {cols}
FROM px_cohort c LEFT JOIN {hits} h ON c.pat_id = h.pat_id AND c.instance = h.instance
  AND c.decided_index_date IS NOT DISTINCT FROM h.decided_index_date
GROUP BY c.pat_id, c.instance, c.episode_id, c.decided_index_date"""


cte("r_flags", flags_sql("r_hits"), ["px_cohort", "r_hits"])
cte("r_flags_1k", flags_sql("r_hits_1k"), ["px_cohort", "r_hits_1k"])

# the whole vocabulary: 85 conditions, and the 12 diseases as R1 flags them
for _name, _deps in (("c1_descendants", ["px_registry"]), ("c2_codes", ["c1_descendants", "px_patch"]),
                     ("r_intervals", ["c2_codes"]), ("r_hits", ["r_intervals"])):
    _sql, _own = _CTES[_name]
    for _d in _deps:
        _sql = _sql.replace(f"{_d} ", f"{_d}_whole ")
    cte(f"{_name}_whole", _sql, [f"{d}_whole" if d in _deps else d for d in _own])
_PREGNANCY_KEY = "pat_id, instance, episode_id, decided_index_date"
cte("r_flags_whole", flags_sql("r_hits_whole", RISK_FACTORS), ["px_cohort", "r_hits_whole"])

# ------------------------------------------------------------------ exposure
def orders_sql(cohort: str, routed: bool, meds: list[str] = PROXY_MEDS, table: str = "px_med") -> str:
    any_med = " OR ".join(f"m.{m} = 1" for m in meds)
    columns = ", ".join(f"m.{m}" for m in meds)
    route = (" AND m.route IN ('Oral', 'Intramuscular', 'Intravenous', 'Subcutaneous Infusion', "
             "'Subcutaneous', 'Intravenous (Continuous Infusion)', 'Rectal')") if routed else ""
    return f"""
SELECT DISTINCT c.pat_id, c.instance, c.gestational_days, c.lmp, c.ob_delivery_delivery_date,
  m.start_date, m.end_date, m.route, {columns}
FROM {cohort} c JOIN {table} m ON c.pat_id = m.pat_id AND c.instance = m.instance
  AND m.end_date > c.lmp AND m.start_date < c.ob_delivery_delivery_date
WHERE ({any_med}) AND m.order_class <> 'Historical Med'{route}"""


_ANY_IMID = " OR ".join(f"{i} = 1" for i in IMIDS)
cte("px_imid_cohort", f"SELECT * FROM px_cohort WHERE {_ANY_IMID}", ["px_cohort"])
cte("e_orders", orders_sql("px_cohort", False), ["px_cohort", "px_med"])
cte("e_orders_routed", orders_sql("px_imid_cohort", True), ["px_imid_cohort", "px_med"])

D0 = """CASE WHEN s < -180 AND e < -180 THEN 0
  WHEN s < -180 AND e >= -180 AND e < 0 THEN e - 180 + 1
  WHEN s < -180 AND e >= 0 THEN 180
  WHEN s >= -180 AND s < 0 AND e >= -180 AND e < 0 THEN e - s + 1
  WHEN s >= -180 AND s < 0 AND e >= 0 THEN 0 - s + 1
  WHEN s >= 0 AND e >= 0 THEN 0 ELSE NULL END"""
D1 = """CASE WHEN s < 0 AND e < 0 THEN 0
  WHEN s < 0 AND e >= 0 AND e < 84 THEN e + 1
  WHEN s < 0 AND e >= 84 THEN 84
  WHEN s >= 0 AND s < 84 AND e >= 0 AND e < 84 THEN e - s + 1
  WHEN s >= 0 AND s < 84 AND e >= 84 THEN 84 - s + 1
  ELSE 0 END"""
D2 = """CASE WHEN s < 84 AND e < 84 THEN 0
  WHEN s < 84 AND e >= 84 AND e < 189 THEN e - 84 + 1
  WHEN s >= 91 AND s < 189 AND e >= 84 AND e < 189 THEN e - s + 1
  WHEN s < 84 AND e >= 189 THEN 105
  WHEN s >= 84 AND s < 189 AND e >= 189 THEN 189 - s + 1
  ELSE 0 END"""
D3 = """CASE WHEN s < 189 AND e < 189 THEN 0
  WHEN s < 189 AND e >= 189 AND e <= ga THEN e - 189 + 1
  WHEN s < 189 AND ga >= 189 AND ga <= e THEN ga - 189 + 1
  WHEN s >= 189 AND s <= ga AND e >= 189 AND e <= ga THEN e - s + 1
  WHEN s >= 189 AND s <= ga AND e >= ga THEN ga - s + 1
  ELSE 0 END"""
PERIOD = """CASE WHEN s < -180 THEN -1 WHEN s < 0 THEN 0 WHEN s < 84 THEN 1 WHEN s < 189 THEN 2
  WHEN s <= 320 THEN 3 WHEN s > 320 THEN 4 END"""
CLIP = "CAST(greatest(0, least(e, {hi}) - greatest(s, {lo}) + 1) AS INTEGER)"


def rows_sql(orders: str, meds: list[str] = PROXY_MEDS) -> str:
    med_name = "CASE " + " ".join(f"WHEN {m} = 1 THEN '{m}'" for m in meds) + " END"
    return f"""
SELECT *,
  CASE WHEN exposure1_duration > 0 THEN 1 ELSE 0 END AS exposure1_status,
  CASE WHEN exposure2_duration > 0 THEN 1 ELSE 0 END AS exposure2_status,
  CASE WHEN exposure3_duration > 0 THEN 1 ELSE 0 END AS exposure3_status,
  CASE WHEN exposure_total_duration > 0 THEN 1 ELSE 0 END AS exposure_total_status,
  CASE WHEN exposure0_duration > 0 THEN 1 ELSE 0 END AS exposure0_status
FROM (
  SELECT *, exposure1_duration + exposure2_duration + exposure3_duration AS exposure_total_duration
  FROM (
    SELECT o.*, s AS orderstart_lmp, e AS orderend_lmp, order_duration,
      {PERIOD} AS orderstart_lmp_period,
      CAST({D0} AS INTEGER) AS exposure0_duration,
      CAST({D1} AS INTEGER) AS exposure1_duration,
      CAST({D2} AS INTEGER) AS exposure2_duration,
      CAST({D3} AS INTEGER) AS exposure3_duration,
      {CLIP.format(lo=-180, hi=-1)} AS clipped0_duration,
      {CLIP.format(lo=0, hi=83)} AS clipped1_duration,
      {CLIP.format(lo=84, hi=188)} AS clipped2_duration,
      {CLIP.format(lo=189, hi='ga')} AS clipped3_duration,
      {med_name} AS med_name
    FROM (SELECT *, CAST(date_diff('day', lmp, start_date) AS INTEGER) AS s,
            CAST(date_diff('day', lmp, end_date) AS INTEGER) AS e,
            gestational_days AS ga,
            CAST(date_diff('day', start_date, end_date) + 1 AS INTEGER) AS order_duration
          FROM {orders}) o))"""


cte("e_rows", rows_sql("e_orders"), ["e_orders"])
cte("e_rows_routed", rows_sql("e_orders_routed"), ["e_orders_routed"])

_STATUSES = ["exposure_total_status", "exposure0_status", "exposure1_status",
             "exposure2_status", "exposure3_status"]


def pivot_sql(rows: str, meds: list[str]) -> str:
    columns = ",\n  ".join(
        f"CAST(COALESCE(MAX(CASE WHEN med_name = '{m}' THEN {st} END), 0) AS INTEGER) AS {m}_{st}"
        for m in meds for st in _STATUSES)
    return f"""
SELECT pat_id, instance, lmp, gestational_days,
  {columns}
FROM {rows} GROUP BY pat_id, instance, lmp, gestational_days"""


cte("e_pivot", pivot_sql("e_rows", PROXY_MEDS), ["e_rows"])
cte("e_orders_whole", orders_sql("px_cohort", False, MEDICATIONS, "px_med_whole"), ["px_cohort", "px_med_whole"])
cte("e_rows_whole", rows_sql("e_orders_whole", MEDICATIONS), ["e_orders_whole"])
cte("e_pivot_whole", pivot_sql("e_rows_whole", MEDICATIONS), ["e_rows_whole"])
# flags -> disease cohort -> routed exposures -> arms
cte("w_flagged", "SELECT c.* EXCLUDE (" + ", ".join(IMIDS) + "), " + ", ".join(f"f.{i}" for i in IMIDS) + """
FROM px_cohort c JOIN r_flags_whole f ON c.episode_id = f.episode_id AND c.pat_id = f.pat_id""",
    ["px_cohort", "r_flags_whole"])
cte("w_imid", "SELECT * FROM w_flagged WHERE " + " OR ".join(f"{i} = 1" for i in IMIDS), ["w_flagged"])
cte("w_orders", orders_sql("w_imid", True, MEDICATIONS, "px_med_whole"), ["w_imid", "px_med_whole"])
cte("w_rows", rows_sql("w_orders", MEDICATIONS), ["w_orders"])
cte("w_pivot", pivot_sql("w_rows", MEDICATIONS), ["w_rows"])
cte("w_cohort", f"""
SELECT c.*, {" + ".join(f"COALESCE(p.{m}_{st}, 0)" for m in MEDICATIONS for st in _STATUSES)} AS n_exposures
FROM w_flagged c LEFT JOIN w_pivot p ON c.pat_id = p.pat_id AND c.instance = p.instance
  AND c.lmp = p.lmp AND c.gestational_days = p.gestational_days
WHERE c.delivery_year > {PROXY_MIN_DELIVERY_YEAR}""", ["w_flagged", "w_pivot"])
EXPOSURE_FLAG_COLS = [f"{m}_{st}" for m in PROXY_MEDS for st in _STATUSES]

# ------------------------------------------------------------------ geography
BG = "PATIENT_ADDR_CENSUS_BLOCKGROUP_DERIVED"
GEO_SQL = {
    "ruca2010revised": (
        f"CASE WHEN PATIENT_STATE_CD = 'CA' THEN substring({BG}, 2, length({BG}) - 2) "
        f"ELSE substring({BG}, 1, length({BG}) - 1) END",
        "SELECT CAST(State_County_Tract_FIPS_Code AS VARCHAR) AS gk, "
        "CAST(SecondaryRUCACode2010 AS DOUBLE) AS value FROM geo_ruca2010revised"),
    "svi2018_us": (f"substring({BG}, 1, length({BG}) - 1)",
                   "SELECT FIPS AS gk, CAST(RPL_THEMES AS DOUBLE) AS value, CAST(RPL_THEME1 AS DOUBLE) AS RPL_THEME1, "
                   "CAST(RPL_THEME2 AS DOUBLE) AS RPL_THEME2, CAST(RPL_THEME3 AS DOUBLE) AS RPL_THEME3, "
                   "CAST(RPL_THEME4 AS DOUBLE) AS RPL_THEME4 FROM geo_svi2018_us"),
    "countytypologycodes2015": (
        f"CASE WHEN PATIENT_STATE_CD = 'CA' THEN substring({BG}, 2, 4) ELSE substring({BG}, 1, 5) END",
        "SELECT CAST(FIPStxt AS VARCHAR) AS gk, CAST(Economic_Type AS DOUBLE) AS value "
        "FROM geo_countytypologycodes2015"),
    "urbaninfluencecodes2013": (
        f"CASE WHEN PATIENT_STATE_CD = 'CA' THEN substring({BG}, 2, 4) ELSE substring({BG}, 1, 5) END",
        "SELECT CAST(FIPStxt AS VARCHAR) AS gk, CAST(UIC_2013 AS DOUBLE) AS value "
        "FROM geo_urbaninfluencecodes2013"),
    "svi2018_us_county": (f"substring({BG}, 1, 5)",
                          "SELECT CAST(FIPS AS VARCHAR) AS gk, CAST(RPL_THEMES_COUNTY AS DOUBLE) AS value "
                          "FROM geo_svi2018_us_county"),
    "ruralurbancontinuumcodes2013": (f"substring({BG}, 1, 5)",
                                     "SELECT CAST(FIPS AS VARCHAR) AS gk, CAST(RUCC_2013 AS DOUBLE) AS value "
                                     "FROM geo_ruralurbancontinuumcodes2013"),
    "farcodeszip2010": ("substring(ZIP, 1, 5)",
                        "SELECT CAST(ZIP AS VARCHAR) AS gk, CAST(FAR_LEVEL1 AS DOUBLE) AS value "
                        "FROM geo_farcodeszip2010"),
}
for _n, (_pk, _g) in GEO_SQL.items():
    cte(f"pg_{_n}", f"""
SELECT p.pat_id, p.instance, p.gk AS geo_key, g.* EXCLUDE (gk), '{_n}' AS geo_table
FROM (SELECT *, {_pk} AS gk FROM px_patient) p JOIN ({_g}) g ON p.gk = g.gk""",
        ["px_patient", f"geo_{_n}"])

RUCA_CAT = """CASE WHEN isnan({c}) THEN NULL WHEN {c} < 4 THEN 'Metropolitan'
  WHEN {c} < 7 THEN 'Micropolitan' WHEN {c} < 10 THEN 'SmallTown' WHEN {c} < 99 THEN 'Rural'
  WHEN {c} = 99 THEN 'NotCoded' END"""
RUCA_CODE = """CASE {c} WHEN 'Rural' THEN 0 WHEN 'SmallTown' THEN 1 WHEN 'Micropolitan' THEN 2
  WHEN 'Metropolitan' THEN 3 ELSE -1 END"""
SVI_CLEAN = "CASE WHEN CAST({c} AS FLOAT) < 0 THEN NULL ELSE CAST({c} AS FLOAT) END"

# ------------------------------------------------------------------ encoders
RACE_FMT = """CASE WHEN {r} IS NULL THEN 'Unknown' WHEN len({r}) > 1 THEN 'Multiracial'
  WHEN len({r}) = 0 THEN 'Unknown' WHEN {r}[1] = 'White' THEN 'White or Caucasian'
  WHEN {r}[1] IN ('Declined', 'Patient Refused', 'Unable to Determine') THEN 'Unknown'
  ELSE {r}[1] END"""
RACE_CONS = """list_sort(list_distinct(list_filter(
  list_transform({r}, lambda x: CASE WHEN x = 'White' THEN 'White or Caucasian' ELSE x END),
  lambda x: x IS NULL OR x NOT IN ('Patient Refused', 'Unable to Determine', 'Declined', 'Unknown'))))"""
ETH_FMT = """CASE WHEN {e} IS NULL THEN 'Unknown'
  WHEN {e} IN ('American', 'Samoan', 'Filipino', 'Hmong', 'Sudanese') THEN 'Not Hispanic or Latino'
  WHEN {e} IN ('Patient Refused', 'None') THEN 'Unknown' ELSE {e} END"""
PARITY = """CASE WHEN {p} IS NULL THEN 0 WHEN {p} IN (0, 1) THEN 0 WHEN {p} > 1 AND {p} < 5 THEN 1
  WHEN {p} >= 5 THEN 2 ELSE 0 END"""
GRAVIDITY = """CASE WHEN {g} IS NULL THEN 0 WHEN {g} IN (0, 1) THEN 0 WHEN {g} > 1 AND {g} < 6 THEN 1
  WHEN {g} >= 6 THEN 2 ELSE 0 END"""
PRETERM = """CASE WHEN {h} IS NULL THEN 0 WHEN {h} = 0 OR ({h} = 1 AND {ga} < 259) THEN 0 ELSE 1 END"""
BMI = """CASE WHEN {b} IS NULL OR isnan({b}) THEN -1
  WHEN trunc({b}) >= 15 AND trunc({b}) < 18.5 THEN 0 WHEN trunc({b}) < 25 THEN 1
  WHEN trunc({b}) < 30 THEN 2 WHEN trunc({b}) < 35 THEN 3 WHEN trunc({b}) < 40 THEN 4 ELSE -1 END"""
AGE = """CASE WHEN {a} < 25 THEN 0 WHEN {a} < 30 THEN 1 WHEN {a} < 35 THEN 2 WHEN {a} < 40 THEN 3
  WHEN {a} < 45 THEN 4 ELSE -1 END"""
ETH_CODE = "CASE {e} WHEN 'Hispanic_Latino' THEN 1 WHEN 'Not_Hispanic_Latino' THEN 0 ELSE -1 END"
SEX_CODE = "CASE {s} WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 ELSE -1 END"
PSIG = """CASE WHEN {p} IS NULL THEN NULL WHEN isnan({p}) THEN '****' WHEN {p} > 0.1 THEN 'ns'
  WHEN {p} > 0.05 THEN '+' WHEN {p} > 0.01 THEN '*' WHEN {p} > 0.001 THEN '**'
  WHEN {p} > 0.0001 THEN '***' ELSE '****' END"""

# ------------------------------------------------------------------ matching stage
from cohortlab.sources.proxy import PROXY_COMORBIDITIES  # noqa: E402

_RF_COLS = ", ".join(f"f.{f}" for f in PROXY_RISK_FACTORS)
cte("s_cohort", f"""
SELECT c.*, {_RF_COLS},
  {SVI_CLEAN.format(c='sv.RPL_THEMES')} AS RPL_THEMES,
  {SVI_CLEAN.format(c='sv.RPL_THEME1')} AS RPL_THEME1,
  {SVI_CLEAN.format(c='sv.RPL_THEME2')} AS RPL_THEME2,
  {SVI_CLEAN.format(c='sv.RPL_THEME3')} AS RPL_THEME3,
  {SVI_CLEAN.format(c='sv.RPL_THEME4')} AS RPL_THEME4,
  ru.value AS SecondaryRUCACode2010,
  {RUCA_CAT.format(c='ru.value')} AS ruca_categorization
FROM px_cohort c
JOIN r_flags f ON c.episode_id = f.episode_id AND c.pat_id = f.pat_id
LEFT JOIN (SELECT p.pat_id, p.instance, g.* FROM
    (SELECT *, substring({BG}, 1, length({BG}) - 1) AS gk FROM px_patient) p
    JOIN geo_svi2018_us g ON p.gk = g.FIPS) sv ON c.pat_id = sv.pat_id AND c.instance = sv.instance
LEFT JOIN pg_ruca2010revised ru ON c.pat_id = ru.pat_id AND c.instance = ru.instance
WHERE c.delivery_year > {PROXY_MIN_DELIVERY_YEAR}""",
    ["px_cohort", "r_flags", "px_patient", "geo_svi2018_us", "pg_ruca2010revised"])

_ANY_IMID_S = " OR ".join(f"{i} = 1" for i in IMIDS)


def arms_sql(src: str, prefix: str) -> None:
    cte(f"{prefix}_treated", f"SELECT * FROM {src} WHERE {_ANY_IMID_S}", [src])
    cte(f"{prefix}_controls", f"""
SELECT * FROM {src} b WHERE NOT EXISTS (SELECT 1 FROM {prefix}_treated t
  WHERE t.pat_id = b.pat_id AND t.instance = b.instance)""", [src, f"{prefix}_treated"])
    comps = "(VALUES ('IMID'), " + ", ".join(f"('{i}')" for i in IMIDS) + ") cc(comparison)"
    per = "\n".join(f"UNION ALL SELECT '{i}' AS comparison, 1 AS IMID_status, * FROM {prefix}_treated "
                    f"WHERE {i} = 1" for i in IMIDS)
    cte(f"{prefix}_long", f"""
SELECT 'IMID' AS comparison, 1 AS IMID_status, * FROM {prefix}_treated
{per}
UNION ALL SELECT cc.comparison, 0 AS IMID_status, s.* FROM {prefix}_controls s, {comps}""",
        [f"{prefix}_treated", f"{prefix}_controls"])


arms_sql("s_cohort", "s")

_DEDUP_KEY = "pat_id, instance, lmp, gestational_days, ob_hx_infant_sex"
cte("c_cohort", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {_DEDUP_KEY}
  ORDER BY episode_id) AS rn FROM s_cohort) WHERE rn = 1""", ["s_cohort"])
arms_sql("c_cohort", "c")


def match_sql(name: str, long: str, score: str, where: str = "TRUE") -> None:
    """Brute-force 1-NN per comparison: every (query, pool) pair of the same
    comparison ranked by distance, then score, then key."""
    cte(f"{name}_in", f"SELECT comparison, IMID_status, pat_id, instance, episode_id, "
                      f"{score} AS score FROM {long} WHERE {where} AND {score} IS NOT NULL", [long])
    cte(f"{name}_dir", f"""
SELECT comparison, SUM(CASE WHEN IMID_status = 0 THEN 1 ELSE 0 END)
                 > SUM(CASE WHEN IMID_status = 1 THEN 1 ELSE 0 END) AS tq
FROM {name}_in GROUP BY comparison""", [f"{name}_in"])
    cte(f"{name}_pairs", f"""
SELECT * FROM (
  SELECT q.comparison, q.IMID_status, q.pat_id, q.instance, q.episode_id, q.score,
    p.pat_id AS m_pat_id, p.instance AS m_instance, p.episode_id AS m_episode_id, p.score AS m_score,
    row_number() OVER (PARTITION BY q.comparison, q.pat_id, q.instance, q.episode_id
                       ORDER BY abs(q.score - p.score), p.score, p.pat_id, p.instance, p.episode_id) AS rn
  FROM {name}_in q JOIN {name}_dir d ON q.comparison = d.comparison
  JOIN {name}_in p ON p.comparison = q.comparison
  WHERE (q.IMID_status = 1) = d.tq AND (p.IMID_status = 1) <> d.tq) WHERE rn = 1""",
        [f"{name}_in", f"{name}_dir"])
    cte(name, f"""
SELECT comparison, episode_id AS match_id, IMID_status, pat_id, instance, episode_id, score
FROM {name}_pairs
UNION ALL
SELECT comparison, episode_id AS match_id, 1 - IMID_status AS IMID_status, m_pat_id AS pat_id,
  m_instance AS instance, m_episode_id AS episode_id, m_score AS score
FROM {name}_pairs""", [f"{name}_pairs"])


match_sql("m_all", "s_long", "px_score")
match_sql("m_all_sa", "s_long", "px_score_sa")
match_sql("m_imid", "s_long", "px_score", "comparison = 'IMID'")
# PS4 on one feature: treated rows always query the controls (no direction rule)
cte("m_imid_nn_pairs", """
SELECT * FROM (
  SELECT q.episode_id AS q_episode_id, p.pat_id, p.instance, p.episode_id, p.px_score AS score,
    row_number() OVER (PARTITION BY q.pat_id, q.instance, q.episode_id
                       ORDER BY abs(q.px_score - p.px_score), p.px_score, p.pat_id, p.instance,
                                p.episode_id) AS rn
  FROM s_long q JOIN s_long p ON q.comparison = 'IMID' AND p.comparison = 'IMID'
  WHERE q.IMID_status = 1 AND p.IMID_status = 0) WHERE rn = 1""", ["s_long"])
cte("m_imid_nn", """SELECT q_episode_id AS match_id, 0 AS IMID_status, pat_id, instance, episode_id, score
FROM m_imid_nn_pairs""", ["m_imid_nn_pairs"])
# reverse direction: overall comparison with the arm labels swapped
cte("s_long_swapped", """
SELECT comparison, 1 - IMID_status AS IMID_status, * EXCLUDE (comparison, IMID_status)
FROM s_long WHERE comparison = 'IMID'""", ["s_long"])
match_sql("m_rev", "s_long_swapped", "px_score")

# ------------------------------------------------------------------ features
_RFS = ", ".join(PROXY_COMORBIDITIES)
# years of the union of arms: one indicator each
cte("s_years", "SELECT DISTINCT delivery_year AS y FROM s_long WHERE delivery_year IS NOT NULL", ["s_long"])


def features_sql(name: str, long: str, sensitivity: bool) -> None:
    rf = "" if sensitivity else f"{_RFS},"
    cte(f"{name}_enc", f"""
SELECT comparison, IMID_status, pat_id, instance, episode_id,
  {BMI.format(b='pregravid_bmi')} AS pregravid_bmi,
  {AGE.format(a='age_at_start_dt')} AS age_at_start_dt,
  {ETH_CODE.format(e='ethnic_group')} AS ethnic_group,
  {SEX_CODE.format(s='ob_hx_infant_sex')} AS ob_hx_infant_sex,
  {PARITY.format(p='Parity')} AS Parity,
  {GRAVIDITY.format(g='Gravidity')} AS Gravidity,
  {PRETERM.format(h='Preterm_history', ga='gestational_days')} AS Preterm_history,
  COALESCE(illegal_drug_user, -1) AS illegal_drug_user, COALESCE(smoker, -1) AS smoker,
  RPL_THEME1, RPL_THEME2, RPL_THEME3, RPL_THEME4,
  {RUCA_CODE.format(c='ruca_categorization')} AS ruca_categorization,
  {rf}
  delivery_year,
  CASE WHEN race_f = 'White or Caucasian' THEN 1 ELSE 0 END AS race_white,
  CASE WHEN race_f = 'Asian' THEN 1 ELSE 0 END AS race_asian,
  CASE WHEN race_f = 'Black or African American' THEN 1 ELSE 0 END AS race_black,
  CASE WHEN race_f = 'Other' THEN 1 ELSE 0 END AS race_other,
  CASE WHEN insurance = 'Commercial' THEN 1 ELSE 0 END AS commercial_insurance
FROM (SELECT *, {RACE_FMT.format(r='race')} AS race_f FROM {long})""", [long])
    cte(f"{name}_med", f"""
SELECT comparison, IMID_status,
  median(CAST(RPL_THEME1 AS DOUBLE)) AS m1, median(CAST(RPL_THEME2 AS DOUBLE)) AS m2,
  median(CAST(RPL_THEME3 AS DOUBLE)) AS m3, median(CAST(RPL_THEME4 AS DOUBLE)) AS m4
FROM {name}_enc GROUP BY comparison, IMID_status""", [f"{name}_enc"])
    cte(name, f"""
SELECT e.* EXCLUDE (RPL_THEME1, RPL_THEME2, RPL_THEME3, RPL_THEME4),
  COALESCE(CAST(e.RPL_THEME1 AS DOUBLE), m.m1, -1.0) AS RPL_THEME1,
  COALESCE(CAST(e.RPL_THEME2 AS DOUBLE), m.m2, -1.0) AS RPL_THEME2,
  COALESCE(CAST(e.RPL_THEME3 AS DOUBLE), m.m3, -1.0) AS RPL_THEME3,
  COALESCE(CAST(e.RPL_THEME4 AS DOUBLE), m.m4, -1.0) AS RPL_THEME4
FROM {name}_enc e JOIN {name}_med m ON e.comparison = m.comparison AND e.IMID_status = m.IMID_status""",
        [f"{name}_enc", f"{name}_med"])


features_sql("f_all", "s_long", False)
FEATURE_COLS = (["pregravid_bmi", "age_at_start_dt", "ethnic_group", "ob_hx_infant_sex", "Parity",
                 "Gravidity", "Preterm_history", "illegal_drug_user", "smoker", "RPL_THEME1",
                 "RPL_THEME2", "RPL_THEME3", "RPL_THEME4", "ruca_categorization"]
                + PROXY_COMORBIDITIES
                + ["race_white", "race_asian", "race_black", "race_other", "commercial_insurance"])


def long_sql(src: str) -> str:
    """(comparison, IMID_status, variable, value): every covariate, years included."""
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLS)
    return f"""
SELECT comparison, IMID_status, variable, value
FROM (UNPIVOT (SELECT comparison, IMID_status, {casts} FROM {src}) ON {", ".join(FEATURE_COLS)}
      INTO NAME variable VALUE value)
UNION ALL
SELECT comparison, IMID_status, 'year_' || CAST(y AS VARCHAR),
  CASE WHEN delivery_year = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
FROM {src}, s_years"""


def cohen_sql(src: str) -> str:
    return f"""
SELECT comparison, variable,
  (avg(value) FILTER (WHERE IMID_status = 1) - avg(value) FILTER (WHERE IMID_status = 0))
  / NULLIF(sqrt(((count(value) FILTER (WHERE IMID_status = 1) - 1) * var_samp(value) FILTER (WHERE IMID_status = 1)
     + (count(value) FILTER (WHERE IMID_status = 0) - 1) * var_samp(value) FILTER (WHERE IMID_status = 0))
     / NULLIF(CAST(count(value) - 2 AS DOUBLE), 0)), 0) AS effect_size
FROM ({long_sql(src)})
GROUP BY comparison, variable"""


cte("f_matched", """
SELECT m.comparison, m.IMID_status, f.* EXCLUDE (comparison, IMID_status)
FROM m_all m JOIN f_all f ON m.comparison = f.comparison AND m.pat_id = f.pat_id
  AND m.instance = f.instance AND m.episode_id = f.episode_id AND f.IMID_status = m.IMID_status""",
    ["m_all", "f_all"])
cte("es_before", cohen_sql("f_all"), ["f_all", "s_years"])
cte("es_after", cohen_sql("f_matched"), ["f_matched", "s_years"])
# the logistic optimum: per covariate, the scores add up to the treated rows' values
cte("f_sums", f"""
SELECT variable, CAST(SUM(IMID_status * value) AS DOUBLE) AS score_sum
FROM ({long_sql("f_all")}) WHERE comparison = 'IMID' AND NOT starts_with(variable, 'RPL_')
GROUP BY variable
UNION ALL SELECT 'intercept', CAST(SUM(IMID_status) AS DOUBLE) FROM f_all WHERE comparison = 'IMID'""",
    ["f_all", "s_years"])

# ------------------------------------------------------------------ outcomes
OUTCOME_AGGS = """count(*) AS n,
  CAST(SUM(CASE WHEN preterm_category = 'preterm' THEN 1 ELSE 0 END) AS BIGINT) AS ptb,
  CAST(SUM(CASE WHEN LBW = 'LBW' THEN 1 ELSE 0 END) AS BIGINT) AS lbw,
  CAST(SUM(CASE WHEN SGA = 'SGA' THEN 1 ELSE 0 END) AS BIGINT) AS sga,
  CAST(SUM(CASE WHEN delivery_method = 'c-section' THEN 1 ELSE 0 END) AS BIGINT) AS csec"""


def counts_long_sql(treated: str, controls: str) -> str:
    """One row per (comparison, outcome) with a, n1, c, n0."""
    return f"""
SELECT t.comparison, o.outcome,
  CASE o.outcome WHEN 'ptb' THEN t.ptb WHEN 'lbw' THEN t.lbw WHEN 'sga' THEN t.sga ELSE t.csec END AS a,
  t.n AS n1,
  CASE o.outcome WHEN 'ptb' THEN c.ptb WHEN 'lbw' THEN c.lbw WHEN 'sga' THEN c.sga ELSE c.csec END AS c,
  c.n AS n0
FROM (SELECT comparison, {OUTCOME_AGGS} FROM {treated} GROUP BY comparison) t
JOIN (SELECT comparison, {OUTCOME_AGGS} FROM {controls} GROUP BY comparison) c ON t.comparison = c.comparison,
  (VALUES ('ptb'), ('lbw'), ('sga'), ('csec')) o(outcome)"""


import math as _math  # noqa: E402

_LOG_TOL = repr(_math.log1p(1e-7))
_Z = "1.959963984540054"


def _lnc(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


def risk_sql(name: str, long: str) -> None:
    nan, inf = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"
    rr = (f"(CASE WHEN n1 = 0 OR n0 = 0 THEN NULL WHEN c = 0 AND a = 0 THEN {nan} WHEN c = 0 THEN {inf} "
          "ELSE (CAST(a AS DOUBLE) / n1) / (CAST(c AS DOUBLE) / n0) END)")
    se = "sqrt(1.0 / a - 1.0 / n1 + 1.0 / c - 1.0 / n0)"
    cte(f"{name}_ci", f"""
SELECT comparison, outcome, a, n1, c, n0, {rr} AS rr,
  CASE WHEN n1 = 0 OR n0 = 0 THEN NULL WHEN c = 0 THEN {nan} WHEN a = 0 THEN 0.0
    ELSE {rr} * exp(-{_Z} * {se}) END AS lower,
  CASE WHEN n1 = 0 OR n0 = 0 THEN NULL WHEN a = 0 THEN {nan} WHEN c = 0 THEN {inf}
    ELSE {rr} * exp({_Z} * {se}) END AS upper
FROM {long}""", [long])
    lp = (f"{_lnc('K', 'x')} + {_lnc('N - K', 'n1 - x')} - {_lnc('N', 'n1')}")
    lp_obs = (f"{_lnc('K', 'a')} + {_lnc('N - K', 'n1 - a')} - {_lnc('N', 'n1')}")
    cte(f"{name}_fisher", f"""
SELECT comparison, outcome,
  least(1.0, SUM(CASE WHEN lp <= lp_obs + {_LOG_TOL} THEN exp(lp) ELSE 0.0 END)) AS p_value
FROM (SELECT comparison, outcome, {lp} AS lp, {lp_obs} AS lp_obs FROM (
  SELECT *, unnest(generate_series(greatest(0, n1 - (N - K)), least(K, n1))) AS x
  FROM (SELECT *, n1 + n0 AS N, a + c AS K FROM {long})))
GROUP BY comparison, outcome""", [long])
    cte(name, f"""
SELECT r.comparison, r.outcome, r.a, r.n1, r.c, r.n0,
  (round(r.rr, 2) + 0.0) AS rr, (round(r.lower, 2) + 0.0) AS lower, (round(r.upper, 2) + 0.0) AS upper,
  {PSIG.format(p='f.p_value')} AS pval,
  (round(r.rr, 6) + 0.0) AS rr_raw, (round(r.lower, 6) + 0.0) AS lower_raw, (round(r.upper, 6) + 0.0) AS upper_raw,
  (round(f.p_value, 6) + 0.0) AS p_value
FROM {name}_ci r JOIN {name}_fisher f ON r.comparison = f.comparison AND r.outcome = f.outcome""",
        [f"{name}_ci", f"{name}_fisher"])


cte("o_unadj_long", counts_long_sql("(SELECT * FROM s_long WHERE IMID_status = 1)",
                                    "(SELECT * FROM s_long WHERE IMID_status = 0)"), ["s_long"])
risk_sql("o_unadj_s", "o_unadj_long")

cte("oc_unadj_long", counts_long_sql("(SELECT * FROM c_long WHERE IMID_status = 1)",
                                     "(SELECT * FROM c_long WHERE IMID_status = 0)"), ["c_long"])
risk_sql("o_unadjusted", "oc_unadj_long")


def matched_controls_sql(m: str) -> str:
    return f"""(SELECT m.comparison, s.* FROM {m} m
  JOIN (SELECT * FROM s_controls) s ON m.pat_id = s.pat_id AND m.instance = s.instance
  AND m.episode_id = s.episode_id WHERE m.IMID_status = 0)"""


cte("oc_adj_long", counts_long_sql("(SELECT * FROM c_long WHERE IMID_status = 1)",
                                   matched_controls_sql("m_all")), ["c_long", "m_all", "s_controls"])
risk_sql("o_adjusted", "oc_adj_long")
cte("oc_sa_long", counts_long_sql("(SELECT * FROM c_long WHERE IMID_status = 1)",
                                  matched_controls_sql("m_all_sa")), ["c_long", "m_all_sa", "s_controls"])
risk_sql("o_sensitivity", "oc_sa_long")
