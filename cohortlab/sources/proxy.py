"""Clinical-shaped views derived from the provided test tables.

The study's warehouse tables are private, so every clinical input is derived
from the TPC-H-like tables by fixed arithmetic (FIXTURES.md section 2). The
same derivation is written independently as SQL in ``oracle/proxy_sql.py``.
Every view is a lazy DataFrame over the parquet scans, so its size grows with
the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import IMIDS, MATCH_COMORBIDITIES, MEDICATIONS, RISK_FACTORS
from .tables import Tables

# Proxy vocabularies: the six part types stand in for medication classes. Every
# (type, brand) pair is a condition registry node, dealt in turn to the study's
# conditions (the diseases compared have their own columns in ``pregnancy``).
PROXY_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PROXY_MEDS = [t.lower() for t in PROXY_TYPES]
PROXY_RISK_FACTORS = [f for f in RISK_FACTORS if f not in IMIDS]
PROXY_COMORBIDITIES = [f for f in MATCH_COMORBIDITIES if f in PROXY_RISK_FACTORS]
BRANDS_PER_TYPE = 25
PROXY_MIN_DELIVERY_YEAR = 1995          # exclusive lower bound used on the proxy cohort
PROXY_ROUTE = {"A": "Oral", "R": "Rectal", "N": "Topical"}
PROXY_ORDER_CLASS = {"F": "Historical Med", "O": "Normal"}
PROXY_RACE = [None, ["White"], ["White or Caucasian"], ["Asian"], ["Black or African American"],
              ["White", "Asian"], ["Declined"], ["Other"], ["American Indian or Alaska Native"]]
PROXY_ETHNIC = [None, "Unknown_NotReported", "Hispanic_Latino", "Not_Hispanic_Latino"]
PROXY_SEX = [None, "Male", "Female", "Other", "Unknown"]
PROXY_INSURANCE = [None, "Medicaid", "Medicare", "Uninsured-Self-Pay", "Other", "Commercial"]
SCORE_MOD = 100003


def _instance(cust: Column) -> Column:
    return (F.lit(1000) + cust % 2).cast("int")


def _pick(selector: Column, values: list) -> Column:
    """CASE selector WHEN i THEN values[i] ... (None -> NULL)."""
    expr = None
    for i, v in enumerate(values):
        if v is None:
            continue
        lit = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        expr = F.when(selector == i, lit) if expr is None else expr.when(selector == i, lit)
    return expr


def _map_code(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


# ---------------------------------------------------------------- patients / geo

def patient(t: Tables) -> DataFrame:
    c = t.customer
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        key.alias("pat_id"),
        _instance(key).alias("instance"),
        F.when(nat == 5, F.lit("CA")).otherwise(F.concat(F.lit("S"), nat.cast("string")))
        .alias("PATIENT_STATE_CD"),
        F.concat(F.lpad((nat + 1).cast("string"), 2, "0"),
                 F.lpad((key % 3 + 1).cast("string"), 3, "0"),
                 F.lpad((key % 7 + 1).cast("string"), 6, "0"),
                 F.lit("1")).alias("PATIENT_ADDR_CENSUS_BLOCKGROUP_DERIVED"),
        F.concat(F.lpad((key % 60 + 1).cast("string"), 5, "0"), F.lit("-0001")).alias("ZIP"),
    )


def _tracts(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("n"))
    n = n.withColumn("county", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    n = n.withColumn("tract", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))))
    return n.withColumn("x", F.col("n") + 3 * F.col("county") + F.col("tract"))


def _theme(x: Column, k: int) -> Column:
    return F.when(x % 9 == 0, F.lit(-999.0)).otherwise(((x * k * 7) % 100).cast("double") / 100.0)


def ruca2010revised(t: Tables) -> DataFrame:
    g = _tracts(t)
    x = F.col("x")
    return g.select(
        ((F.col("n") + 1) * 1_000_000_000 + F.col("county") * 1_000_000 + F.col("tract"))
        .alias("State_County_Tract_FIPS_Code"),
        F.when(x % 13 == 0, F.lit(99.0)).otherwise((x % 12 + 1).cast("double"))
        .alias("SecondaryRUCACode2010"),
    )


def svi2018_us(t: Tables) -> DataFrame:
    g = _tracts(t)
    x = F.col("x")
    fips = (F.col("n") + 1) * 1_000_000_000 + F.col("county") * 1_000_000 + F.col("tract")
    return g.select(
        F.lpad(fips.cast("string"), 11, "0").alias("FIPS"),
        _theme(x, 5).alias("RPL_THEMES"),
        *[_theme(x, k).alias(f"RPL_THEME{k}") for k in range(1, 5)],
    )


def _counties(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("n"))
    n = n.withColumn("county", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    return n.withColumn("fips_num", (F.col("n") + 1) * 1000 + F.col("county"))


def countytypologycodes2015(t: Tables) -> DataFrame:
    g = _counties(t)
    return g.select(F.col("fips_num").alias("FIPStxt"),
                    ((F.col("n") + F.col("county")) % 6).cast("int").alias("Economic_Type"))


def urbaninfluencecodes2013(t: Tables) -> DataFrame:
    g = _counties(t)
    return g.select(F.col("fips_num").alias("FIPStxt"),
                    ((F.col("n") + 2 * F.col("county")) % 12 + 1).cast("int").alias("UIC_2013"))


def svi2018_us_county(t: Tables) -> DataFrame:
    g = _counties(t)
    return g.select(F.col("fips_num").alias("FIPS"),
                    (((F.col("n") * 7 + F.col("county") * 3) % 100).cast("double") / 100.0)
                    .alias("RPL_THEMES_COUNTY"))


def ruralurbancontinuumcodes2013(t: Tables) -> DataFrame:
    g = _counties(t)
    return g.select(F.col("fips_num").alias("FIPS"),
                    ((F.col("n") + F.col("county")) % 9 + 1).cast("int").alias("RUCC_2013"))


def farcodeszip2010(t: Tables) -> DataFrame:
    """All ZIPs 1-50; patients in ZIPs 51-60 have no row here."""
    z = t.customer.select((F.col("c_custkey") % 50 + 1).alias("z")).distinct()
    return z.select(F.lpad(F.col("z").cast("string"), 5, "0").alias("ZIP"),
                    (F.col("z") % 2).cast("int").alias("FAR_LEVEL1"))


# ---------------------------------------------------------------- pregnancies

def pregnancy(t: Tables, imids: list[str] | None = None) -> DataFrame:
    imids = imids or IMIDS
    o = t.orders
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    lmp = F.to_date("o_orderdate")
    ga = (F.lit(180) + key % 110).cast("int")
    delivery = F.date_add(lmp, ga)
    cols = [
        cust.alias("pat_id"),
        _instance(cust).alias("instance"),
        key.alias("episode_id"),
        lmp.alias("lmp"),
        ga.alias("gestational_days"),
        delivery.alias("ob_delivery_delivery_date"),
        F.year(delivery).alias("delivery_year"),
        F.when(key % 11 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(12.0) + (key % 331).cast("double") / 10.0).alias("pregravid_bmi"),
        (F.lit(16) + (key * 7) % 34).cast("double").alias("age_at_start_dt"),
        _pick(cust % 6, PROXY_INSURANCE).alias("insurance"),
        _pick(key % 9, PROXY_RACE).alias("race"),
        _pick(key % 4, PROXY_ETHNIC).alias("ethnic_group"),
        _pick(key % 5, PROXY_SEX).alias("ob_hx_infant_sex"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(key % 7).cast("int").alias("Parity"),
        F.when(key % 15 == 0, F.lit(None)).otherwise(key % 9).cast("int").alias("Gravidity"),
        F.when(key % 10 == 0, F.lit(None)).otherwise(key % 3).cast("int").alias("Preterm_history"),
        F.when(cust % 14 == 0, F.lit(None)).otherwise(cust % 2).cast("int").alias("illegal_drug_user"),
        F.when(key % 12 == 0, F.lit(None)).otherwise(key % 2).cast("int").alias("smoker"),
        F.when(ga < 259, F.lit("preterm")).otherwise(F.lit("term")).alias("preterm_category"),
        F.when(key % 8 == 0, F.lit("SGA")).otherwise(F.lit("AGA")).alias("SGA"),
        F.when(F.col("o_totalprice") < 60000, F.lit("LBW")).otherwise(F.lit("NBW")).alias("LBW"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("c-section"))
        .otherwise(F.lit("vaginal")).alias("delivery_method"),
        F.lit("live birth").alias("pregnancy_outcome"),
        ((key * 7919 + cust * 31) % SCORE_MOD).cast("double").alias("_s1"),
        ((key * 104729 + cust * 17) % SCORE_MOD).cast("double").alias("_s2"),
    ]
    for k, name in enumerate(imids):
        cols.append(((cust * 13 + 11 * k + key % 2) % 97 == 0).cast("int").alias(name))
    df = o.select(*cols)
    return (df.withColumn("px_score", F.col("_s1") / float(SCORE_MOD))
              .withColumn("px_score_sa", F.col("_s2") / float(SCORE_MOD))
              .drop("_s1", "_s2"))


# ---------------------------------------------------------------- medication orders

def medication_order(t: Tables, whole: bool = False) -> DataFrame:
    """Orders with a flag for each proxy class or, with ``whole``, each of the study's 32."""
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag",
                          "l_linestatus", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey")
    p = t.part.select("p_partkey", "p_type", "p_size")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    start = F.to_date("l_shipdate")
    cls = F.lower(F.col("p_type"))
    flags = []
    # the study's classes: a part has one by its number, or none, and some parts a second
    number, more = F.col("p_partkey") % 37, F.col("p_size") % 10 == 0
    for i, m in enumerate(MEDICATIONS if whole else []):
        flags.append(((number == i) | (more & (number == (i + 7) % 37))).cast("int").alias(m))
    for m in [] if whole else PROXY_MEDS:
        hit = cls == m
        if m == "promo":
            hit = hit | (F.col("p_size") % 10 == 0)
        flags.append(hit.cast("int").alias(m))
    return j.select(
        F.col("o_custkey").alias("pat_id"),
        _instance(F.col("o_custkey")).alias("instance"),
        start.alias("start_date"),
        F.date_add(start, (F.col("l_quantity") * 4).cast("int")).alias("end_date"),
        _map_code(F.col("l_returnflag"), PROXY_ROUTE).alias("route"),
        _map_code(F.col("l_linestatus"), PROXY_ORDER_CLASS).alias("order_class"),
        *flags,
    )


# ---------------------------------------------------------------- diagnosis history

def _flag_split(flag: str, parity: int) -> Column:
    """Every line item goes to one of the two diagnosis sources: flag A to the problem
    list, R to the encounters, N by the parity of its order."""
    return F.col("l_returnflag").isin(flag, "N") & \
        ((F.col("l_returnflag") == flag) | (F.col("l_orderkey") % 2 == parity))


def problemlist(t: Tables) -> DataFrame:
    l = t.lineitem.filter(_flag_split("A", 0)).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    ship = F.to_date("l_shipdate")
    return j.select(
        F.col("o_custkey").alias("pat_id"),
        F.col("l_partkey").alias("dx_id"),
        _instance(F.col("o_custkey")).alias("instance"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("date")).otherwise(ship)
        .alias("NOTED_DATE"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(ship, 180)).alias("RESOLVED_DATE"),
        F.date_add(ship, (F.col("l_quantity") - 25).cast("int")).alias("DATE_OF_ENTRY"),
    )


def encounterdiagnosis(t: Tables) -> DataFrame:
    l = t.lineitem.filter(_flag_split("R", 1)).select("l_orderkey", "l_partkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    p = t.part.select("p_partkey", "p_name")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return j.select(
        F.col("o_custkey").alias("pat_id"),
        _instance(F.col("o_custkey")).alias("instance"),
        F.col("l_partkey").alias("dx_id"),
        F.col("l_orderkey").alias("PAT_ENC_CSN_ID"),
        F.col("p_name").alias("DIAGNOSISNAME"),
    )


def encounter(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        F.col("o_custkey").alias("pat_id"),
        _instance(F.col("o_custkey")).alias("instance"),
        F.col("o_orderkey").alias("PAT_ENC_CSN_ID"),
        F.when(F.col("o_orderkey") % 29 == 0, F.lit(None).cast("date"))
        .otherwise(F.to_date("o_orderdate")).alias("CONTACT_DATE"),
    )


def _part_code(p: Column) -> Column:
    return F.when(p % 50 == 7, F.concat(F.lit("OMOP"), p.cast("string"))).otherwise(p.cast("string"))


def externalconceptmapping(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_name", "p_brand")
    key = F.col("p_partkey")
    code = _part_code(key)
    return p.select(
        key.alias("value"),
        F.when(key % 2 == 0, F.split(F.col("p_name"), " ").getItem(0))
        .otherwise(F.col("p_brand")).alias("name"),
        F.explode(F.array(F.lit(1000), F.lit(1001))).alias("instance"),
        F.when(key % 10 == 0, F.concat(F.lit("ICD-10#"), code))
        .otherwise(F.concat(F.lit("SNOMED#"), code)).alias("concept"),
    )


def _node_ids(p: DataFrame) -> DataFrame:
    typ, brand, key = F.col("p_type"), F.col("p_brand"), F.col("p_partkey")
    return p.select(
        F.concat(F.lit("P"), key.cast("string")).alias("pid"),
        F.concat(F.lit("B"), typ, F.lit("/"), brand).alias("bid"),
        F.concat(F.lit("T"), typ).alias("tid"),
        _part_code(key).alias("pcode"),
        F.concat(typ, F.lit("/"), brand).alias("bcode"),
        typ.alias("tcode"),
        F.col("p_name").alias("pname"),
        F.concat(typ, F.lit(" "), brand).alias("bname"),
        F.when(key % 23 == 0, F.lit("ICD10CM")).otherwise(F.lit("SNOMED")).alias("pvocab"),
    )


def concept(t: Tables) -> DataFrame:
    ids = _node_ids(t.part.select("p_partkey", "p_name", "p_brand", "p_type"))
    def node(i, code, name, vocab):
        return F.struct(F.col(i).alias("concept_id"), F.col(code).alias("concept_code"),
                        F.col(name).alias("concept_name"), vocab.alias("vocabulary_id"))

    c = F.explode(F.array(node("pid", "pcode", "pname", F.col("pvocab")),
                          node("bid", "bcode", "bname", F.lit("SNOMED")),
                          node("tid", "tcode", "tcode", F.lit("SNOMED")))).alias("c")
    return ids.select(c).select("c.*").distinct()


def concept_ancestor(t: Tables) -> DataFrame:
    ids = _node_ids(t.part.select("p_partkey", "p_name", "p_brand", "p_type"))

    def edge(a, d, lvl):
        return F.struct(F.col(a).alias("ancestor_concept_id"), F.col(d).alias("descendant_concept_id"),
                        F.lit(lvl).alias("min_levels_of_separation"))

    e = F.explode(F.array(edge("pid", "pid", 0), edge("bid", "pid", 1), edge("tid", "pid", 2),
                          edge("bid", "bid", 0), edge("tid", "bid", 1), edge("tid", "tid", 0))).alias("e")
    return ids.select(e).select("e.*").distinct()


def _risk_factor_name(typ: Column, brand: Column, factors: list[str] = PROXY_RISK_FACTORS) -> Column:
    number = F.substring(brand, 7, 3).cast("int") - 1
    node = F.array_position(F.array(*[F.lit(x) for x in PROXY_TYPES]), typ) * BRANDS_PER_TYPE + number
    return F.get(F.array(*[F.lit(f) for f in factors]), (node % len(factors)).cast("int"))


def condition_registry(t: Tables, factors: list[str] = PROXY_RISK_FACTORS) -> DataFrame:
    p = t.part.select("p_type", "p_brand")
    return p.select(_risk_factor_name(F.col("p_type"), F.col("p_brand"), factors).alias("risk_factor"),
                    F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("concept_code")
                    ).distinct()


def condition_patch(t: Tables, factors: list[str] = PROXY_RISK_FACTORS) -> DataFrame:
    p = t.part.select("p_partkey", "p_type", "p_brand").filter(F.col("p_partkey") % 17 == 0)
    return p.select(_risk_factor_name(F.col("p_type"), F.col("p_brand"), factors).alias("risk_factor"),
                    _part_code(F.col("p_partkey")).alias("concept_code"))


def diagnosismapping(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_size") > 2).select(F.col("p_partkey").alias("dx_id"))


def diagnosis(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_size") < 49).select(F.col("p_partkey").alias("dx_id"))
