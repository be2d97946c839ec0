"""Study vocabularies.

FIXED VALUES. Everything in this module is a value that must equal the study's
own lists and mappings for results to be right: condition names, medication
classes, routes, disease names, covariate lists and the category labels the
encoders test for. They are written out plainly, in the study's order.
"""

# --- fixed values: conditions flagged at the index date (85, study order) ---
RISK_FACTORS = [
    # comorbidities
    "hypertension_pregnancy_related", "diabetes_type1and2", "atrial_fibrillation",
    "coronary_artery_disease", "heart_failure", "chronic_kidney_disease", "copd", "obesity",
    "chronic_liver_disease", "malignant_neoplastic_disease",
    # CDC list
    "asthma", "HIV", "history_transplant", "stroke", "opioid_dependence",
    # additional conditions
    "abdominal_pain", "acute_pulmonary_edema", "acute_renal_failure", "alcoholism",
    "acute_respiratory_failure", "arteriosclerotic_vascular_disease",
    "benign_prostatic_hyperplasia", "blood_loss", "cardiac_arrhythmia",
    "cardiorespiratory_failure", "cdifficile_infection", "cerebrovascular_accident",
    "chronic_lung_disease", "chronic_renal_failure", "cirrhosis_liver_cooccurrent",
    "cogan_syndrome", "cold_agglutinin_disease", "congestive_heart_failure",
    "deep_vein_thrombosis", "dementia", "depression", "dermatomyositis", "diverticulitis",
    "encephalopathy", "endometriosis", "gerd", "gestational_trophoblastic_disease",
    "graft_versus_host_disease", "HBV", "HCV", "HDV", "HEV", "hidradenitis_suppurativa",
    "history_bariatric", "hypercoagulability", "hyperlipidemia", "hypothyroidism", "ibs",
    "insomnia", "malabsorption", "multicentric_reticulohistiocytosis", "myastenia",
    "myelodysplastic", "NAFLD", "neutropenia", "osteoporosis", "pancreatitis", "pneumonia",
    "polymyositis", "pregnancy_tubal_ectopic", "protein_calorie_malnutrition",
    "pulmonary_embolism", "schizophrenia", "seizure", "spinal_enthesopathy", "tachycardia",
    "urinary_tract_infection", "wernicke_korsakoff",
    # immune-mediated inflammatory diseases
    "ibd", "rheumatoid_arthritis", "multiple_sclerosis", "psoriatic_arthritis", "psoriasis",
    "systemic_sclerosis", "spondyloarthritis", "systemic_lupus", "vasculitis", "sarcoidosis",
    "APS", "sjogren_syndrome",
]

# --- fixed values: immune-mediated diseases compared (12, study order) ---
IMIDS = [
    "ibd", "rheumatoid_arthritis", "multiple_sclerosis", "psoriatic_arthritis", "psoriasis",
    "systemic_sclerosis", "spondyloarthritis", "systemic_lupus", "vasculitis", "sarcoidosis",
    "APS", "sjogren_syndrome",
]

# --- fixed values: medication classes (32, study order; first listed wins a tie) ---
MEDICATIONS = [
    "hydroxychloroquine", "methotrexate", "leflunomide", "teriflunomide", "Five_ASA",
    "azathioprine", "mercaptopurine", "mitoxantrone", "mycophenolate",
    "Calcineurin_inhibitor", "TNF_inhibitor", "fumarates", "interferons", "alkylating",
    "hydroxyurea", "dapsone", "cladribine", "IL1_inhibitor", "IL6_inhibitor",
    "IL12_23_inhibitor", "IL17_inhibitor", "IL23_inhibitor", "abatacept", "belimumab",
    "S1P_receptor_modulators", "JAKi", "Integrin_modulator", "PDE4i_targeted_synthetic",
    "cd20", "cd52", "budesonide", "steroids",
]

# --- fixed values: administration routes kept for the disease cohort ---
ROUTES = [
    "Oral", "Intramuscular", "Intravenous", "Subcutaneous Infusion", "Subcutaneous",
    "Intravenous (Continuous Infusion)", "Rectal",
]

HISTORICAL_ORDER_CLASS = "Historical Med"

# --- fixed values: order columns dropped before de-duplication (13) ---
ORDER_ADMIN_COLUMNS = [
    "order_description", "order_class", "order_set", "order_status", "order_priority",
    "requested_instant_utc", "authorizing_prov_id", "department_id", "controlled",
    "recorded_datetime", "due_datetime", "scheduled_on_datetime", "scheduled_for_datetime",
]

# --- fixed values: social vulnerability columns and rural-urban code column ---
SVI_COLUMNS = ["RPL_THEMES", "RPL_THEME1", "RPL_THEME2", "RPL_THEME3", "RPL_THEME4"]
SVI_IMPUTED = ["RPL_THEME1", "RPL_THEME2", "RPL_THEME3", "RPL_THEME4"]
RUCA_COLUMN = "SecondaryRUCACode2010"

# --- fixed values: comorbidities used as matching covariates (16) ---
MATCH_COMORBIDITIES = [
    "diabetes_type1and2", "chronic_kidney_disease", "obesity", "chronic_liver_disease",
    "asthma", "HIV", "chronic_lung_disease", "depression", "hypercoagulability", "pneumonia",
    "urinary_tract_infection", "sexually_transmitted_disease", "periodontitis_disease",
    "cardiovascular_disease", "sickle_cell_disease", "sepsis",
]

# --- fixed values: base matching columns (sensitivity analysis uses only these) ---
MATCH_BASE_COLUMNS = [
    "pregravid_bmi", "age_at_start_dt", "insurance", "race", "ethnic_group",
    "ob_hx_infant_sex", "Parity", "Gravidity", "Preterm_history", "illegal_drug_user",
    "smoker", "RPL_THEME1", "RPL_THEME2", "RPL_THEME3", "RPL_THEME4", "lmp",
    "gestational_days", "ruca_categorization", "delivery_year",
]

# --- fixed values: columns the feature step drops after encoding ---
FEATURE_DROPPED = ["gestational_days", "insurance", "race", "lmp"]

# --- fixed values: race labels ---
RACE_WHITE_RAW = "White"
RACE_WHITE = "White or Caucasian"
RACE_UNKNOWN = "Unknown"
RACE_MULTI = "Multiracial"
RACE_OTHER = "Other"
RACE_ASIAN = "Asian"
RACE_BLACK = "Black or African American"
RACE_UNKNOWN_SINGLE = ["Declined", "Patient Refused", "Unable to Determine"]
RACE_DROPPED_RESPONSES = ["Patient Refused", "Unable to Determine", "Declined", "Unknown"]

# --- fixed values: ethnic group labels ---
ETHNIC_NOT_HISPANIC_GROUPS = ["American", "Samoan", "Filipino", "Hmong", "Sudanese"]
ETHNIC_NOT_HISPANIC = "Not Hispanic or Latino"
ETHNIC_UNKNOWN_VALUES = ["Patient Refused", "None"]
ETHNIC_HISPANIC_CODE = "Hispanic_Latino"
ETHNIC_NOT_HISPANIC_CODE = "Not_Hispanic_Latino"

# --- fixed values: fetal sex and insurance labels ---
SEX_MALE = "Male"
SEX_FEMALE = "Female"
INSURANCE_COMMERCIAL = "Commercial"

# --- fixed values: delivery method labels ---
DELIVERY_VAGINAL = [
    "Vaginal, Spontaneous", "Vaginal, Vacuum (Extractor)", "Vaginal, Forceps",
    "Vaginal < 20 weeks", "Vaginal, Breech", "VBAC, Spontaneous",
    "Vaginal Birth after Cesarean Section", "Spontaneous Abortion",
]
DELIVERY_CSECTION = [
    "C-Section, Low Transverse", "C-Section, Low Vertical", "C-Section, Classical",
    "C-Section, Unspecified",
]

# --- fixed values: rural-urban categories ---
RUCA_METRO = "Metropolitan"
RUCA_MICRO = "Micropolitan"
RUCA_SMALLTOWN = "SmallTown"
RUCA_RURAL = "Rural"
RUCA_NOTCODED = "NotCoded"

# --- fixed values: outcome labels ---
OUTCOME_PRETERM = "preterm"
OUTCOME_LBW = "LBW"
OUTCOME_SGA = "SGA"
OUTCOME_CSECTION = "c-section"
OUTCOMES = ["ptb", "lbw", "sga", "csec"]

# --- fixed values: geography tables known to the geo join ---
GEO_TABLES = [
    "ruca2010revised", "countytypologycodes2015", "farcodeszip2010",
    "ruralurbancontinuumcodes2013", "urbaninfluencecodes2013", "svi2018_us",
    "svi2018_us_county",
]

# --- fixed value: the 37-week mark in days ---
TERM_DAYS = 259

# --- fixed values: statistics ---
Z_975 = 1.959963984540054          # standard normal 97.5% quantile
FISHER_REL_TOL = 1e-7              # relative tolerance when comparing table probabilities
PVAL_THRESHOLDS = [(0.1, "ns"), (0.05, "+"), (0.01, "*"), (0.001, "**"), (0.0001, "***")]
PVAL_SMALLEST = "****"

# Study defaults
MIN_DELIVERY_YEAR_EXCLUSIVE = 2012
INSTANCE_1K = 1000
LOGISTIC_C = 1e6
LOGISTIC_MAX_ITER = 10000
