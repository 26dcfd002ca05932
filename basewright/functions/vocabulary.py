"""Column names, category values, defaults and the two tag lists.

Everything in this file is data that results depend on. It is kept verbatim, in
its natural order, and passed around as plain parameters.
"""

# --- fixed values: column names -------------------------------------------------
CUSTOMER = "customer__id"
CUSTOMER_TYPE = "customer__type"
COLLECTION = "collection__id"
COLLECTION_END = "collection__end"
DATE = "date"
PROTOTYPE = "prototype"
TAGS = "customer__tags"
INCOME = "income_segments"
INCOME_MONTH = "income_month"
LATENESS = "lateness"
SEGMENT = "segment"

# Logical name -> physical name.
COLUMN_NAMES = {
    "iscc": "is_cc",
    "isll": "is_ll",
    "days_late": "product__days_late",
    "cured": "collection__cured",
}
IS_CC = COLUMN_NAMES["iscc"]
IS_LL = COLUMN_NAMES["isll"]
DAYS_LATE = COLUMN_NAMES["days_late"]
CURED = COLUMN_NAMES["cured"]

# --- fixed values: categories ---------------------------------------------------
SEGMENTS = ("cc_only", "ll_only", "multi_debt")
LATENESS_VALUES = ("short", "long")
INCOME_SEGMENTS = ("mass_market", "super_core", "high_income")
TIERS = ("roxinho", "uv", "nu_plus", "u18")
CUSTOMER_TYPES = ("person", "company")

# --- fixed values: exact tags (27) ----------------------------------------------
EXACT_TAGS = (
    "social_media_vip",
    "rewards/email_unsubscribers",
    "journalist",
    "user_research/...",
    "fraud_id",
    "reclame",
    "AML",
    "f&f",
    "procon",
    "suspect",
    "pep",
    "lawsuit",
    "ff_nok",
    "ff_ok",
    "gs/nubank_employee",
    "Customer_group_owner",
    "Embaixador-nu",
    "user_research/unsubscribed",
    "beta",
    "legal_fup",
    "conteudo_abusivo",
    "conteudo_ofensivo",
    "fraud_f&f",
    "cpf_irregular_suspenso",
    "cpf_irregular_cancelado",
    "obito",
    "óbito",
)

# --- fixed values: substrings looked for in lowercased tags (36) ------------------
TAG_NEEDLES = (
    "social_media_vip",
    "socialmedia_vip",
    "rewards",
    "email_unsubscribers",
    "journalist",
    "user_research",
    "fraud_id",
    "fraud",
    "reclame",
    "AML",
    "aml",
    "f&f",
    "procon",
    "suspect",
    "suspicious",
    "pep",
    "lawsuit",
    "judicial-bloqueado",
    "judicialbloqueado",
    "jud ord monitor",
    "blocked",
    "bloqueado",
    "no desbloquear",
    "no_desbloquear",
    "ff_nok",
    "ff_ok",
    "gs/",
    "nubank_employee",
    "nubanker_employee",
    "Customer_group_owner",
    "Embaixador-nu",
    "unsubscribed",
    "beta",
    "cancelled",
    "cancel account request",
    "acosador_en_potencia",
)
