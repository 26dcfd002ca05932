"""The same results as plain SQL over the given tables, for an independent engine."""

from __future__ import annotations

from ..functions.vocabulary import EXACT_TAGS, TAG_NEEDLES
from .registry import CAPS, DEFAULT_CAP, MANY_NEEDLE_LETTERS


def _quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _any_needle(column: str, fold: bool = False) -> str:
    needles = (n.lower() if fold else n for n in TAG_NEEDLES)
    return " OR ".join(f"instr({column}, '{n}') > 0" for n in needles)


def _listed(values) -> str:
    return f"list_extract([{_quoted(values)}], CAST(floor(c_custkey / 20) % {len(values)} AS INT) + 1)"


def _not_in(table: str) -> str:
    """Rows whose customer is not in `table`; those without a customer stay."""
    return f"NOT EXISTS (SELECT 1 FROM (SELECT customer__id AS barred FROM {table}) WHERE barred = customer__id)"


VIEWS = f"""
collections_daily AS (
  SELECT DISTINCT
    l_orderkey AS collection__id,
    CASE WHEN l_orderkey % 101 <> 0 THEN o_custkey END AS customer__id,
    CASE WHEN o_custkey % 10 < 8 THEN 'person' ELSE 'company' END AS customer__type,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL
         ELSE CAST((l_orderkey * 7 + l_linenumber) % 400 AS INT) END AS product__days_late,
    o_orderstatus AS collection__status,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS collection__cured,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS collection__end,
    'proto_' || CAST((o_custkey + l_orderkey % 2) % 5 AS VARCHAR) AS prototype,
    (DATE '2026-02-28' + l_linenumber) AS date,
    CASE WHEN o_custkey % 3 = 0 OR (o_custkey % 3 = 2 AND l_orderkey % 2 = 0)
         THEN 'cc' ELSE 'll' END AS product
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
collections_cc AS (
  SELECT *, customer__id * 10 AS account__id FROM collections_daily WHERE product = 'cc'),
collections_ll AS (
  SELECT *, collection__id * 10 AS loan__id FROM collections_daily WHERE product = 'll'),
collections_current AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY collection__id ORDER BY date DESC) AS rn
    FROM collections_daily) WHERE rn = 1),
customers AS (
  SELECT c_custkey AS customer__id, 'proto_' || CAST((c_custkey + k) % 5 AS VARCHAR) AS prototype,
    CASE c_custkey % 20
      WHEN 0 THEN ['fraud_id', 'x'] WHEN 1 THEN ['Beta'] WHEN 2 THEN ['suspected']
      WHEN 3 THEN NULL WHEN 4 THEN ['AML'] WHEN 5 THEN ['Customer_group_owner']
      WHEN 6 THEN [NULL, 'ok'] WHEN 7 THEN [{_listed(EXACT_TAGS)}]
      WHEN 8 THEN ['x ' || {_listed(TAG_NEEDLES)} || ' y'] ELSE ['ok'] END AS customer__tags
  FROM customer JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) dup ON (k = 0 OR c_custkey % 4 = 0)
  WHERE c_custkey % 50 <> 49),
tags_daily AS (
  SELECT customer__id, CASE WHEN k = 1 THEN customer__tags ELSE ['ok'] END AS customer__tags,
    (DATE '2026-02-28' + k) AS date
  FROM customers CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) days),
tier_roxinho AS (SELECT o_custkey AS customer__id FROM orders WHERE o_custkey % 7 = 0),
tier_uv AS (SELECT o_custkey AS customer__id FROM orders WHERE o_custkey % 11 = 0),
tier_nu_plus AS (SELECT o_custkey AS customer__id FROM orders WHERE o_custkey % 13 = 0),
tier_u18 AS (SELECT o_custkey AS customer__id FROM orders WHERE o_custkey % 17 = 0),
income_segments AS (
  SELECT c_custkey AS customer__id,
    CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'mass_market'
         WHEN c_mktsegment = 'HOUSEHOLD' THEN 'high_income' ELSE 'super_core'
    END AS income_segments,
    CASE WHEN c_custkey % 6 = 0 THEN DATE '2026-02-01' ELSE DATE '2026-04-01' END AS income_month
  FROM customer
  UNION ALL
  SELECT c_custkey, 'super_core', DATE '2026-05-01' FROM customer WHERE c_custkey % 9 = 0),
collections AS (
  SELECT *, 1 AS is_cc, 0 AS is_ll FROM collections_cc
  UNION ALL BY NAME
  SELECT *, 0 AS is_cc, 1 AS is_ll FROM collections_ll),
forbidden AS (
  SELECT DISTINCT customer__id
  FROM (SELECT customer__id, unnest(customer__tags) AS tag FROM customers)
  WHERE tag IN ({_quoted(EXACT_TAGS)})),
tagged AS (
  SELECT customer__id, lower(tag) AS tag
  FROM (SELECT customer__id, unnest(customer__tags) AS tag FROM tags_daily)),
forbidden_parts AS (SELECT DISTINCT customer__id FROM tagged WHERE {_any_needle("tag")}),
prototypes AS (
  SELECT customer__id, max(prototype) AS prototype FROM customers GROUP BY customer__id),
recent_income AS (
  SELECT * FROM income_segments WHERE income_month >= (SELECT max(date) FROM collections_cc)),
income AS (
  SELECT customer__id, income_segments FROM (
    SELECT *, row_number() OVER (PARTITION BY customer__id
      ORDER BY income_month DESC, income_segments DESC) AS rn FROM recent_income)
  WHERE rn = 1),
base AS (
  SELECT customer__id,
    CASE WHEN late >= 65 THEN 'long' ELSE 'short' END AS lateness,
    CASE WHEN cc >= 1 AND ll >= 1 THEN 'multi_debt' WHEN cc = 0 AND ll >= 1 THEN 'll_only'
         WHEN cc >= 1 AND ll = 0 THEN 'cc_only' ELSE 'error' END AS segment
  FROM (
    SELECT customer__id, max(is_cc) AS cc, max(is_ll) AS ll, max(product__days_late) AS late
    FROM collections
    WHERE date = DATE '2026-03-03' AND customer__type = 'person'
      AND product__days_late >= 5 AND product__days_late <= 365
    GROUP BY customer__id)),
eligible AS (
  SELECT customer__id, lateness, segment, prototype
  FROM base JOIN prototypes USING (customer__id)
  WHERE {_not_in("forbidden")})
"""

_SEGMENT_CASE = """CASE WHEN is_cc >= 1 AND is_ll >= 1 THEN 'multi_debt'
  WHEN is_cc = 0 AND is_ll >= 1 THEN 'll_only'
  WHEN is_cc >= 1 AND is_ll = 0 THEN 'cc_only' ELSE 'error' END"""

_CAP_CASE = (
    "CASE segment || '_' || lateness "
    + " ".join(f"WHEN '{combo}' THEN {cap}" for combo, cap in CAPS.items())
    + f" ELSE {DEFAULT_CAP} END"
)


def _tier(*names: str) -> str:
    flags = "".join(f", 1 AS {name}" for name in names)
    tests = " AND ".join(
        f"customer__id IN (SELECT customer__id FROM tier_{name})" for name in names
    )
    return f"SELECT *{flags} FROM base WHERE {tests}"


def _income(*values: str) -> str:
    return (
        "SELECT base.*, income_segments FROM base JOIN income USING (customer__id) "
        f"WHERE income_segments IN ({_quoted(values)})"
    )


def _capped(rows: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (
      SELECT *, row_number() OVER (PARTITION BY segment, lateness ORDER BY customer__id NULLS FIRST) AS rn
      FROM {rows}) WHERE rn <= {_CAP_CASE}"""


def _unique(table: str, name: str) -> str:
    return f"""SELECT '{name}' AS lookup, count(*) AS keys,
      CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_keys,
      max(n) AS most_rows
      FROM (SELECT customer__id, count(*) AS n FROM {table} GROUP BY customer__id)"""


def _stages(*counts: str) -> str:
    names = ("input", "filtered", "grouped", "compliant", "enriched", "saved")
    return " UNION ALL ".join(
        f"SELECT {i} AS stage_no, '{name}' AS stage, CAST(({count}) AS BIGINT) AS rows"
        for i, (name, count) in enumerate(zip(names, counts), 1)
    )


_CONTACTABLE = _not_in("forbidden")
_PERSONS = "FROM collections WHERE customer__type = 'person'"

SELECTS = {
    "scan_cc_daily": "SELECT * FROM collections_cc",
    "scan_ll_daily": "SELECT * FROM collections_ll",
    "current_snapshot": "SELECT * FROM collections_current",
    "current_snapshot_advanced": "SELECT * FROM collections_current",
    "current_snapshot_bucketed": "SELECT * FROM collections_current",
    "customer_tags_scan": """SELECT customer__id, prototype,
      array_to_string([coalesce(x, '<null>') FOR x IN customer__tags], '|') AS tags
      FROM customers""",
    "source_cc_only": "SELECT *, 1 AS is_cc FROM collections_cc",
    "source_ll_only": "SELECT *, 1 AS is_ll FROM collections_ll",
    "source_union": "SELECT * FROM collections",
    "source_current_union": """SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY collection__id, is_cc ORDER BY date DESC) AS rn
      FROM collections) WHERE rn = 1""",
    "rename_columns": """SELECT collection__id, date, product__days_late, collection__cured,
      is_cc, is_ll FROM collections""",
    "project_columns": "SELECT customer__id, prototype, collection__status FROM collections",
    "filter_snapshot_date": """SELECT collection__id, customer__id, date FROM collections
      WHERE date = DATE '2026-03-03'""",
    "filter_customer_type": """SELECT collection__id, customer__id, date, customer__type
      FROM collections WHERE customer__type = 'company'""",
    "filter_open": """SELECT collection__id, customer__id, date, collection__status
      FROM collections WHERE collection__end IS NULL""",
    "filter_cured": """SELECT collection__id, customer__id, date, collection__cured,
      collection__end FROM collections WHERE collection__cured = 1""",
    "filter_days_late": """SELECT collection__id, customer__id, date, product__days_late
      FROM collections WHERE product__days_late >= 5 AND product__days_late <= 365""",
    "filter_segment": "SELECT * FROM base WHERE segment = 'multi_debt'",
    "recency_filter": "SELECT * FROM recent_income",
    "group_customer": """SELECT customer__id, max(is_cc) AS is_cc, max(is_ll) AS is_ll,
      max(product__days_late) AS product__days_late FROM collections GROUP BY customer__id""",
    "group_customer_prototype": """SELECT customer__id, prototype, max(is_cc) AS is_cc,
      max(is_ll) AS is_ll, max(product__days_late) AS product__days_late
      FROM collections GROUP BY customer__id, prototype""",
    "group_keys_only": "SELECT DISTINCT customer__id FROM collections",
    "latest_date": "SELECT max(date) AS latest_date FROM collections_cc",
    "lateness": """SELECT collection__id, customer__id, date, product__days_late,
      CASE WHEN product__days_late >= 65 THEN 'long' ELSE 'short' END AS lateness
      FROM collections""",
    "segment": f"""SELECT *, {_SEGMENT_CASE} AS segment FROM (
      SELECT customer__id, max(is_cc) AS is_cc, max(is_ll) AS is_ll
      FROM collections GROUP BY customer__id)""",
    "segment_ungrouped": f"""SELECT collection__id, customer__id, date,
      {_SEGMENT_CASE} AS segment FROM collections""",
    "explode_tags": "SELECT customer__id, unnest(customer__tags) AS tag FROM customers",
    "lower_tags": """SELECT customer__id,
      array_to_string([coalesce(lower(x), '<null>') FOR x IN customer__tags], '|')
      AS lowered_tags FROM customers""",
    "forbidden_exact": "SELECT * FROM forbidden",
    "forbidden_substring": "SELECT * FROM forbidden_parts",
    "forbidden_substring_folded": f"""SELECT DISTINCT customer__id FROM tagged
      WHERE {_any_needle("tag", fold=True)}""",
    "forbidden_exact_listed": """SELECT DISTINCT customer__id
      FROM (SELECT customer__id, unnest(customer__tags) AS tag FROM customers) WHERE contains(tag, '_')""",
    "forbidden_substring_many": f"""WITH letters AS (
        SELECT unnest(string_split('{' '.join(MANY_NEEDLE_LETTERS)}', ' ')) AS x),
      needles AS (SELECT a.x || b.x || c.x AS needle FROM letters a, letters b, letters c)
      SELECT DISTINCT customer__id FROM tagged
      WHERE tag IN (SELECT t.tag FROM (SELECT DISTINCT tag FROM tagged) t JOIN needles ON contains(t.tag, needle))""",
    "anti_forbidden": f"SELECT * FROM base WHERE {_CONTACTABLE}",
    "dedup_customers": "SELECT * FROM prototypes",
    "enrich_inner": "SELECT * FROM base JOIN prototypes USING (customer__id)",
    "distinct_tier": "SELECT DISTINCT customer__id FROM tier_roxinho",
    "tier_roxinho": _tier("roxinho"),
    "tier_uv": _tier("uv"),
    "tier_nu_plus": _tier("nu_plus"),
    "tier_u18": _tier("u18"),
    "tier_multi_and": _tier("roxinho", "uv"),
    "tier_flag": """SELECT *, CASE WHEN customer__id IN (SELECT customer__id FROM tier_uv)
      THEN 1 ELSE 0 END AS uv FROM base""",
    "dedup_income": "SELECT * FROM income",
    "income_one": _income("mass_market"),
    "income_two": _income("mass_market", "high_income"),
    "income_all": """SELECT base.*, income_segments
      FROM base LEFT JOIN income USING (customer__id)""",
    "base_all_lookups": """SELECT eligible.*, 1 AS roxinho, income_segments
      FROM eligible JOIN income USING (customer__id)
      WHERE customer__id IN (SELECT customer__id FROM tier_roxinho)
        AND income_segments IN ('mass_market', 'super_core')""",
    "base_tags_and_income": f"""WITH latest AS (
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY collection__id ORDER BY date DESC) AS rn
          FROM collections_ll) WHERE rn = 1),
      fresh AS (SELECT * FROM income_segments
        WHERE income_month >= (SELECT max(date) FROM latest)),
      known AS (SELECT customer__id, income_segments FROM (
        SELECT *, row_number() OVER (PARTITION BY customer__id
          ORDER BY income_month DESC, income_segments DESC) AS rk FROM fresh) WHERE rk = 1)
      SELECT collection__id, customer__id, 1 AS is_ll, income_segments
      FROM latest LEFT JOIN known USING (customer__id)
      WHERE collection__cured = 1
        AND {_not_in("forbidden_parts")}""",
    "base_eligibility_exact": "SELECT * FROM eligible",
    "base_eligibility_renamed": "SELECT * FROM eligible",
    "base_homepage": f"""SELECT customer__id, prototypes.prototype
      FROM (SELECT customer__id {_PERSONS}) JOIN prototypes USING (customer__id)
      WHERE {_CONTACTABLE}""",
    "base_eligibility_substring": f"""SELECT customer__id, prototype,
      CASE WHEN product__days_late >= 60 THEN 'long' ELSE 'short' END AS lateness,
      {_SEGMENT_CASE} AS segment
      FROM (SELECT customer__id, prototype, max(is_cc) AS is_cc, max(is_ll) AS is_ll,
              max(product__days_late) AS product__days_late
            FROM collections WHERE collection__end IS NULL
              AND product__days_late >= 5 AND product__days_late <= 60
            GROUP BY customer__id, prototype)""",
    "base_pdp": f"""SELECT customer__id, prototype FROM collections
      WHERE collection__end IS NULL AND {_not_in("forbidden_parts")}""",
    "base_pdp_own_needles": f"""SELECT customer__id, prototype FROM collections
      WHERE collection__end IS NULL AND {_not_in("(SELECT * FROM tagged WHERE instr(tag, 'spect') > 0 OR instr(tag, 'owner') > 0)")}""",
    "base_open_only": """SELECT customer__id, prototype FROM collections
      WHERE collection__end IS NULL""",
    "limit_rows_check": """SELECT 100 AS cap, least(count(*), 100) AS rows_kept,
      least(count(*), 100) AS rows_of_base FROM base""",
    "limit_stable": "SELECT * FROM base ORDER BY customer__id NULLS FIRST LIMIT 100",
    "limit_stable_large": "SELECT * FROM base ORDER BY customer__id NULLS FIRST LIMIT 1200",
    "limit_per_combo_large": """SELECT customer__id, customer__type, date FROM (
      SELECT customer__id, customer__type, date, row_number() OVER (
        PARTITION BY customer__type ORDER BY customer__id NULLS FIRST, date) AS rn FROM collections)
      WHERE rn <= 1500""",
    "limit_stable_whole": """SELECT date, customer__id, collection__id, product__days_late FROM collections
      ORDER BY date, customer__id NULLS FIRST, collection__id, product__days_late NULLS FIRST LIMIT 3000""",
    "limit_per_combo_named": """SELECT customer__id, customer__type, date, collection__id FROM (
      SELECT *, row_number() OVER (PARTITION BY customer__type
        ORDER BY date, customer__id NULLS FIRST, collection__id) AS rn FROM collections)
      WHERE rn <= 1100 OR customer__type <> 'company'""",
    "limit_rows_large_check": """SELECT 2500 AS cap, least(count(*), 2500) AS rows_kept,
      least(count(*), 2500) AS rows_of_base FROM collections""",
    "limit_per_combo": _capped("base", "customer__id, lateness, segment"),
    "save_roundtrip": "SELECT * FROM eligible",
    "save_replaced": "SELECT * FROM eligible WHERE lateness = 'long'",
    "split_replaced": """SELECT *, 'replaced_' || lateness AS saved_as
      FROM eligible WHERE lateness IN ('short', 'long')""",
    "csv_roundtrip": "SELECT * FROM eligible",
    "split_by_segment": """SELECT *, 'base_by_segment_' || segment AS saved_as FROM eligible
      WHERE segment IN ('cc_only', 'll_only', 'multi_debt')""",
    "split_by_lateness": """SELECT *, 'base_by_lateness_' || lateness AS saved_as
      FROM eligible WHERE lateness IN ('short', 'long')""",
    "split_cross": """SELECT *, 'base_by_segment_lateness_' || segment || '_' || lateness
      AS saved_as FROM eligible WHERE segment IN ('cc_only', 'll_only', 'multi_debt')""",
    "split_cross_capped": _capped(
        "(SELECT * FROM eligible WHERE segment IN ('cc_only', 'multi_debt'))",
        "customer__id, lateness, segment, prototype, "
        "'base_by_segment_lateness_' || segment || '_' || lateness AS saved_as",
    ),
    "check_unique_key": " UNION ALL ".join(
        _unique(table, name)
        for table, name in (
            ("customers", "customers"),
            ("prototypes", "customers_deduplicated"),
            ("recent_income", "income"),
            ("income", "income_deduplicated"),
            ("tier_roxinho", "tier"),
            ("(SELECT DISTINCT customer__id FROM tier_roxinho)", "tier_deduplicated"),
        )
    ),
    "check_repeated_keys": """SELECT customer__id, count(*) AS rows FROM customers
      GROUP BY customer__id HAVING count(*) > 1""",
    "check_cured_open": """SELECT count(*) AS rows,
      count(*) FILTER (collection__cured = 1) AS cured,
      count(*) FILTER (collection__end IS NULL) AS open,
      count(*) FILTER (collection__cured = 1 AND collection__end IS NULL) AS cured_and_open
      FROM collections""",
    "segment_counts": "SELECT segment, count(*) AS rows FROM base GROUP BY segment",
    "stage_counts": _stages(
        "SELECT count(*) FROM collections",
        """SELECT count(*) FROM collections WHERE date = DATE '2026-03-03'
           AND customer__type = 'person' AND product__days_late BETWEEN 5 AND 365""",
        "SELECT count(*) FROM base",
        f"SELECT count(*) FROM base WHERE {_CONTACTABLE}",
        "SELECT count(*) FROM eligible",
        "SELECT least(count(*), 100000) FROM eligible",
    ),
    "stage_counts_ungrouped": _stages(
        "SELECT count(*) FROM collections",
        f"SELECT count(*) {_PERSONS}",
        f"SELECT count(*) {_PERSONS}",
        f"SELECT count(*) {_PERSONS} AND {_CONTACTABLE}",
        f"""SELECT count(*) {_PERSONS} AND {_CONTACTABLE}
            AND customer__id IN (SELECT customer__id FROM customers)""",
        f"""SELECT least(count(*), 50000) {_PERSONS} AND {_CONTACTABLE}
            AND customer__id IN (SELECT customer__id FROM customers)""",
    ),
}


def oracle_queries() -> dict[str, str]:
    """Every query but `limit_rows` and `base_homepage_capped`, which keep arbitrary rows."""

    def with_views(select: str) -> str:
        if select.startswith("WITH "):
            return f"WITH {VIEWS.strip()},\n{select[len('WITH '):].strip()}"
        return f"WITH {VIEWS.strip()}\n{select}"

    same = {
        "base_pdp_staged": "base_pdp",
        "base_pdp_prefiltered": "base_pdp",
        "group_customer_partials": "group_customer",
        "base_eligibility_partials": "base_eligibility_substring",
    }
    selects = {**SELECTS, **{name: SELECTS[other] for name, other in same.items()}}
    return {name: with_views(select) for name, select in selects.items()}
