"""The security model, derived from the test tables.

Parts play the products; their type decides the subtype tables.  Line items play coupons
and ratings, suppliers the legal entities.  One SQL text per table serves both engines.
"""

from __future__ import annotations

from .inputs import FIRST_DAY, VERSION, plain

_HISTORY = (
    f"DATE '{FIRST_DAY}' AS effective_start_date, DATE '9999-12-31' AS effective_end_date, "
    f"TRUE AS is_current, '{VERSION}' AS _dq_rule_version"
)
_ID = "concat('P', CAST(p_partkey AS STRING))"
_LINE_ID = "concat('P', CAST(l_partkey AS STRING))"
_TYPE = (
    "CASE p_type WHEN 'MEDIUM' THEN 'EQUITY' WHEN 'LARGE' THEN 'FUND' "
    "WHEN 'SMALL' THEN 'DERIVATIVE' WHEN 'PROMO' THEN 'RIGHT' ELSE 'DEBT' END"
)
_SUB_TYPE = (
    "CASE p_type WHEN 'STANDARD' THEN 'MUNI' "
    "WHEN 'ECONOMY' THEN CASE WHEN p_size <= 25 THEN 'BOND' ELSE 'POOL_BACKED' END "
    "WHEN 'MEDIUM' THEN CASE WHEN p_size <= 30 THEN 'COMMON_STOCK' ELSE 'PREFERRED_STOCK' END "
    "WHEN 'SMALL' THEN CASE WHEN p_size <= 30 THEN 'OPTION' ELSE 'FUTURE' END END"
)
_STATUS = (
    "CASE WHEN p_size <= 40 THEN 'ACTIVE' WHEN p_size <= 45 THEN 'INACTIVE' ELSE 'MATURED' END"
)
def _versions(start: str, end: str, current: str, where: str) -> str:
    return f"""
SELECT {_ID} AS product_id,
  CASE WHEN p_size <= 20 THEN 'ISIN' ELSE 'CUSIP' END AS id_type,
  {_TYPE} AS type, {_SUB_TYPE} AS sub_type, {_STATUS} AS status, p_name AS description,
  concat('E', CAST(issuer AS STRING)) AS issuer_legal_entity_id, issue_date,
  CAST(p_retailprice AS DECIMAL(28,8)) AS issue_price,
  CAST(p_retailprice * 100 AS DECIMAL(28,8)) AS current_face_value,
  DATE '{start}' AS effective_start_date, DATE '{end}' AS effective_end_date,
  {current} AS is_current, '{VERSION}' AS _dq_rule_version
FROM {{part}}
LEFT JOIN (
  SELECT l_partkey, MIN(l_suppkey) AS issuer, CAST(MIN(l_shipdate) AS DATE) AS issue_date
  FROM {{lineitem}} GROUP BY l_partkey) i ON p_partkey = l_partkey
WHERE {where}"""


# Every product has a current version; small parts also have a closed one.
_PRODUCT = (
    _versions(FIRST_DAY, "9999-12-31", "TRUE", "p_size >= 0")
    + "\nUNION ALL"
    + _versions("2023-01-01", FIRST_DAY, "FALSE", "p_size <= 10")
)


def _subtype(columns: str, where: str) -> str:
    return f"SELECT {_ID} AS product_id, {columns}, {_HISTORY} FROM {{part}} WHERE {where}"


MODEL = {
    "product": _PRODUCT,
    "identifiers": f"""
SELECT {_ID} AS product_id,
  CASE WHEN p_size <= 20 THEN concat('US', lpad(CAST(p_partkey AS STRING), 10, '0')) END AS isin,
  CASE WHEN p_size <= 30 THEN lpad(CAST(p_partkey AS STRING), 9, 'C') END AS cusip,
  CASE WHEN p_size <= 38 THEN lpad(CAST(p_partkey AS STRING), 7, 'S') END AS sedol,
  CASE WHEN p_size <= 44 THEN concat('BBG', CAST(p_partkey AS STRING)) END AS bloomberg_id,
  CASE WHEN p_size <= 48 THEN p_brand END AS bloomberg_ticker
FROM {{part}}""",
    "stock": _subtype(
        "p_size <= 30 AS has_voting_rights, p_brand AS series_id, 'DTC' AS depository_type",
        "p_type = 'MEDIUM'",
    ),
    "preferred_stock": _subtype(
        "CASE WHEN p_size <= 40 THEN 'CUMULATIVE' ELSE 'PARTICIPATING' END AS dividend_right",
        "p_type = 'MEDIUM' AND p_size > 30",
    ),
    "fund": _subtype(
        "CASE WHEN p_size <= 25 THEN 'OPEN_END' ELSE 'CLOSED_END' END AS endness_type, "
        "CASE WHEN p_size <= 15 THEN 'EQUITY' ELSE 'BALANCED' END AS mutual_fund_type",
        "p_type = 'LARGE'",
    ),
    "debt": _subtype(
        "CAST(p_retailprice * 1000 AS DECIMAL(28,8)) AS total_amount_issued",
        "p_type IN ('ECONOMY', 'STANDARD')",
    ),
    "bond": _subtype(
        "CASE WHEN p_size <= 10 THEN 'FIXED' ELSE 'FLOATING' END AS coupon_type, "
        "DATE '2030-06-30' AS maturity_date, "
        "CASE WHEN p_size <= 15 THEN 'USD' ELSE 'EUR' END AS issue_currency_code",
        "p_type = 'STANDARD' OR (p_type = 'ECONOMY' AND p_size <= 25)",
    ),
    "muni": _subtype(
        "CASE WHEN p_size <= 25 THEN 'REVENUE' ELSE 'GENERAL_OBLIGATION' END AS pledge_type",
        "p_type = 'STANDARD'",
    ),
    "pool_backed_security": _subtype(
        "CAST(p_size AS DECIMAL(18,8)) AS weighted_average_coupon, "
        "CAST(p_size * 0.5 AS DECIMAL(18,8)) AS net_coupon",
        "p_type = 'ECONOMY' AND p_size > 25",
    ),
    "listed_derivative": _subtype(
        "p_brand AS series_id, DATE '1996-06-30' AS last_trade_date, p_size AS contract_month",
        "p_type = 'SMALL'",
    ),
    "option": _subtype(
        "CASE WHEN p_size <= 15 THEN 'CALL' ELSE 'PUT' END AS option_type, "
        "'EUROPEAN' AS exercise_style, CAST(p_retailprice AS DECIMAL(28,8)) AS strike_price",
        "p_type = 'SMALL' AND p_size <= 30",
    ),
    "future": _subtype(
        "DATE '2025-03-01' AS first_delivery_datetime_utc, "
        "DATE '2025-03-31' AS last_delivery_datetime_utc, 'CASH_SETTLED' AS valuation_method",
        "p_type = 'SMALL' AND p_size > 30",
    ),
    "coupon": f"""
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS coupon_id,
  {_LINE_ID} AS bond_id, CAST(l_discount * 100 AS DECIMAL(18,8)) AS coupon_rate,
  CAST(l_shipdate AS DATE) AS payment_date,
  CASE l_returnflag WHEN 'A' THEN 'FIXED' ELSE 'FLOATING' END AS coupon_type,
  CASE l_linestatus WHEN 'O' THEN 'ANNUAL' ELSE 'MONTHLY' END AS frequency
FROM {{lineitem}}
WHERE l_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_type IN ('ECONOMY', 'STANDARD'))""",
    "product_rating": f"""
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS product_rating_id,
  {_LINE_ID} AS product_id, concat('T', CAST(l_linenumber AS STRING)) AS product_rating_type_id,
  CASE l_linestatus WHEN 'O' THEN 'SP' ELSE 'MOODYS' END AS rating_agency,
  CASE l_returnflag WHEN 'A' THEN 'AAA' WHEN 'N' THEN 'BBB' ELSE 'CCC' END AS rating_code,
  CAST(l_shipdate AS DATE) AS effective_from_date, 'STABLE' AS watch_code,
  DATE '{FIRST_DAY}' AS effective_start_date, DATE '9999-12-31' AS effective_end_date,
  l_quantity > 5 AS is_current, '{VERSION}' AS _dq_rule_version
FROM {{lineitem}}""",
    "product_rating_type": """
SELECT DISTINCT concat('T', CAST(l_linenumber AS STRING)) AS product_rating_type_id,
  CASE WHEN l_linenumber <= 3 THEN 'LONG_TERM' ELSE 'SHORT_TERM' END AS rating_scale,
  'ISSUE' AS rating_type_code
FROM {lineitem}""",
    "legal_entity": f"""
SELECT concat('E', CAST(s_suppkey AS STRING)) AS legal_entity_id, s_name AS legal_name,
  CASE WHEN s_acctbal < 3000 THEN 'LLC' ELSE 'CORP' END AS legal_structure,
  n_name AS country, 'CORPORATE' AS entity_type,
  DATE '{FIRST_DAY}' AS effective_start_date, DATE '9999-12-31' AS effective_end_date,
  s_acctbal >= 0 AS is_current, '{VERSION}' AS _dq_rule_version
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey""",
}


class SecurityModel(dict):
    def __init__(self, tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, name: str):
        self[name] = self.tables.view(MODEL[name])
        return self[name]


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named model tables for the SQL twin."""
    return "WITH " + ", ".join(f'm_{n} AS ({plain(MODEL[n])})' for n in names)
