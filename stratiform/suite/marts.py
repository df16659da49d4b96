"""Gold marts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import Branch, coverage, flatten
from ..operators.projections import coalesce_priority
from ..operators.windows import latest_per_key, top_rows
from ..plans import marts as m
from ..plans.gold import build_gold
from . import Tables, query
from .inputs import FIRST_DAY
from .model import ctes

BUILT = f"{FIRST_DAY} 00:00:00"
BUILT_AT = datetime.fromisoformat(BUILT)


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, build times left out."""
    out = [
        F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, T.DecimalType)
        else F.col(f.name)
        for f in df.schema.fields
        if not isinstance(f.dataType, T.TimestampType)
    ]
    return df.select(*out)


@query(
    """
WITH latest AS (
  SELECT * FROM (
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_day,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1)
SELECT c_custkey, c_name, c_mktsegment, n_name, r_name, o_orderkey AS latest_order,
  o_day AS latest_order_date, o_totalprice AS latest_total,
  CASE WHEN o_orderkey IS NOT NULL THEN 'ORDER' WHEN n_name IS NOT NULL THEN 'NATION' END AS best_source,
  coalesce(CAST(o_orderkey AS VARCHAR), n_name) AS best_value
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN latest ON c_custkey = o_custkey
WHERE c_acctbal >= 0
""",
    headline=True,
)
def flagship_customer_mart(t: Tables) -> DataFrame:
    customer = t.customer.withColumn("is_current", F.col("c_acctbal") >= 0)
    orders = t.orders.select(
        "o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("o_day")
    )
    latest = latest_per_key(orders, ["o_custkey"], [F.desc("o_day")], [F.desc("o_orderkey")])
    wide = flatten(
        customer.filter("is_current"),
        [
            Branch(t.nation, "c_nationkey", "n_nationkey",
                   {"n_name": "n_name", "_region": "n_regionkey"}),
            Branch(t.region, "_region", "r_regionkey", {"r_name": "r_name"}),
            Branch(latest, "c_custkey", "o_custkey",
                   {"latest_order": "o_orderkey", "latest_order_date": "o_day",
                    "latest_total": "o_totalprice"}),
        ],
    )
    wide = wide.withColumn("_order", F.col("latest_order").cast("string"))
    label, value = coalesce_priority([("ORDER", "_order"), ("NATION", "n_name")])
    return wide.select(
        "c_custkey", "c_name", "c_mktsegment", "n_name", "r_name", "latest_order",
        "latest_order_date", "latest_total", label.alias("best_source"), value.alias("best_value"),
    )


# The wide mart again, independently of ``plans/marts.py``: every attribute is looked up for
# each product by a subquery of its own.  Output name -> column of the table.
_SUBTYPES = {
    "stock": {"common_stock_voting_rights": "has_voting_rights", "stock_series_id": "series_id"},
    "preferred_stock": {"preferred_stock_dividend_type": "dividend_right"},
    "fund": {"fund_endness_type": "endness_type", "fund_mutual_fund_type": "mutual_fund_type"},
    "debt": {"debt_face_amount": "total_amount_issued"},
    "bond": {"bond_face_currency_code": "issue_currency_code"},
    "muni": {"muni_pledge_type": "pledge_type"},
    "pool_backed_security": {"pool_backed_wac": "weighted_average_coupon",
                             "pool_backed_net_coupon": "net_coupon"},
    "listed_derivative": {"derivative_series_id": "series_id"},
    "option": {"option_type": "option_type", "option_exercise_style": "exercise_style",
               "option_strike_price": "strike_price"},
    "future": {"future_first_delivery_dt": "first_delivery_datetime_utc",
               "future_valuation_method": "valuation_method"},
}
_ISSUER = {"issuer_legal_name": "legal_name", "issuer_legal_structure": "legal_structure"}
_RATING = {"latest_rating_value": "rating_code", "latest_rating_date": "effective_from_date",
           "latest_rating_agency": "rating_agency", "latest_rating_type_id": "product_rating_type_id"}
_KNOWN_BY = {"ISIN": "isin", "CUSIP": "cusip", "SEDOL": "sedol", "BLOOMBERG_ID": "bloomberg_id",
             "TICKER": "bloomberg_ticker"}
_OWN = (
    "product_id", "id_type", "type", "sub_type", "status", "description", "issuer_legal_entity_id",
    "issue_date", "issue_price", "current_face_value", "effective_start_date",
    "effective_end_date", "_dq_rule_version",
)
_DOUBLES = {
    "issue_price", "current_face_value", "debt_face_amount", "pool_backed_wac",
    "pool_backed_net_coupon", "latest_coupon_rate", "option_strike_price",
}


def _wide_sql() -> str:
    def shown(name: str, value: str) -> str:
        return f"CAST({value} AS DOUBLE) AS {name}" if name in _DOUBLES else f"{value} AS {name}"

    def found(table: str, where: str, columns: dict) -> list[str]:
        return [
            shown(n, f"(SELECT any_value(x.{c}) FROM {table} x WHERE {where})")
            for n, c in columns.items()
        ]

    same = "x.product_id = p.product_id"
    known = ", ".join(f"{{'k': '{k}', 'v': x.{c}}}" for k, c in _KNOWN_BY.items())
    first = f"list_filter([{known}], lambda y: y.v IS NOT NULL)[1]"
    newest = "{'d': x.payment_date, 'r': x.coupon_rate}"
    columns = [shown(c, f"p.{c}") for c in _OWN]
    columns += found("m_legal_entity", "x.legal_entity_id = p.issuer_legal_entity_id AND x.is_current", _ISSUER)
    for name, of in _SUBTYPES.items():
        columns += found(f"m_{name}", f"{same} AND x.is_current", of)
    columns += found("newest_rating", same, _RATING)
    for name, field in (("primary_id_type", "k"), ("primary_identifier_value", "v")):
        columns.append(f"(SELECT any_value(({first}).{field}) FROM m_identifiers x WHERE {same}) AS {name}")
    for name, c in (("latest_coupon_rate", "coupon_rate"), ("latest_coupon_payment_date", "payment_date")):
        of = f"(SELECT max_by(x.{c}, {newest}) FROM m_coupon x WHERE x.bond_id = p.product_id)"
        columns.append(shown(name, of))
    columns.append("CAST(NULL AS VARCHAR) AS derivative_underlying_product_id")
    return f""",
newest_rating AS (
  FROM m_product_rating WHERE is_current QUALIFY 1 = row_number() OVER (PARTITION BY product_id
    ORDER BY effective_from_date DESC, rating_code, rating_agency, product_rating_type_id)),
wide AS (SELECT {", ".join(columns)} FROM m_product p WHERE p.is_current)
"""


WIDE = _wide_sql()
WIDE_SQL = (
    ctes(
        "product", "identifiers", "legal_entity", "stock", "preferred_stock", "fund", "debt",
        "bond", "muni", "pool_backed_security", "coupon", "listed_derivative", "option", "future",
        "product_rating", "product_rating_type",
    )
    + WIDE
)


def _wide(t: Tables) -> DataFrame:
    return m.wide_mart(t.model, BUILT)


@query(WIDE_SQL + "SELECT * FROM wide", headline=True)
def gold_wide_mart(t: Tables) -> DataFrame:
    return comparable(_wide(t))


@query(
    WIDE_SQL
    + """SELECT * EXCLUDE (net), CAST(CASE WHEN sub_type IN ('BOND', 'MUNI') THEN net END AS DOUBLE)
  AS net_settlement_amount FROM (
  SELECT w.*, CAST(p.current_face_value * (1 + (SELECT
    max_by(x.coupon_rate, {'d': x.payment_date, 'r': x.coupon_rate}) FROM m_coupon x
    WHERE x.bond_id = w.product_id)) AS DECIMAL(18,6)) AS net
  FROM wide w JOIN m_product p ON w.product_id = p.product_id AND p.is_current)"""
)
def gold_add_column(t: Tables) -> DataFrame:
    return comparable(m.add_gold_column(_wide(t), m.net_settlement()))


@query(
    WIDE_SQL
    + """SELECT w.*, s.status AS issuer_status FROM wide w
  LEFT JOIN (SELECT concat('E', CAST(s_suppkey AS VARCHAR)) AS k,
    CASE WHEN s_acctbal < 0 THEN 'IN_ARREARS' ELSE 'GOOD' END AS status FROM supplier) s
  ON w.issuer_legal_entity_id = s.k"""
)
def gold_surface_column(t: Tables) -> DataFrame:
    source = t.supplier.select(
        F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("k"),
        F.when(F.col("s_acctbal") < 0, "IN_ARREARS").otherwise("GOOD").alias("status"),
    )
    mart = m.add_gold_column(
        _wide(t), source=source, mart_key="issuer_legal_entity_id", source_key="k",
        source_column="status", name="issuer_status",
    )
    return comparable(mart)


@query(WIDE_SQL + "SELECT * FROM wide")
def gold_build(t: Tables) -> DataFrame:
    """The mart written by type, checked as stored and read back, twice at one time."""
    root = t.scratch("gold")
    for _ in range(2):
        stored = build_gold(t.spark, t.model, root, BUILT_AT)
    return comparable(stored)


@query(
    WIDE_SQL
    + """SELECT type, count(*) AS n_securities FROM wide GROUP BY type"""
)
def gold_question(t: Tables) -> DataFrame:
    """A question answered from the stored mart."""
    return m.by_type(build_gold(t.spark, t.model, t.scratch("gold"), BUILT_AT))


@query(
    WIDE_SQL
    + """SELECT 'GOLD-GRAIN' AS check_id, CAST(count(*) - count(DISTINCT product_id) AS BIGINT) AS measure,
  CASE WHEN count(*) = count(DISTINCT product_id) THEN 'PASS' ELSE 'FAIL' END AS result FROM wide
UNION ALL SELECT 'GOLD-NULL-KEY', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END
  FROM wide WHERE product_id IS NULL
UNION ALL SELECT 'GOLD-DOMAIN', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END
  FROM wide WHERE type NOT IN ('EQUITY', 'DEBT', 'FUND', 'DERIVATIVE', 'RIGHT')
UNION ALL SELECT 'GOLD-NONEMPTY', count(*), CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END
  FROM wide""",
    headline=True,
)
def gold_checks(t: Tables) -> DataFrame:
    return m.mart_checks(_wide(t))


@query(
    WIDE_SQL
    + """SELECT (SELECT count(*) FROM wide) AS mart_rows,
  (SELECT count(*) FROM m_product WHERE is_current) AS source_rows, 'PASS' AS result"""
)
def gold_reconcile(t: Tables) -> DataFrame:
    return m.reconcile(_wide(t), t.model["product"])


@query(
    WIDE_SQL
    + """SELECT p.product_id, p.id_type, p.type, p.sub_type, p.status, p.description, p.issue_date,
  CAST(p.issue_price AS DOUBLE) AS issue_price,
  CAST(p.current_face_value AS DOUBLE) AS current_face_value, p.issuer_legal_entity_id,
  w.issuer_legal_name, coalesce(w.stock_series_id, w.derivative_series_id) AS series_id,
  w.preferred_stock_dividend_type AS dividend_right, w.fund_endness_type AS endness_type,
  w.fund_mutual_fund_type AS mutual_fund_type, w.debt_face_amount AS total_amount_issued,
  b.coupon_type, b.maturity_date, w.muni_pledge_type AS pledge_type, w.option_type,
  w.option_strike_price AS strike_price, w.future_valuation_method AS valuation_method,
  p.effective_start_date, p.effective_end_date, p._dq_rule_version
FROM m_product p JOIN wide w ON p.product_id = w.product_id
LEFT JOIN m_bond b ON p.product_id = b.product_id WHERE p.is_current"""
)
def gold_dim(t: Tables) -> DataFrame:
    return comparable(m.product_dimension(t.model, BUILT))


@query(
    ctes("legal_entity")
    + """SELECT legal_entity_id, legal_name, country, entity_type, effective_start_date,
  effective_end_date, _dq_rule_version FROM m_legal_entity WHERE is_current"""
)
def gold_entity(t: Tables) -> DataFrame:
    return comparable(m.entity_dimension(t.model, BUILT))


@query(
    ctes("product", "product_rating", "product_rating_type")
    + """SELECT r.product_rating_id, r.product_id, r.product_rating_type_id, r.rating_agency,
  r.rating_code AS rating_value, r.effective_from_date, r.watch_code, y.rating_scale,
  y.rating_type_code, p.type AS product_type, p.status AS product_status,
  r.effective_start_date, r.effective_end_date, r._dq_rule_version
FROM m_product_rating r
LEFT JOIN m_product_rating_type y ON r.product_rating_type_id = y.product_rating_type_id
LEFT JOIN m_product p ON r.product_id = p.product_id AND p.is_current
WHERE r.is_current""",
    headline=True,
)
def gold_rating(t: Tables) -> DataFrame:
    return comparable(m.rating_fact(t.model, BUILT))


@query(
    ctes("product", "coupon", "bond")
    + """SELECT c.coupon_id, c.bond_id AS product_id, CAST(c.coupon_rate AS DOUBLE) AS coupon_rate,
  c.payment_date, c.coupon_type, c.frequency, b.coupon_type AS bond_coupon_type, b.maturity_date,
  b.issue_currency_code AS face_currency_code, p.status AS product_status,
  p.issuer_legal_entity_id, p.issue_date
FROM m_coupon c JOIN m_product p ON c.bond_id = p.product_id AND p.is_current
LEFT JOIN m_bond b ON c.bond_id = b.product_id AND b.is_current""",
    headline=True,
)
def gold_schedule(t: Tables) -> DataFrame:
    return comparable(m.coupon_schedule(t.model, BUILT))


@query(WIDE_SQL + "SELECT type, count(*) AS n_securities FROM wide GROUP BY type")
def portfolio_by_type(t: Tables) -> DataFrame:
    return m.by_type(_wide(t))


@query(WIDE_SQL + "SELECT type, sub_type, count(*) AS row_count FROM wide GROUP BY type, sub_type")
def count_by(t: Tables) -> DataFrame:
    return m.by_type_and_subtype(_wide(t))


@query(
    WIDE_SQL
    + """SELECT bond_face_currency_code, count(*) AS n_securities FROM wide
GROUP BY bond_face_currency_code"""
)
def portfolio_by_currency(t: Tables) -> DataFrame:
    return m.by_currency(_wide(t))


@query(
    WIDE_SQL
    + "SELECT issuer_legal_name, count(*) AS n_securities FROM wide GROUP BY issuer_legal_name"
)
def portfolio_by_issuer(t: Tables) -> DataFrame:
    return m.by_issuer(_wide(t))


@query(
    WIDE_SQL
    + """SELECT type, round(avg(latest_coupon_rate), 6) AS avg_coupon_rate FROM wide GROUP BY type"""
)
def portfolio_average_rate(t: Tables) -> DataFrame:
    return m.average_rate_by_type(_wide(t))


@query(
    ctes("product")
    + """SELECT type, CAST(sum(issue_price) AS DOUBLE) AS total FROM m_product
WHERE is_current GROUP BY type"""
)
def portfolio_total(t: Tables) -> DataFrame:
    return comparable(m.total_by_type(_wide(t), "issue_price"))


@query(
    WIDE_SQL
    + """SELECT product_id, description, type FROM wide
WHERE latest_rating_value = 'AAA' AND latest_rating_agency = 'SP'"""
)
def portfolio_rated(t: Tables) -> DataFrame:
    return m.rated(_wide(t), "AAA", "SP")


@query(
    WIDE_SQL
    + """SELECT product_id, description, latest_coupon_rate FROM wide WHERE type = 'DEBT'
ORDER BY latest_coupon_rate DESC NULLS LAST, product_id LIMIT 10"""
)
def top_rows_by_rate(t: Tables) -> DataFrame:
    mart = _wide(t).filter("type = 'DEBT'")
    rows = mart.select("product_id", "description", "latest_coupon_rate")
    return comparable(top_rows(rows, "latest_coupon_rate", 10, [F.asc("product_id")]))


@query(
    ctes("product", "legal_entity")
    + """SELECT count(*) AS missing_rows, count(DISTINCT issuer_legal_entity_id) AS missing_keys
FROM m_product p WHERE p.is_current AND p.issuer_legal_entity_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM m_legal_entity e WHERE e.is_current
  AND e.legal_entity_id = p.issuer_legal_entity_id)"""
)
def coverage_of_issuers(t: Tables) -> DataFrame:
    mart = t.model["product"].filter("is_current")
    entities = t.model["legal_entity"].filter("is_current")
    return coverage(mart, entities, "issuer_legal_entity_id", "legal_entity_id")
