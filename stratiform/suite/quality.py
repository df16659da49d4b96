"""Data-quality rules on the faulty customer table and on the security model."""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import quality as q
from ..operators.governance import sla_check as sla_of
from ..operators.windows import first_per_key
from ..plans import security_rules as R
from ..plans.security_rules import security_rules
from . import Tables, query
from .inputs import DIRTY, VERSION, plain
from .model import MODEL, ctes

D = f"WITH d AS ({plain(DIRTY)}) "
ROWS = "SELECT custkey, name, nationkey, balance, segment FROM d WHERE "
AT = datetime(2024, 2, 1)

SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NAME = "^Customer#[0-9]{9}$"


def rules() -> list[q.Rule]:
    """The rule set of the faulty customer table."""
    return [
        q.enum_rule("C01", "customer", "segment", SEGMENTS, q.HIGH, issues="K1;K2"),
        q.not_null_rule("C02", "customer", "name", q.CRITICAL, issues="K3"),
        q.unique_rule("C03", "customer", ["custkey"], q.CRITICAL),
        q.unique_rule("C04", "customer", ["nationkey", "segment"], q.LOW),
        q.regex_rule("C05", "customer", "name", NAME, q.MEDIUM, issues="K3;K4"),
        q.trim_rule("C06", "customer", "name", q.LOW),
        q.range_rule("C07", "customer", "balance", 0.0, severity=q.MEDIUM, issues="K9"),
        q.fk_rule("C08", "customer", "nationkey", "nation", "n_nationkey", q.HIGH),
        q.not_null_rule("C09", "customer", "segment", q.MEDIUM, enabled=False),
        q.not_null_rule(
            "C10", "customer", "nationkey", q.LOW, scope=lambda: F.col("segment") == "BUILDING"
        ),
    ]


# What each enabled rule of the set finds, as conditions over ``d``.
FAILS = {
    "C01": "segment IS NOT NULL AND segment NOT IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')",
    "C02": "name IS NULL OR trim(name) = ''",
    "C03": "custkey IN (SELECT custkey FROM d GROUP BY custkey HAVING count(*) > 1)",
    "C04": "n_same > 1",
    "C05": "name IS NOT NULL AND name <> '' AND NOT regexp_matches(name, '^Customer#[0-9]{9}$')",
    "C06": "name IS NOT NULL AND name <> trim(name)",
    "C07": "balance IS NOT NULL AND NOT (balance >= 0)",
    "C08": "nationkey IS NOT NULL AND nationkey NOT IN (SELECT n_nationkey FROM nation)",
    "C10": "coalesce(segment = 'BUILDING', FALSE) AND nationkey IS NULL",
}
REJECTING = ("C01", "C02", "C03", "C08")
DQ = D + ", e AS (SELECT *, count(*) OVER (PARTITION BY nationkey, segment) AS n_same FROM d) "
DETAIL = {
    "C01": "concat('ENUM_MEMBERSHIP segment: ', coalesce(segment, 'NULL'))",
    "C02": "concat('NOT_NULL name: ', coalesce(name, 'NULL'))",
    "C03": "concat('PRIMARY_KEY_UNIQUE custkey: ', CAST(custkey AS VARCHAR))",
    "C05": "concat('REGEX_FORMAT name: ', coalesce(name, 'NULL'))",
    "C07": "concat('RANGE_CHECK balance: ', CAST(balance AS VARCHAR))",
    "C08": "concat('FOREIGN_KEY nationkey: ', CAST(nationkey AS VARCHAR))",
}


def _dirty(t: Tables) -> DataFrame:
    return t.view(DIRTY)


def _failing(t: Tables, number: str) -> DataFrame:
    rule = next(r for r in rules() if r.rule_id == number)
    return q.failing_rows(_dirty(t), rule, {"nation": t.nation})


def _evaluated(t: Tables) -> DataFrame:
    return q.evaluate(_dirty(t), rules(), {"nation": t.nation})


# --- one query per rule type ----------------------------------------------------------------


@query(D + ROWS + FAILS["C01"])
def dq_enum(t: Tables) -> DataFrame:
    return _failing(t, "C01")


@query(D + ROWS + FAILS["C02"])
def dq_not_null(t: Tables) -> DataFrame:
    return _failing(t, "C02")


@query(
    """SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey IN (
  SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
    headline=True,
)
def dq_primary_key(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice")
    return q.failing_rows(rows, q.unique_rule("R", "lineitem", ["l_orderkey"]))


@query(DQ + "SELECT custkey, name, nationkey, balance, segment FROM e WHERE n_same > 1")
def dq_composite_key(t: Tables) -> DataFrame:
    return _failing(t, "C04")


@query(
    """SELECT doc_id, source, lang FROM documents WHERE text IN (
  SELECT text FROM documents WHERE trim(text) <> '' GROUP BY text HAVING count(DISTINCT source) > 1)"""
)
def dq_business_key(t: Tables) -> DataFrame:
    rule = q.owner_rule("R", "documents", "text_hash", "source")
    text_hash = F.when(F.trim("text") != "", F.sha2("text", 256)).alias("text_hash")
    docs = t.documents.select("doc_id", "source", "lang", text_hash)
    return q.failing_rows(docs, rule).select("doc_id", "source", "lang")


@query(D + ROWS + FAILS["C05"])
def dq_regex(t: Tables) -> DataFrame:
    return _failing(t, "C05")


@query(D + ROWS + FAILS["C06"])
def dq_trim(t: Tables) -> DataFrame:
    return _failing(t, "C06")


@query(D + ROWS + FAILS["C07"])
def dq_range(t: Tables) -> DataFrame:
    return _failing(t, "C07")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > DATE '1998-01-01'")
def dq_not_in_future(t: Tables) -> DataFrame:
    rule = q.not_future_rule("R", "orders", "o_orderdate", date(1998, 1, 1))
    return q.failing_rows(t.orders, rule).select("o_orderkey", "o_totalprice")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem
WHERE l_linenumber > l_quantity"""
)
def dq_cross_field(t: Tables) -> DataFrame:
    rule = q.field_order_rule("R", "lineitem", "l_linenumber", "l_quantity")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return q.failing_rows(rows, rule)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS shipped
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""",
    headline=True,
)
def dq_cross_table(t: Tables) -> DataFrame:
    rule = q.table_order_rule(
        "R", "lineitem", "l_shipdate", "l_orderkey", "orders", "o_orderkey", "o_orderdate"
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    bad = q.failing_rows(rows, rule, {"orders": t.orders})
    return bad.withColumn("shipped", F.to_date("l_shipdate")).drop("l_shipdate")


@query(D + ROWS + FAILS["C08"])
def dq_foreign_key(t: Tables) -> DataFrame:
    return _failing(t, "C08")


@query(
    ctes("product", "listed_derivative")
    + """SELECT l.product_id, l.series_id FROM m_listed_derivative l JOIN m_product p
  ON l.product_id = p.product_id AND p.is_current WHERE p.status <> 'ACTIVE'"""
)
def dq_discriminator(t: Tables) -> DataFrame:
    rule = q.discriminator_rule(
        "R", "listed_derivative", "product_id", "product", "product_id", "status", "ACTIVE"
    )
    product = t.model["product"].filter("is_current")
    bad = q.failing_rows(t.model["listed_derivative"], rule, {"product": product})
    return bad.select("product_id", "series_id")


@query(
    ctes("product", "debt", "muni")
    + """SELECT d.product_id FROM m_debt d JOIN m_product p
  ON d.product_id = p.product_id AND p.is_current
LEFT JOIN m_muni b ON d.product_id = b.product_id
WHERE p.status <> 'ACTIVE' OR b.product_id IS NULL"""
)
def dq_discriminator_sibling(t: Tables) -> DataFrame:
    rule = q.discriminator_rule(
        "R", "debt", "product_id", "product", "product_id", "status", "ACTIVE",
        sibling=("muni", "product_id"),
    )
    tables = {"product": t.model["product"].filter("is_current"), "muni": t.model["muni"]}
    return q.failing_rows(t.model["debt"], rule, tables).select("product_id")


@query(
    ctes("product", "coupon")
    + """SELECT coupon_id, bond_id, payment_date FROM m_coupon c JOIN m_product p
  ON c.bond_id = p.product_id AND p.is_current WHERE c.payment_date <= p.issue_date"""
)
def dq_date_validity(t: Tables) -> DataFrame:
    rule = q.table_order_rule(
        "R", "coupon", "payment_date", "bond_id", "product", "product_id", "issue_date",
        inclusive=True,
    )
    tables = {"product": t.model["product"].filter("is_current")}
    bad = q.failing_rows(t.model["coupon"], rule, tables)
    return bad.select("coupon_id", "bond_id", "payment_date")


@query(
    """SELECT 'excludes' AS kind, doc_id FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
UNION ALL SELECT 'requires', doc_id FROM documents d WHERE lang = 'en'
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
)
def dq_consistency(t: Tables) -> DataFrame:
    tables = {"toxic": t.labels.filter("toxic = 1"), "labels": t.labels}
    excludes = q.consistency_rule("A", "documents", "doc_id", "toxic", "doc_id", "excludes")
    requires = q.consistency_rule(
        "B", "documents", "doc_id", "labels", "doc_id", "requires",
        when=lambda: F.col("lang") == "en",
    )
    docs = t.documents.select("doc_id", "lang")
    parts = [
        q.failing_rows(docs, r, tables).select(F.lit(kind).alias("kind"), "doc_id")
        for kind, r in (("excludes", excludes), ("requires", requires))
    ]
    return reduce(DataFrame.unionByName, parts)


@query(D + ROWS + "segment = 'BUILDING' AND (name IS NULL OR trim(name) = '')")
def dq_completeness(t: Tables) -> DataFrame:
    rule = q.complete_when_rule(
        "R", "customer", "name", lambda: F.col("segment") == "BUILDING", label="BUILDING"
    )
    return q.failing_rows(_dirty(t), rule)


@query(
    """SELECT event_id, user_id FROM events
WHERE NOT (ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY)"""
)
def dq_timeliness(t: Tables) -> DataFrame:
    rule = q.fresh_rule("R", "events", "ts", "2024-01-31 00:00:00", "10 DAYS")
    return q.failing_rows(t.events, rule).select("event_id", "user_id")


# --- routing --------------------------------------------------------------------------------

_BLOCKED = " OR ".join(f"({FAILS[r]})" for r in REJECTING)


@query(
    DQ
    + f"""SELECT custkey, name, nationkey, balance, segment,
  concat_ws('; ', CASE WHEN {FAILS["C05"]} THEN concat('C05: ', {DETAIL["C05"]}) END,
    CASE WHEN {FAILS["C07"]} THEN concat('C07: ', {DETAIL["C07"]}) END) AS warnings
FROM e WHERE coalesce(NOT ({_BLOCKED}), TRUE)""",
    headline=True,
)
def dq_route_clean(t: Tables) -> DataFrame:
    clean, _ = q.route(_evaluated(t), VERSION, AT)
    return clean.withColumn("warnings", F.array_join("_dq_warnings", "; ")).drop("_dq_warnings")


_REJECTS = DQ + " UNION ALL ".join(
    f"""SELECT custkey, name, nationkey, balance, segment, '{r}' AS _rule_id,
  {DETAIL[r]} AS _violation_detail, '{VERSION}' AS _dq_rule_version FROM e WHERE {FAILS[r]}"""
    for r in REJECTING
)


def _rejects(t: Tables) -> DataFrame:
    return q.route(_evaluated(t), VERSION, AT)[1]


@query(_REJECTS, headline=True)
def dq_route_rejects(t: Tables) -> DataFrame:
    return _rejects(t).drop("_rejected_ts")


@query(
    DQ
    + " UNION ALL ".join(
        f"SELECT custkey, '{r}' AS rule_id FROM e WHERE {FAILS[r]}" for r in ("C05", "C07")
    )
)
def dq_warnings(t: Tables) -> DataFrame:
    failed = _evaluated(t).select("custkey", F.explode("_failed").alias("f"))
    return failed.filter("f.severity = 'MEDIUM'").select("custkey", "f.rule_id")


@query(f"SELECT _rule_id, count(*) AS reject_count FROM ({_REJECTS}) GROUP BY _rule_id")
def reject_summary(t: Tables) -> DataFrame:
    return A.reject_summary(_rejects(t)).drop("last_rejected_at")


@query(
    f"""SELECT custkey, _violation_detail, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY custkey DESC) AS rank FROM ({_REJECTS})
  WHERE _rule_id = 'C01') WHERE rank <= 20"""
)
def recent_rejects(t: Tables) -> DataFrame:
    rows = _rejects(t).filter("_rule_id = 'C01'")
    newest = first_per_key(rows, ["_rule_id"], [F.desc("_rejected_ts"), F.desc("custkey")], 20)
    return newest.select("custkey", "_violation_detail", "rank")


# --- reports --------------------------------------------------------------------------------

_META = {r.rule_id: r for r in rules()}


@query(
    DQ
    + " UNION ALL ".join(
        f"""SELECT '{r}' AS rule_id, 'customer' AS table_name, '{_META[r].dimension}' AS dimension,
  '{_META[r].severity}' AS severity, count(*) AS n_rows, count(*) FILTER ({p}) AS failures,
  round(1 - count(*) FILTER ({p}) / count(*), 6) AS pass_rate FROM e"""
        for r, p in FAILS.items()
    ),
    headline=True,
)
def dq_report(t: Tables) -> DataFrame:
    return q.dq_report(_dirty(t), rules(), {"nation": t.nation})


# Rule versions: customers with a negative balance were last checked under an older version.
VERSIONED = f"""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'rules-v0' ELSE '{VERSION}' END AS _dq_rule_version
FROM {{customer}}
"""


@query(
    f"""SELECT 'customer' AS table_name, count(*) FILTER (c_acctbal < 0) AS stale_rows
FROM customer HAVING count(*) FILTER (c_acctbal < 0) > 0"""
)
def dq_rescan(t: Tables) -> DataFrame:
    fresh = t.orders.withColumn("_dq_rule_version", F.lit(VERSION))
    old = t.view(VERSIONED)
    return A.needs_rescan({"customer": old, "orders": fresh, "customer_rejects": old}, VERSION)


@query(f"SELECT _dq_rule_version, count(*) AS n_rows FROM ({plain(VERSIONED)}) GROUP BY 1")
def version_mix(t: Tables) -> DataFrame:
    return A.version_mix(t.view(VERSIONED))


@query(
    f"""SELECT r.rule_id, 'HIGH' AS severity, i.issue_id, n AS rejects FROM
  (SELECT 'C01' AS rule_id, 'K1' AS issue_id UNION ALL SELECT 'C01', 'K2') i
  JOIN (SELECT _rule_id AS rule_id, count(*) AS n FROM ({_REJECTS}) GROUP BY 1) r USING (rule_id)
UNION ALL SELECT 'C02', 'CRITICAL', 'K3', count(*) FROM ({_REJECTS}) WHERE _rule_id = 'C02'"""
)
def dq_issues(t: Tables) -> DataFrame:
    known = q.rules_frame(t.spark, rules())
    counts = A.reject_summary(_rejects(t)).select(
        F.col("_rule_id").alias("rule_id"), F.col("reject_count").alias("rejects")
    )
    issues = t.spark.createDataFrame(
        [("K1", "open"), ("K2", "open"), ("K3", "open"), ("K4", "closed")],
        "issue_id string, state string",
    )
    named = q.rule_issues(known, issues).drop("state")
    return named.join(counts, "rule_id").select("rule_id", "severity", "issue_id", "rejects")


@query(
    f"""SELECT 'customer' AS table_name, e.n AS expected, a.n AS actual, e.n = a.n AS matches
FROM (SELECT count(*) AS n FROM ({plain(DIRTY)}) WHERE segment = 'AUTOMOBILE' OR name IS NULL OR name = '') e,
  (SELECT count(*) AS n FROM ({_REJECTS})) a"""
)
def dq_expected(t: Tables) -> DataFrame:
    seeded = F.col("segment") == "AUTOMOBILE"
    seeded = seeded | F.col("name").isNull() | (F.col("name") == "")
    expected = _dirty(t).agg(F.count_if(seeded).alias("expected"))
    expected = expected.select(F.lit("customer").alias("table_name"), "expected")
    actual = _rejects(t).withColumn("table_name", F.lit("customer"))
    return q.compare_expected(actual, expected)


# --- the whole catalogue on the security model ----------------------------------------------

TODAY = "1999-06-30"


def _columns(table: str) -> set[str]:
    return set(re.findall(r"AS ([a-z_]+)", MODEL.get(table, "")))


def _catalogue() -> dict[str, tuple[str, str]]:
    """Rule -> (table, failing rows in SQL), from the parameters of the catalogue, for the
    rules whose tables and columns the derived model has."""
    blank = "({0} IS NULL OR trim(CAST({0} AS VARCHAR)) = '')".format
    out: list[tuple[str, list[tuple[str, str]], str]] = []  # table, columns needed, predicate

    def add(table, columns, predicate, *others):
        out.append((table, [*((table, c) for c in columns), *others], predicate))

    for t, c, values, _ in R.ENUMS:
        listed = ", ".join(f"'{v}'" for v in values)
        add(t, [c], f"{c} IS NOT NULL AND {c} NOT IN ({listed})")
    for t, c, _, _ in R.REQUIRED:
        add(t, [c], blank(c))
    for t, keys, _ in R.UNIQUE:
        same = " AND ".join(f"d.{k} IS NOT DISTINCT FROM m_{t}.{k}" for k in keys)
        k = ", ".join(keys)
        twice = f"SELECT {k} FROM m_{t} GROUP BY {k} HAVING count(*) > 1"
        add(t, [*keys, *(["-"] if t in R.NOT_UNIQUE else [])], f"EXISTS (FROM ({twice}) d WHERE {same})")
    owners = "SELECT isin FROM m_identifiers GROUP BY isin HAVING min(product_id) <> max(product_id)"
    add("identifiers", ["isin", "product_id"], f"NOT {blank('isin')} AND isin IN ({owners})")
    for t, c, pattern, blank_ok, _ in R.FORMATS:
        passes = f" AND {c} <> ''" if blank_ok else ""
        add(t, [c], f"{c} IS NOT NULL{passes} AND NOT regexp_matches({c}, '{pattern}')")
    add("product", ["description"], "description IS NOT NULL AND description <> trim(description)")
    for t, c, lo, hi, strict, _ in R.RANGES:
        bounds = [f"{c} {op}{'' if strict else '='} {x}" for op, x in ((">", lo), ("<", hi)) if x is not None]
        add(t, [c], f"{c} IS NOT NULL AND NOT ({' AND '.join(bounds)})")
    for t, c, _ in R.PAST_DATES:
        add(t, [c], f"{c} IS NOT NULL AND {c} > DATE '{TODAY}'")
    first, last = "first_delivery_datetime_utc", "last_delivery_datetime_utc"
    add("future", [first, last], f"coalesce({first} > {last}, FALSE)")
    early = "FROM m_product p WHERE p.product_id = m_listed_derivative.product_id AND last_trade_date < p.issue_date"
    add("listed_derivative", ["last_trade_date", "product_id"], f"EXISTS ({early})")
    for t, c, parent, pc, _ in R.FOREIGN_KEYS:
        add(t, [c], f"NOT {blank(c)} AND {c} NOT IN (SELECT {pc} FROM m_{parent} WHERE {pc} IS NOT NULL)",
            (parent, pc))
    other = "product_id IN (SELECT product_id FROM m_product WHERE type <> '{}')".format
    for t, expected, _ in R.SUBTYPES:
        add(t, ["product_id"], other(expected))
    add("muni", ["product_id"], other("DEBT") + " OR product_id NOT IN (SELECT product_id FROM m_bond)")
    return {
        f"RULE{n:04d}": (table, predicate)
        for n, (table, needed, predicate) in enumerate(out, start=1)
        if all(c in _columns(t) for t, c in needed)
    }


_CHECKED = _catalogue()


@query(
    ctes(*MODEL)
    + " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, count(*) AS n_rows, count(*) FILTER ({p}) AS failures FROM m_{n}"
        for r, (n, p) in _CHECKED.items()
    ),
    headline=True,
)
def dq_catalogue(t: Tables) -> DataFrame:
    """Every rule of the catalogue whose tables and columns the derived model has."""
    model = t.model
    reports = []
    for name in sorted({n for n, _ in _CHECKED.values()}):
        active = [r for r in security_rules(TODAY) if r.rule_id in _CHECKED and r.table == name]
        reports.append(q.dq_report(model[name], active, model, name))
    both = reduce(DataFrame.unionByName, reports)
    return both.select("rule_id", "n_rows", "failures")


@query(
    """SELECT 'bronze' AS stage, CAST(max(ts) AS DATE) AS last_day,
  max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2 HOUR AS breach FROM events
WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY"""
)
def sla_check(t: Tables) -> DataFrame:
    audit = t.events.filter("event_type = 'click'").select(
        F.lit("bronze").alias("stage"), F.lit("SUCCESS").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.col("ts").cast("timestamp").alias("completed_at"),
    )
    out = sla_of(audit, "bronze", "2 HOURS", "2024-01-31 00:00:00")
    return out.select("stage", F.to_date("last_completed").alias("last_day"), "breach")


