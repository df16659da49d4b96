"""Projections, predicates, joins, windows, aggregates and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.hashing import row_hash
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import projections as pr
from ..operators import windows as W
from ..operators.governance import lineage, lineage_edges
from ..operators.history import history_from_events
from ..session import materialise
from ..spec import struct
from . import Tables, query
from .inputs import DIRTY, plain

DIRTY_SQL = f"WITH d AS ({plain(DIRTY)}) "


def _dirty(t: Tables) -> DataFrame:
    return t.view(DIRTY)


# --- projections ----------------------------------------------------------------------------


@query(
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
  'orders.parquet' AS _source_file, 'batch-1' AS _batch_id, 'volume' AS _source_type,
  DATE '2024-01-01' AS _ingestion_date,
  sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority)) AS _row_hash
FROM orders
""",
    headline=True,
)
def row_hash_compat(t: Tables) -> DataFrame:
    rows = t.orders.drop("o_orderdate")
    return pr.add_metadata(
        rows, "orders.parquet", "batch-1", source_type="volume", as_of="2024-01-01",
        hash_mode="compat",
    ).drop("_ingestion_ts")


@query(
    DIRTY_SQL
    + """SELECT custkey, sha256(concat_ws('|',
  concat(length(CAST(custkey AS VARCHAR)), ':', custkey),
  CASE WHEN name IS NULL THEN '-' ELSE concat(length(name), ':', name) END,
  CASE WHEN nationkey IS NULL THEN '-' ELSE concat(length(CAST(nationkey AS VARCHAR)), ':', nationkey) END
)) AS row_hash FROM d"""
)
def row_hash_strict(t: Tables) -> DataFrame:
    return _dirty(t).select("custkey", row_hash(["custkey", "name", "nationkey"]).alias("row_hash"))


@query(
    DIRTY_SQL
    + """SELECT custkey,
  CASE WHEN name IS NOT NULL THEN 'NAME' WHEN segment IS NOT NULL THEN 'SEGMENT' END AS label,
  coalesce(name, segment) AS value FROM d"""
)
def coalesce_priority(t: Tables) -> DataFrame:
    label, value = pr.coalesce_priority([("NAME", "name"), ("SEGMENT", "segment")])
    return _dirty(t).select("custkey", label.alias("label"), value.alias("value"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag IN ('A', 'N') THEN
  CAST(CAST(l_extendedprice AS DECIMAL(28,8)) * (1 + CAST(l_tax AS DECIMAL(18,8))) AS DECIMAL(18,6))
  END AS DOUBLE) AS settled FROM lineitem"""
)
def derive_metric(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice").cast("decimal(28,8)") * (
        F.lit(1).cast("decimal(1,0)") + F.col("l_tax").cast("decimal(18,8)")
    )
    settled = pr.derive_when("settled", F.col("l_returnflag").isin("A", "N"), net)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", settled)
    return rows.withColumn("settled", F.col("settled").cast("double"))


@query("SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS underlying, upper(c_name) AS label FROM customer")
def typed_null(t: Tables) -> DataFrame:
    rows = pr.select_as(t.customer, {"id": "c_custkey", "label": F.upper("c_name")})
    return rows.select("*", pr.typed_null("underlying", "string"))


@query(
    DIRTY_SQL
    + """SELECT TRY_CAST(nationkey AS INTEGER) AS nationkey, TRY_CAST(segment AS INTEGER) AS segment,
  CAST(balance AS VARCHAR) AS balance, CAST(NULL AS DATE) AS since, custkey FROM d"""
)
def conform_types(t: Tables) -> DataFrame:
    schema = struct("nationkey integer, segment integer, balance string, since date")
    return pr.conform(_dirty(t).drop("name"), schema, extra="keep")


@query(
    """
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click,
  max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase,
  max(CASE WHEN event_type = 'view' THEN value END) AS view
FROM events GROUP BY user_id
"""
)
def eav_pivot(t: Tables) -> DataFrame:
    return pr.pivot_eav(t.events, ["user_id"], "event_type", "value", ["click", "purchase", "view"])


@query(
    DIRTY_SQL
    + """SELECT custkey, 'name' AS id_type, name AS identifier_value FROM d WHERE name IS NOT NULL
UNION ALL SELECT custkey, 'segment', segment FROM d WHERE segment IS NOT NULL
UNION ALL SELECT custkey, 'nationkey', CAST(nationkey AS VARCHAR) FROM d WHERE nationkey IS NOT NULL"""
)
def wide_unpivot(t: Tables) -> DataFrame:
    return pr.unpivot_wide(_dirty(t), ["custkey"], ["name", "segment", "nationkey"])


@query(
    """SELECT *, DATE '2024-01-01' AS effective_start_date, DATE '9999-12-31' AS effective_end_date,
  TRUE AS is_current, 'dev' AS _dq_rule_version FROM customer"""
)
def stamp_current(t: Tables) -> DataFrame:
    return pr.stamp_current(t.customer, "2024-01-01", "dev")


# --- predicates -----------------------------------------------------------------------------


@query(
    DIRTY_SQL
    + r"""SELECT custkey, (name IS NULL OR trim(name) = '') AS blank,
  segment IN ('BUILDING', 'MACHINERY') AS in_set,
  (segment IS NOT NULL AND segment NOT IN ('BUILDING', 'MACHINERY')) AS out_of_set,
  regexp_matches(name, '^Customer#[0-9]{9}$') AS matches,
  (nationkey IS NULL OR (nationkey >= 0 AND nationkey <= 24)) AS in_range,
  (balance IS NULL OR balance > 0) AS above_zero,
  (name IS NOT NULL AND name <> trim(name)) AS untrimmed FROM d"""
)
def predicates(t: Tables) -> DataFrame:
    names = ["BUILDING", "MACHINERY"]
    return _dirty(t).select(
        "custkey",
        P.is_blank("name").alias("blank"),
        P.in_set("segment", names).alias("in_set"),
        P.not_in_set("segment", names).alias("out_of_set"),
        P.matches("name", "^Customer#[0-9]{9}$").alias("matches"),
        P.in_range("nationkey", 0, 24).alias("in_range"),
        P.in_range("balance", 0.0, strict=True).alias("above_zero"),
        P.untrimmed("name").alias("untrimmed"),
    )


@query(
    """SELECT event_id, user_id, value FROM events
WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY"""
)
def recent_window(t: Tables) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return t.events.filter(P.since("ts", now, "7 DAYS")).select("event_id", "user_id", "value")


# --- joins ----------------------------------------------------------------------------------

# Orders whose customer key was mistyped (urgent ones of the last year).
LOST = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 5000000000
  WHEN o_orderpriority = '2-HIGH' AND o_totalprice < 50000 THEN NULL ELSE o_custkey END AS custkey
FROM {orders}
"""


@query(
    f"""WITH o AS ({plain(LOST)}) SELECT o.* FROM o LEFT JOIN customer ON custkey = c_custkey
WHERE custkey IS NOT NULL AND c_custkey IS NULL""",
    headline=True,
)
def orphans(t: Tables) -> DataFrame:
    return J.orphans(t.view(LOST), t.customer, "custkey", "c_custkey")


@query(
    """SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""
)
def semi_keys(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.semi(t.customer, big, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    """SELECT o_orderkey, o_orderstatus FROM orders o WHERE o_orderstatus <> 'P' AND NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')"""
)
def lacks_children(t: Tables) -> DataFrame:
    rows = J.lacks(
        t.orders, t.lineitem, "o_orderkey", "l_orderkey",
        F.col("o_orderstatus") != "P", F.col("l_returnflag") == "R",
    )
    return rows.select("o_orderkey", "o_orderstatus")


@query(
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped,
  CAST(o_orderdate AS DATE) AS ordered
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""",
    headline=True,
)
def cross_check(t: Tables) -> DataFrame:
    bad = F.col("l_shipdate") < F.col("ordered")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    out = J.cross_check(
        rows, t.orders, "l_orderkey", "o_orderkey", bad, {"ordered": "o_orderdate"}
    )
    return out.select(
        "l_orderkey", "l_linenumber",
        F.to_date("l_shipdate").alias("shipped"), F.to_date("ordered").alias("ordered"),
    )


@query(
    """SELECT d.doc_id, d.source, d.lang FROM documents d
JOIN (SELECT source, min(lang) AS home FROM documents GROUP BY source) s ON d.source = s.source
LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> s.home OR l.doc_id IS NULL"""
)
def cross_check2(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", "lang")
    home = docs.groupBy("source").agg(F.min("lang").alias("home"))
    parents = docs.join(home, "source").select("doc_id", "home")
    out = J.cross_check_or_missing(
        docs, parents, t.labels, "doc_id", "doc_id", "doc_id",
        F.col("lang") != F.col("home"), {"home": "home"},
    )
    return out.select("doc_id", "source", "lang")


@query(
    """SELECT DISTINCT l_partkey AS key FROM lineitem
WHERE l_partkey IN (SELECT s_suppkey FROM supplier)"""
)
def overlap_keys(t: Tables) -> DataFrame:
    return J.overlap(t.lineitem, t.supplier, "l_partkey", "s_suppkey")


@query(
    """SELECT o_orderkey, p_partkey, p_brand, o_orderstatus FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    headline=True,
)
def bridge(t: Tables) -> DataFrame:
    rows = J.via_bridge(
        t.orders.select("o_orderkey", "o_orderstatus"),
        t.lineitem.select("l_orderkey", "l_partkey"),
        t.part.select("p_partkey", "p_brand"),
        ("o_orderkey", "l_orderkey"),
        ("l_partkey", "p_partkey"),
    )
    return rows.select("o_orderkey", "p_partkey", "p_brand", "o_orderstatus")


@query(
    f"""WITH o AS ({plain(LOST)}) SELECT count(*) AS missing_rows,
  count(DISTINCT custkey) AS missing_keys FROM o
WHERE custkey IS NOT NULL AND custkey NOT IN (SELECT c_custkey FROM customer)"""
)
def coverage(t: Tables) -> DataFrame:
    return J.coverage(t.view(LOST), t.customer, "custkey", "c_custkey")


PRICES = """
SELECT l_partkey AS partkey, CAST(l_shipdate AS DATE) AS start,
  MAX(l_extendedprice) AS price FROM {lineitem} GROUP BY l_partkey, CAST(l_shipdate AS DATE)
"""


@query(
    f"""WITH h AS ({plain(PRICES)}), v AS (
  SELECT *, lead(start, 1, DATE '9999-12-31') OVER (PARTITION BY partkey ORDER BY start) AS until FROM h)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS partkey, CAST(o_orderdate AS DATE) AS day, v.price
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN v ON v.partkey = l.l_partkey AND v.start <= CAST(o_orderdate AS DATE)
  AND CAST(o_orderdate AS DATE) < v.until""",
    headline=True,
)
def as_of_join(t: Tables) -> DataFrame:
    versions = history_from_events(
        t.view(PRICES), ["partkey"], "start", [], ["price"]
    ).withColumn("until", F.coalesce("end", F.lit("9999-12-31").cast("date")))
    history = materialise(versions, "prices")
    facts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("partkey"),
        F.to_date("o_orderdate").alias("day"),
    )
    return J.as_of_join(
        facts, history, "partkey", "day", "start", "until", ["price"]
    )


# --- windows, ranking, sets -----------------------------------------------------------------


@query(
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""",
    headline=True,
)
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice"
    )
    return W.latest_per_key(rows, ["o_custkey"], [F.desc("day")], [F.asc("o_orderkey")])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
    headline=True,
)
def dedupe(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    tie = [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return W.dedupe(rows, ["l_orderkey", "l_linenumber"], tie)


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    headline=True,
)
def dup_keys(t: Tables) -> DataFrame:
    return W.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""",
    headline=True,
)
def dup_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return W.duplicate_rows(rows, ["l_orderkey", "l_linenumber"])


@query(
    """SELECT sha256(text) AS text_hash, count(DISTINCT source) AS n FROM documents
WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(DISTINCT source) > 1"""
)
def multi_owner(t: Tables) -> DataFrame:
    """Texts that several sources carry; only their hashes are exchanged."""
    hashes = t.documents.filter("text <> ''").select(
        F.sha2("text", 256).alias("text_hash"), "source"
    )
    return A.multi_owner(hashes, "text_hash", "source")


@query(
    """SELECT p_brand, count(*) AS n_rows FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand ORDER BY n_rows DESC, p_brand LIMIT 5"""
)
def top_values(t: Tables) -> DataFrame:
    sold = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return W.top_values(sold.select("p_brand"), "p_brand", 5)


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"""
)
def top_rows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return W.top_rows(rows, "o_totalprice", 10, [F.asc("o_orderkey")])


COUNTED = ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in COUNTED)
)
def union_counts(t: Tables) -> DataFrame:
    return A.union_counts({n: getattr(t, n) for n in COUNTED})


# Where rows come from: region -> nation -> customer -> order.
EDGES = """
SELECT concat('region:', CAST(n_regionkey AS STRING)) AS source,
  concat('nation:', CAST(n_nationkey AS STRING)) AS target FROM {nation}
UNION ALL
SELECT concat('nation:', CAST(c_nationkey AS STRING)), concat('customer:', CAST(c_custkey AS STRING))
FROM {customer}
UNION ALL
SELECT concat('customer:', CAST(o_custkey AS STRING)), concat('order:', CAST(o_orderkey AS STRING))
FROM {orders}
"""


@query(
    f"""WITH RECURSIVE e AS ({plain(EDGES)}), reach AS (
  SELECT 'region:1' AS node, 0 AS depth
  UNION ALL SELECT e.target, depth + 1 FROM reach JOIN e ON e.source = reach.node)
SELECT node, min(depth) AS depth FROM reach GROUP BY node"""
)
def lineage_closure(t: Tables) -> DataFrame:
    return lineage(lineage_edges(t.view(EDGES)), ["region:1"])


# --- aggregates -----------------------------------------------------------------------------


@query(
    """SELECT 'orders' AS check_id, count(*) AS total_rows, count(DISTINCT o_orderkey) AS distinct_keys,
  CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END AS result FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)),
  CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'PASS' ELSE 'FAIL' END
FROM lineitem"""
)
def check_grain(t: Tables) -> DataFrame:
    parts = [
        A.check_grain(t.orders, ["o_orderkey"], "orders"),
        A.check_grain(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    """WITH h AS (SELECT sha256(concat_ws('|', text)) AS h FROM documents)
SELECT count(*) AS n_rows, count(DISTINCT h) AS n_hashes,
  round(1 - count(DISTINCT h) / count(*), 9) AS dup_rate,
  1 - count(DISTINCT h) / count(*) < 0.1 AS passed FROM h"""
)
def hash_collision(t: Tables) -> DataFrame:
    hashed = t.documents.select(row_hash(["text"], "compat").alias("_row_hash"))
    return A.hash_collision_rate(hashed).withColumn("dup_rate", F.round("dup_rate", 9))


@query(
    DIRTY_SQL
    + """SELECT segment AS type, count(*) AS n_rows, 'name' AS column_name,
  count(*) FILTER (name IS NULL) AS missing FROM d
WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY segment
UNION ALL SELECT segment, count(*), 'nationkey', count(*) FILTER (nationkey IS NULL) FROM d
WHERE segment IN ('BUILDING', 'FURNITURE') GROUP BY segment"""
)
def completeness_by(t: Tables) -> DataFrame:
    required = {
        "BUILDING": ["name", "nationkey"], "MACHINERY": ["name"], "FURNITURE": ["nationkey"],
    }
    return A.completeness_by(_dirty(t), "segment", required)


# Events read as runs: their number of tokens, their time and their outcome.
RUNS = """
SELECT event_id AS run_id, CAST(value * 100 AS BIGINT) AS input_tokens,
  CAST(value * 25 AS BIGINT) AS output_tokens, CAST(value * 10 AS BIGINT) AS latency_ms,
  CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fixed' WHEN 'view' THEN 'skipped'
    ELSE 'pass' END AS status
FROM {events}
"""


@query(
    """WITH r AS (SELECT event_id AS run_id, CAST(trunc(value * 100) AS BIGINT) AS input_tokens,
  CAST(trunc(value * 25) AS BIGINT) AS output_tokens, CAST(trunc(value * 10) AS BIGINT) AS latency_ms,
  CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fixed' WHEN 'view' THEN 'skipped'
    ELSE 'pass' END AS status FROM events)
SELECT round(CAST(sum(CAST(round(input_tokens * 3e-6 + output_tokens * 15e-6, 6) AS DECIMAL(18,6))) AS DOUBLE), 4)
    AS total_cost_usd,
  CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
  CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms, count(*) AS total_runs,
  count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail,
  count(*) FILTER (status = 'fixed') AS n_fixed, count(*) FILTER (status = 'skipped') AS n_skipped
FROM r""",
    headline=True,
)
def run_kpis(t: Tables) -> DataFrame:
    return A.run_kpis(t.view(RUNS))


@query(
    """WITH b AS (SELECT CAST(o_totalprice >= 100000 AS INT) + CAST(o_totalprice >= 200000 AS INT)
  + CAST(o_totalprice >= 300000 AS INT) AS bin, o_orderdate < DATE '1997-01-01' AS old FROM orders),
c AS (SELECT bin, count(*) FILTER (old) AS n_base, count(*) FILTER (NOT old) AS n_cur FROM b GROUP BY bin)
SELECT bin, n_base, n_cur, round((n_cur / (SELECT sum(n_cur) FROM c) - n_base / (SELECT sum(n_base) FROM c))
  * ln((n_cur / (SELECT sum(n_cur) FROM c)) / (n_base / (SELECT sum(n_base) FROM c))), 9) AS psi FROM c"""
)
def psi(t: Tables) -> DataFrame:
    day = F.lit("1997-01-01").cast("date")
    old = t.orders.filter(F.col("o_orderdate") < day)
    new = t.orders.filter(F.col("o_orderdate") >= day)
    bins = A.psi(old, new, "o_totalprice", [100_000, 200_000, 300_000])
    return bins.withColumn("psi", F.round("psi", 9))
