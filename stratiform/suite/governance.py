"""Masks, filters, audit, lineage events, tags, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import governance as g
from . import Tables, query
from .inputs import plain

POLICY = {
    "c_name": ("head", {"data-stewards", "data-engineers"}),
    "c_mktsegment": ("tail", {"licensed-data-access"}),
    "c_acctbal": ("null", {"data-analysts", "data-stewards"}),
}


@query(
    """SELECT 'analyst' AS reader, c_custkey, concat(left(c_name, 2), '***') AS c_name, c_nationkey,
  c_acctbal, concat('***', right(c_mktsegment, 2)) AS c_mktsegment FROM customer
UNION ALL SELECT 'guest', c_custkey, concat(left(c_name, 2), '***'), c_nationkey,
  CAST(NULL AS DOUBLE), concat('***', right(c_mktsegment, 2)) FROM customer
UNION ALL SELECT 'steward', c_custkey, c_name, c_nationkey, c_acctbal,
  concat('***', right(c_mktsegment, 2)) FROM customer""",
    headline=True,
)
def masked_customers(t: Tables) -> DataFrame:
    def seen(reader, roles):
        return g.mask(t.customer, POLICY, roles).select(F.lit(reader).alias("reader"), "*")

    rows = seen("analyst", {"data-analysts"}).unionByName(seen("guest", set()))
    return rows.unionByName(seen("steward", {"data-stewards"}))


@query(
    """SELECT 'list' AS kind, c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')
UNION ALL SELECT 'entitled', c_custkey FROM customer WHERE c_nationkey IN (
  SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'bypass', c_custkey FROM customer"""
)
def row_filter(t: Tables) -> DataFrame:
    own = t.nation.filter("n_regionkey = 1").select("n_nationkey")
    kinds = {
        "list": g.row_filter(t.customer, "c_mktsegment", ["BUILDING", "FURNITURE"]),
        "entitled": g.row_filter(t.customer, "c_nationkey", own),
        "bypass": g.row_filter(t.customer, "c_nationkey", own, roles=["global-access"]),
    }
    parts = [df.select(F.lit(k).alias("kind"), "c_custkey") for k, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Events read as the runs of an audit log.
AUDIT = """
SELECT CAST(event_id AS STRING) AS run_id, event_type AS stage,
  CASE WHEN value > 10 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CAST(round(value * 100) AS BIGINT) AS rows_read, CAST(round(value * 90) AS BIGINT) AS rows_written,
  CAST(round(value * 10) AS BIGINT) AS rows_rejected, ts AS completed_at
FROM {events}
"""


@query(
    f"""SELECT stage, status, count(*) AS n_runs, CAST(sum(rows_read) AS BIGINT) AS rows_read,
  CAST(sum(rows_written) AS BIGINT) AS rows_written, CAST(sum(rows_rejected) AS BIGINT) AS rows_rejected,
  max(completed_at) AS last_completed FROM ({plain(AUDIT)}) GROUP BY stage, status""",
    headline=True,
)
def audit_rollup(t: Tables) -> DataFrame:
    return g.audit_rollup(t.view(AUDIT))


@query(
    """SELECT 'orders' AS table_name, 'SUCCESS' AS status, count(*) AS rows_read,
  count(*) FILTER (o_totalprice > 1000) AS rows_written FROM orders
UNION ALL SELECT 'customer', 'PARTIAL', count(*), count(*) FILTER (c_acctbal > 0) FROM customer"""
)
def audit_append(t: Tables) -> DataFrame:
    """Two runs append their audit rows to the log."""
    path = t.scratch("audit")
    measured = {
        "orders": ("SUCCESS", t.orders, F.col("o_totalprice") > 1000),
        "customer": ("PARTIAL", t.customer, F.col("c_acctbal") > 0),
    }
    for name, (status, df, kept) in measured.items():
        n = df.agg(F.count(F.lit(1)).alias("a"), F.count_if(kept).alias("b")).first()
        row = g.audit_row(
            t.spark, run_id="r1", use_case_name="demo", stage="bronze", table_name=name,
            started_at=datetime(2024, 2, 1), rows_read=n.a, rows_written=n.b, status=status,
        )
        g.append_audit(row, path)
    log = t.spark.read.schema(g.AUDIT).parquet(path)
    return log.select("table_name", "status", "rows_read", "rows_written")


@query(
    """SELECT event_id, user_id, event_type AS action_name FROM events WHERE user_id = 8
ORDER BY ts DESC, user_id, event_type LIMIT 50"""
)
def access_log(t: Tables) -> DataFrame:
    """The newest reads of one table; the report shows 50."""
    log = t.events.select(
        F.concat(F.lit("table_"), F.col("user_id").cast("string")).alias("table_name"),
        "user_id", F.col("event_type").alias("action_name"), F.col("ts").alias("event_time"),
        "event_id",
    )
    return g.access_log(log, "table_8", 50).select("event_id", "user_id", "action_name")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, concat(
  '{"eventType":"COMPLETE","eventTime":"', strftime(o_orderdate, '%Y-%m-%d'), '","run":{"runId":"', o_orderkey,
  '"},"job":{"namespace":"demo","name":"load_', o_orderstatus, '"},"inputs":[{"namespace":"demo","name":"customer"},',
  '{"namespace":"demo","name":"cust_', o_custkey, '"}],"outputs":[{"namespace":"demo","name":"orders"}]}') AS event
FROM orders""",
    headline=True,
)
def lineage_events(t: Tables) -> DataFrame:
    runs = t.orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("load_"), F.col("o_orderstatus")).alias("job_name"),
        F.array(
            F.lit("customer"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"))
        ).alias("inputs"),
        F.lit("orders").alias("output"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("completed_at"),
    )
    return g.lineage_events(runs, "demo")


# One entry of the inventory per order day and status.
INVENTORY = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'rejects' WHEN 'O' THEN 'gold' ELSE 'bronze' END AS layer,
  CAST(o_orderdate AS DATE) AS created_on, COUNT(*) AS n_rows
FROM {orders} GROUP BY 1, 2
"""


@query(
    f"""SELECT *, CAST(created_on + CASE layer WHEN 'rejects' THEN 365 ELSE 730 END AS DATE) AS expired_on
FROM ({plain(INVENTORY)}) WHERE layer <> 'bronze'
  AND created_on + CASE layer WHEN 'rejects' THEN 365 ELSE 730 END <= DATE '1999-01-01'"""
)
def retention_plan(t: Tables) -> DataFrame:
    return g.retention_plan(t.view(INVENTORY), "1999-01-01")


@query(
    """SELECT 'customer' AS table_name, 'c_name' AS column_name, 'pii' AS tag_name, 'true' AS tag_value,
  count(c_name) AS n_values FROM customer
UNION ALL SELECT 'customer', 'c_acctbal', 'classification', 'restricted', count(c_acctbal) FROM customer"""
)
def column_tags(t: Tables) -> DataFrame:
    """Tags survive a write, and say how many values each tagged column holds."""
    tagged = g.tag_columns(
        t.customer, {"c_name": {"pii": "true"}, "c_acctbal": {"classification": "restricted"}}
    )
    path = t.scratch("tagged")
    tagged.write.parquet(path)
    stored = t.spark.read.parquet(path)
    found = g.column_tags(stored)
    counts = stored.agg(*[F.count(c).alias(c) for c, _, _ in found])
    rows = [
        F.struct(
            F.lit("customer").alias("table_name"), F.lit(c).alias("column_name"),
            F.lit(k).alias("tag_name"), F.lit(v).alias("tag_value"), F.col(c).alias("n_values"),
        )
        for c, k, v in found
    ]
    return counts.select(F.inline(F.array(*rows)))
