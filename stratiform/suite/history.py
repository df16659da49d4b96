"""Merges, history, change capture and drift."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_hash
from ..operators import capture as cc
from ..operators import drift as dr
from ..operators import history as h
from ..operators import intervals as iv
from ..operators import merge as mg
from ..operators.aggregates import union_counts
from ..operators.governance import lineage_edges
from ..operators.projections import stamp_current
from ..plans.conform import change_summary
from . import Tables, query
from .inputs import CHANGES, FIRST_DAY, NEXT, NEXT_DAY, PROFILES, VERSION, plain

KEY = ["c_custkey"]
N = f"WITH n AS ({plain(NEXT)}) "
ATTRS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_row_hash", row_hash(df.columns))


def _old(t: Tables) -> DataFrame:
    return hashed(t.customer)


def _new(t: Tables) -> DataFrame:
    return hashed(t.view(NEXT))


@query(
    N
    + """SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name,
  coalesce(n.c_nationkey, c.c_nationkey) AS c_nationkey,
  coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal,
  coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""",
    headline=True,
)
def upsert_scd1(t: Tables) -> DataFrame:
    return mg.upsert(_old(t), _new(t), KEY).drop("_row_hash")


@query(
    N
    + """SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey,
  coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal
FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey"""
)
def merge_idempotent(t: Tables) -> DataFrame:
    once = mg.upsert(_old(t), _new(t), KEY)
    twice = mg.upsert(once, _new(t), KEY)
    return mg.upsert(twice, twice, KEY).select("c_custkey", "c_acctbal")


_STATUS = """CASE WHEN c.c_custkey IS NULL THEN 'NEW' WHEN n.c_custkey IS NULL THEN 'ABSENT'
  WHEN c.c_acctbal = n.c_acctbal THEN 'UNCHANGED' ELSE 'CHANGED' END"""


@query(
    N
    + f"""SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, {_STATUS} AS status
FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""",
    headline=True,
)
def diff_versions(t: Tables) -> DataFrame:
    return mg.diff(_old(t), _new(t), KEY)


@query(
    N
    + f"""SELECT {_STATUS} AS status, count(*) AS n_keys
FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey GROUP BY 1"""
)
def change_counts(t: Tables) -> DataFrame:
    return change_summary(_old(t), _new(t), KEY)


# --- history --------------------------------------------------------------------------------

_SCD2 = N + f""", j AS (SELECT c.c_custkey AS ok, c.c_name AS o1, c.c_nationkey AS o2,
  c.c_acctbal AS o3, c.c_mktsegment AS o4, n.* FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey),
scd AS (
SELECT ok AS c_custkey, o1 AS c_name, o2 AS c_nationkey, o3 AS c_acctbal, o4 AS c_mktsegment,
  DATE '{FIRST_DAY}' AS effective_start_date,
  CASE WHEN o3 <> c_acctbal THEN DATE '{NEXT_DAY}' ELSE DATE '9999-12-31' END AS effective_end_date,
  coalesce(o3 = c_acctbal, TRUE) AS is_current, 'rules-v0' AS _dq_rule_version
FROM j WHERE ok IS NOT NULL
UNION ALL
SELECT {ATTRS}, DATE '{NEXT_DAY}', DATE '9999-12-31', TRUE, '{VERSION}'
FROM j WHERE ok IS NULL OR (c_custkey IS NOT NULL AND o3 <> c_acctbal)) """


def _history(t: Tables) -> DataFrame:
    first = stamp_current(_old(t), FIRST_DAY, "rules-v0")
    return h.scd2_merge(first, _new(t), KEY, NEXT_DAY, VERSION)


@query(_SCD2 + "SELECT * FROM scd", headline=True)
def scd2_merge(t: Tables) -> DataFrame:
    return _history(t).drop("_row_hash")


@query(_SCD2 + "SELECT * FROM scd")
def scd2_rerun(t: Tables) -> DataFrame:
    """The same delivery merged a second time on the same day changes nothing."""
    return h.scd2_merge(_history(t), _new(t), KEY, NEXT_DAY, VERSION).drop("_row_hash")


@query(
    _SCD2
    + """SELECT 'multiple_current' AS check_id, (SELECT count(*) FROM (SELECT c_custkey FROM scd
    WHERE is_current GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'open_end_missing', count(*) FROM scd WHERE is_current AND effective_end_date <> DATE '9999-12-31'
UNION ALL SELECT 'empty_interval', count(*) FROM scd WHERE effective_start_date >= effective_end_date"""
)
def scd2_integrity(t: Tables) -> DataFrame:
    return h.check_scd2(_history(t), KEY)


@query(
    _SCD2
    + f"""SELECT {ATTRS} FROM scd WHERE effective_start_date <= DATE '2024-01-15'
AND DATE '2024-01-15' < effective_end_date"""
)
def scd2_as_of(t: Tables) -> DataFrame:
    return h.as_of(_history(t), "2024-01-15").select(*t.customer.columns)


_VERSIONS = """WITH s AS (SELECT user_id, ts, event_type,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
v AS (SELECT user_id, event_type, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS "end"
FROM s WHERE before IS DISTINCT FROM event_type) """


def _versions(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_id", "ts", "event_type")
    return h.history_from_events(
        events, ["user_id"], "ts", ["event_id"], ["event_type"]
    )


@query(
    _VERSIONS + """SELECT user_id, event_type, start, "end", "end" IS NULL AS is_current FROM v""",
    headline=True,
)
def history_from_events(t: Tables) -> DataFrame:
    return _versions(t)


# The same versions, spoilt: purchases start a day early, clicks a day late.
_SPOIL = """CASE event_type WHEN 'purchase' THEN start - INTERVAL 1 DAY
  WHEN 'click' THEN start + INTERVAL 1 DAY ELSE start END"""


@query(
    _VERSIONS
    + f""", w AS (SELECT user_id, {_SPOIL} AS start,
  coalesce("end", TIMESTAMP '9999-12-31 00:00:00') AS until FROM v),
x AS (SELECT *, lag(until) OVER (PARTITION BY user_id ORDER BY start, until) AS previous_end FROM w)
SELECT user_id, start, previous_end, CASE WHEN previous_end > start THEN 'OVERLAP' ELSE 'GAP' END AS problem
FROM x WHERE previous_end <> start"""
)
def check_intervals(t: Tables) -> DataFrame:
    open_end = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    spoilt = _versions(t).select(
        "user_id", F.expr(_SPOIL).alias("start"), F.coalesce("end", open_end).alias("until")
    )
    return h.check_intervals(spoilt, ["user_id"], "start", "until")


# --- change capture -------------------------------------------------------------------------

_CDC = f"""WITH c AS ({plain(CHANGES)}), p AS ({plain(PROFILES)}),
last_op AS (SELECT user_id, _op FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) AS rn
  FROM c WHERE _op <> 3) WHERE rn = 1),
image AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) AS rn
  FROM c WHERE _op IN (2, 4)) WHERE rn = 1) """


@query(
    _CDC
    + """SELECT k.user_id, coalesce(i.last_event, p.last_event) AS last_event,
  coalesce(i.amount, p.amount) AS amount,
  CASE WHEN o._op = 1 THEN 'DELETED' ELSE coalesce(i.status, p.status) END AS status
FROM (SELECT user_id FROM image UNION SELECT user_id FROM p) k
LEFT JOIN image i ON i.user_id = k.user_id LEFT JOIN p ON p.user_id = k.user_id
LEFT JOIN last_op o ON o.user_id = k.user_id""",
    headline=True,
)
def cdc_apply(t: Tables) -> DataFrame:
    return cc.apply_changes(t.view(PROFILES), t.view(CHANGES), ["user_id"])


@query(
    f"""WITH c AS ({plain(CHANGES)}), m AS (SELECT max(_seq) AS hi FROM c)
SELECT user_id, _seq, _op FROM c, m WHERE _seq > hi / 2 AND _seq <= hi - 100"""
)
def cdc_read(t: Tables) -> DataFrame:
    changes = t.view(CHANGES)
    top = changes.agg(F.max("_seq").alias("hi"))
    low, high = top.select(F.col("hi") / 2).scalar(), top.select(F.col("hi") - 100).scalar()
    return cc.read_changes(changes, "_seq", low, high).select("user_id", "_seq", "_op")


@query(
    f"""SELECT 'click' AS source_name, max(event_id) AS last_seq, DATE '{NEXT_DAY}' AS updated_on
FROM events WHERE event_type = 'click' UNION ALL
SELECT 'view', max(event_id), DATE '{FIRST_DAY}' FROM events WHERE event_type = 'view'"""
)
def cdc_checkpoint(t: Tables) -> DataFrame:
    kind = lambda k: t.events.filter(F.col("event_type") == k)
    empty = t.spark.createDataFrame(
        [], "source_name string, last_seq bigint, updated_at timestamp"
    )
    half = kind("click").filter("ts < '2024-01-15'")
    first = cc.advance_checkpoint(empty, half, "click", "event_id", f"{FIRST_DAY} 00:00:00")
    both = cc.advance_checkpoint(first, kind("view"), "view", "event_id", f"{FIRST_DAY} 00:00:00")
    moved = cc.advance_checkpoint(both, kind("click"), "click", "event_id", f"{NEXT_DAY} 00:00:00")
    return moved.select("source_name", "last_seq", F.to_date("updated_at").alias("updated_on"))


@query(
    f"""WITH c AS ({plain(CHANGES)}) SELECT 'inserts' AS table_name, count(*) AS n_rows FROM c WHERE _op = 2
UNION ALL SELECT 'updates', count(*) FROM c WHERE _op = 4
UNION ALL SELECT 'deletes', count(*) FROM c WHERE _op = 1
UNION ALL SELECT 'upserts', count(*) FROM c WHERE _op IN (2, 4)"""
)
def cdc_split(t: Tables) -> DataFrame:
    changes = t.view(CHANGES)
    return union_counts({**cc.split_ops(changes), "upserts": cc.upserts(changes)})


# --- drift ----------------------------------------------------------------------------------


def _drifted(t: Tables) -> DataFrame:
    """The next delivery: one column added, one retyped, one gone."""
    return t.view(NEXT).select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"),
        "c_acctbal", F.when(F.col("c_acctbal") > 0, "GOOD").alias("c_rating"),
    )


@query(
    N
    + """SELECT column_name, change, old_type, new_type,
  CASE WHEN change = 'ADDED' THEN 0 ELSE o END AS old_filled,
  CASE WHEN change = 'REMOVED' THEN 0 WHEN change = 'ADDED' THEN g ELSE n END AS new_filled
FROM (VALUES ('c_custkey', 'UNCHANGED', 'bigint', 'bigint'),
  ('c_name', 'UNCHANGED', 'string', 'string'), ('c_nationkey', 'RETYPED', 'int', 'string'),
  ('c_acctbal', 'UNCHANGED', 'double', 'double'), ('c_mktsegment', 'REMOVED', 'string', NULL),
  ('c_rating', 'ADDED', NULL, 'string')) v(column_name, change, old_type, new_type),
(SELECT count(*) AS o FROM customer), (SELECT count(*) AS n, count(*) FILTER (c_acctbal > 0) AS g FROM n)"""
)
def drift_diff(t: Tables) -> DataFrame:
    return dr.drift_frame(t.customer, _drifted(t))


@query(
    "SELECT *, CAST(NULL AS VARCHAR) AS c_rating FROM customer"
)
def drift_merge(t: Tables) -> DataFrame:
    incoming = t.view(NEXT).withColumn("c_rating", F.lit("GOOD"))
    return dr.merge_additive(t.customer, incoming.schema)


@query(
    N
    + """SELECT 'batch-7' AS batch_id, 'customer' AS table_name, 'BREAKING' AS change_type,
  'c_nationkey,c_mktsegment' AS columns_affected, count(*) AS rows_held FROM n"""
)
def drift_breaking(t: Tables) -> DataFrame:
    """The quarantine record, with the number of rows that the stopped batch holds back."""
    incoming = _drifted(t)
    drift = dr.detect_drift(t.customer.schema, incoming.schema)
    try:
        dr.guard_breaking(t.spark, drift, "batch-7", "customer", datetime(2024, 2, 1))
    except dr.BreakingDrift as stop:
        held = incoming.agg(F.count(F.lit(1)).alias("rows_held"))
        return stop.record.select(
            "batch_id", "table_name", "change_type", "columns_affected"
        ).withColumn("rows_held", held.scalar())
    raise AssertionError("the delivery was expected to be refused")


# Error events read as a drift log.
LOG = """
SELECT concat('table_', CAST(user_id AS STRING)) AS table_name,
  CASE WHEN value > 10 THEN 'BREAKING' ELSE 'ADDITIVE' END AS change_type,
  'c1' AS columns_affected, ts AS detected_at
FROM {events} WHERE event_type = 'error'
"""


@query(
    f"""SELECT table_name, change_type, max(detected_at) AS last_drift FROM ({plain(LOG)})
WHERE detected_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY 1, 2"""
)
def drift_log(t: Tables) -> DataFrame:
    from ..functions.predicates import since

    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return dr.last_drift(t.view(LOG).filter(since("detected_at", now, "14 DAYS")))


@query(
    f"""SELECT table_name, count(*) FILTER (table_name = 'table_8') AS resolved,
  count(*) FILTER (table_name <> 'table_8') AS unresolved FROM ({plain(LOG)})
WHERE change_type = 'BREAKING' GROUP BY 1"""
)
def drift_resolve(t: Tables) -> DataFrame:
    log = t.view(LOG).filter("change_type = 'BREAKING'")
    none = F.lit(None)
    quarantine = log.select(
        F.col("table_name").alias("batch_id"), "table_name", "change_type", "columns_affected",
        F.col("detected_at").cast("timestamp").alias("quarantined_at"),
        none.cast("string").alias("resolved_by"), none.cast("timestamp").alias("resolved_at"),
        none.cast("string").alias("resolution_note"),
    )
    done = dr.resolve(quarantine, "table_8", "steward", "retyped", datetime(2024, 2, 1))
    return done.groupBy("table_name").agg(
        F.count("resolved_by").alias("resolved"),
        F.count_if(F.col("resolved_by").isNull()).alias("unresolved"),
    )


@query("SELECT 'c_mktsegment' AS old_column, 'segment' AS new_column, count(c_mktsegment) AS n_values FROM customer")
def drift_rename(t: Tables) -> DataFrame:
    renamed = t.customer.select(
        "c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("segment"),
        F.upper("c_name").alias("label"),
    )
    return dr.rename_candidates(t.customer, renamed)


@query("SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem", headline=True)
def distinct_edges(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return lineage_edges(pairs)


@query(
    """WITH l AS (SELECT *, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS done FROM lineitem)
SELECT p.l_orderkey, p.l_linenumber, count(*) AS n_open, CAST(sum(CAST(i.l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM l p JOIN l i ON p.l_suppkey = i.l_suppkey AND i.l_shipdate <= p.l_shipdate AND p.l_shipdate < i.done
GROUP BY ALL"""
)
def interval_join(t: Tables) -> DataFrame:
    """Which deliveries of its supplier are under way when a line item ships; they overlap."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    days = F.make_dt_interval(days=F.col("l_quantity").cast("int"))
    spans = lines.select("l_suppkey", "l_shipdate", "l_quantity", (F.col("l_shipdate") + days).alias("done"))
    met = iv.interval_join(lines, spans, "l_suppkey", "l_shipdate", "l_shipdate", "done")
    return met.groupBy("point.l_orderkey", "point.l_linenumber").agg(
        F.count(F.lit(1)).alias("n_open"), F.sum(F.col("interval.l_quantity").cast("long")).alias("quantity")
    )
