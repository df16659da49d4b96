"""Streams, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as q
from ..spec import struct
from ..streaming import ingest as st
from ..streaming import rules
from . import Tables, query
from .inputs import VERSION

EVENTS = struct(
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)
AS_OF = "2024-02-01 00:00:00"


def _stream(t: Tables, parts: int = 4) -> DataFrame:
    """The events as a folder of files that arrive one per micro-batch."""
    path = t.scratch("arriving")
    t.events.repartition(parts, "event_id").write.parquet(path)
    return st.stream_files(
        t.spark, path, EVENTS, max_files_per_trigger=1
    )


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_files(t: Tables) -> DataFrame:
    """Each file once: a second run of the same query adds nothing."""
    stream = st.stream_files(t.spark, f"{t.folder}/events.parquet*", EVENTS).select(
        "event_id", "user_id", "event_type", "value"
    )
    path, checkpoint = t.scratch("out"), t.scratch("checkpoint")
    for _ in range(2):
        st.append_stream(stream, path, checkpoint)
    return t.spark.read.parquet(path)


@query(
    """SELECT CAST(user_id AS VARCHAR) AS _kafka_key, event_id AS _kafka_offset,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'streaming' AS _batch_id FROM events"""
)
def stream_bronze(t: Tables) -> DataFrame:
    messages = _stream(t).select(
        F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"),
        F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"),
    )
    # Every message arrives twice; the second copy is dropped by its offset.
    twice = messages.unionByName(messages)
    fresh = st.dedupe_offsets(
        st.bronze_stream(twice, struct("k long")), ["_kafka_offset"],
        delay="40 days",
    )
    path = t.scratch("out")
    st.append_stream(fresh, path, t.scratch("checkpoint"))
    rows = t.spark.read.parquet(path)
    return rows.select("_kafka_key", "_kafka_offset", "k", "_batch_id")


@query(
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def stream_upsert(t: Tables) -> DataFrame:
    """Newest event per user, whatever order the files arrive in."""
    path = t.scratch("users")
    stream = _stream(t).select("user_id", "ts", "event_id", "event_type", "value")
    st.upsert_stream(
        stream, path, ["user_id"], ["ts", "event_id"], t.scratch("checkpoint"), buckets=4
    )
    rows = st.read_upserted(t.spark, path)
    return rows.select("user_id", "event_id", "event_type", "value")


def _rules() -> list[q.Rule]:
    return [
        q.enum_rule("E1", "events", "event_type", ["click", "view", "purchase", "signup"]),
        q.range_rule("E2", "events", "value", 0.5, 20.0),
        q.unique_rule("E3", "events", ["user_id", "props"]),
        q.fresh_rule("E4", "events", "ts", AS_OF, "20 DAYS"),
        q.owner_rule("E5", "events", "user_id", "event_type"),
    ]


#: The verdicts on the whole table, in SQL.  Keys of E3 and E5 occur in several files.
_VERDICTS = """WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id, props) > 1 AS e3,
    min(event_type) OVER (PARTITION BY user_id) <> max(event_type) OVER (PARTITION BY user_id) AS e5,
    event_type = 'error' AS e1, NOT (value BETWEEN 0.5 AND 20) AS e2,
    CAST(user_id AS VARCHAR) AS u FROM events)
"""


@query(
    _VERDICTS
    + """SELECT * FROM (SELECT 'E1' AS rule_id, count(*) FILTER (e1) AS batch_failures,
  count(*) FILTER (e1) AS stream_failures, TRUE AS equal FROM e
UNION ALL SELECT 'E2', count(*) FILTER (e2), count(*) FILTER (e2), TRUE FROM e
UNION ALL SELECT 'E3', count(*) FILTER (e3), count(*) FILTER (e3), TRUE FROM e
UNION ALL SELECT 'E5', count(*) FILTER (e5), count(*) FILTER (e5), TRUE FROM e)"""
)
def stream_dq(t: Tables) -> DataFrame:
    """The rule set on a stream finds what it finds on the whole table, key rules included."""
    flagged = t.scratch("flagged")
    rules.evaluate_stream(_stream(t), _rules(), flagged, t.scratch("checkpoint"))
    rows = rules.read_evaluated(t.spark, flagged, _rules())
    found = rows.select(F.explode("_failed.rule_id").alias("rule_id"))
    report = q.dq_report(t.events, _rules()).filter("rule_id <> 'E4'")
    streamed = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("failures"))
    return q.compare_reports(report, streamed.filter("rule_id <> 'E4'"))


@query(
    _VERDICTS
    + """SELECT event_id, 'clean' AS verdict, concat_ws('; ',
    CASE WHEN e2 THEN 'E2: RANGE_CHECK value: ' || value END,
    CASE WHEN e5 THEN 'E5: BUSINESS_KEY_UNIQUE user_id: ' || u END) AS told FROM e WHERE NOT e1 AND NOT e3
UNION ALL SELECT event_id, 'E1', 'ENUM_MEMBERSHIP event_type: ' || event_type FROM e WHERE e1
UNION ALL SELECT event_id, 'E3', 'COMPOSITE_KEY_UNIQUE user_id, props: ' || u || ', ' || props FROM e WHERE e3"""
)
def stream_conform(t: Tables) -> DataFrame:
    """Clean rows with their warnings, and rejects, of a stream: row by row as of one batch.

    Half of the files are there at first; the others make keys repeat and reject rows that
    were clean before.
    """
    clean, rejects, checkpoint = t.scratch("clean"), t.scratch("rejects"), t.scratch("checkpoint")
    path = t.scratch("arriving")
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 != 0):
        t.events.where(part).repartition(2, "event_id").write.mode("append").parquet(path)
        stream = st.stream_files(t.spark, path, EVENTS, max_files_per_trigger=1)
        rules.conform_stream(stream, _rules(), VERSION, AS_OF, clean, rejects, checkpoint)
    kept = t.spark.read.parquet(clean)
    warned = F.filter("_dq_warnings", lambda w: ~w.startswith("E4"))
    kept = kept.select("event_id", F.lit("clean").alias("verdict"), F.array_join(warned, "; ").alias("told"))
    out = t.spark.read.parquet(rejects)
    return kept.union(out.select("event_id", "_rule_id", "_violation_detail"))
