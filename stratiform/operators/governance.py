"""Masks, row filters, audit, lineage, comments, tags, retention."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import MASKS
from ..session import materialise, scratch_path
from ..spec import struct

# Layout of the audit log.
AUDIT = struct(
    "run_id string, use_case_name string, job_name string, stage string, table_name string, "
    "started_at timestamp, completed_at timestamp, rows_read long, rows_written long, "
    "rows_rejected long, batch_id string, status string, error_message string, "
    "triggered_by string, dq_rule_version string, source_type string, notes string"
)


def mask(
    df: DataFrame, policy: Mapping[str, tuple[str, Iterable[str]]], roles: Iterable[str]
) -> DataFrame:
    """Mask columns for a reader with ``roles``.

    ``policy`` maps a column to (mask, roles that may see it).  The caller's roles are
    known when the plan is built, so a permitted column stays untouched.
    """
    mine = set(roles)
    out = []
    for f in df.schema.fields:
        kind, allowed = policy.get(f.name, (None, ()))
        if kind is None or mine & set(allowed):
            out.append(F.col(f.name))
        else:
            out.append(MASKS[kind](F.col(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def row_filter(
    df: DataFrame,
    column: str,
    allowed: Sequence | DataFrame,
    roles: Iterable[str] = (),
    bypass: str = "global-access",
) -> DataFrame:
    """Rows whose ``column`` is allowed: a list of values, or a frame of entitlements.

    Readers with the ``bypass`` role see everything.
    """
    if bypass in set(roles):
        return df
    if isinstance(allowed, DataFrame):
        keys = allowed.select(F.col(allowed.columns[0]).alias("_allowed"))
        return df.join(keys, df[column] == keys["_allowed"], "left_semi")
    return df.filter(F.col(column).isin(list(allowed)))


def audit_row(spark: SparkSession, **values) -> DataFrame:
    """One audit row; columns that are not given are NULL."""
    unknown = set(values) - set(AUDIT.names)
    if unknown:
        raise ValueError(f"not columns of the audit log: {sorted(unknown)}")
    return spark.createDataFrame([tuple(values.get(n) for n in AUDIT.names)], AUDIT)


def append_audit(rows: DataFrame, path: str) -> None:
    """The log only grows: rows are appended, never changed."""
    rows.select(*AUDIT.names).write.mode("append").parquet(path)


def audit_rollup(audit: DataFrame) -> DataFrame:
    return audit.groupBy("stage", "status").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_written").alias("rows_written"),
        F.sum("rows_rejected").alias("rows_rejected"),
        F.max("completed_at").alias("last_completed"),
    )


def sla_check(audit: DataFrame, stage: str, max_age: str, as_of, lookback: str = "1 DAY"):
    """One row: the last success of ``stage`` started within ``lookback`` and whether the
    SLA is broken because it is older than ``max_age`` or there is none."""
    now = F.lit(as_of).cast("timestamp")
    runs = audit.filter(
        (F.col("stage") == stage)
        & (F.col("status") == "SUCCESS")
        & (F.col("started_at") > now - F.expr(f"INTERVAL {lookback}"))
    )
    late = F.col("last_completed") < now - F.expr(f"INTERVAL {max_age}")
    return runs.agg(F.max("completed_at").alias("last_completed")).select(
        F.lit(stage).alias("stage"),
        "last_completed",
        F.coalesce(late, F.lit(True)).alias("breach"),
    )


def lineage(edges: DataFrame, start: Sequence[str], direction: str = "downstream") -> DataFrame:
    """(node, depth): everything reachable from ``start`` along (source, target) edges.

    Breadth first, to whatever depth.  Each level is one join of the newest nodes with the
    distinct edges (written once), minus the nodes seen already, and is appended to a table
    in the shared folder; the driver only learns whether a level was empty.
    """
    spark = edges.sparkSession
    near, far = ("source", "target") if direction == "downstream" else ("target", "source")
    steps = edges.select(F.col(near).alias("_from"), F.col(far).alias("_to")).distinct()
    steps = materialise(steps, "lineage-edges")
    path = scratch_path(spark, "lineage")
    schema = "node string, depth int"
    first = spark.createDataFrame([(n, 0) for n in start], schema)
    first.write.parquet(f"{path}/depth=0")
    for depth in count(1):
        seen = spark.read.schema(schema).parquet(path)
        newest = seen.filter(F.col("depth") == depth - 1).select("node")
        found = steps.join(newest, steps["_from"] == newest["node"], "left_semi")
        fresh = (
            found.select(F.col("_to").alias("node"))
            .distinct()
            .join(seen.select("node"), "node", "left_anti")
        )
        level = f"{path}/depth={depth}"
        fresh.write.parquet(level)
        if spark.read.schema("node string").parquet(level).isEmpty():
            break
    return spark.read.schema(schema).parquet(path)


def lineage_edges(events: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs of a lineage log."""
    return events.select("source", "target").distinct()


def lineage_events(runs: DataFrame, namespace: str) -> DataFrame:
    """One JSON event per run(run_id, job_name, inputs array, output, completed_at string)."""

    def dataset(name):
        return F.struct(F.lit(namespace).alias("namespace"), name.alias("name"))

    event = F.struct(
        F.lit("COMPLETE").alias("eventType"),
        F.col("completed_at").alias("eventTime"),
        F.struct(F.col("run_id").alias("runId")).alias("run"),
        dataset(F.col("job_name")).alias("job"),
        F.transform("inputs", dataset).alias("inputs"),
        F.array(dataset(F.col("output"))).alias("outputs"),
    )
    return runs.select("run_id", F.to_json(event).alias("event"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def set_comments(
    spark: SparkSession, table: str, comment: str, columns: Mapping[str, str] = {}
) -> None:
    spark.sql(f"COMMENT ON TABLE {table} IS {_quoted(comment)}")
    for c, text in columns.items():
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{c}` COMMENT {_quoted(text)}")


def missing_comments(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """(table_name, column_name) without a comment; a NULL column stands for the table."""
    rows = []
    for t in tables:
        if not spark.catalog.getTable(t).description:
            rows.append((t, None))
        rows += [(t, c.name) for c in spark.catalog.listColumns(t) if not c.description]
    return spark.createDataFrame(rows, "table_name string, column_name string")


TAG = "tag."


def tag(spark: SparkSession, table: str, tags: Mapping[str, str]) -> None:
    """Classify a table; tags are kept as table properties."""
    pairs = ", ".join(f"{_quoted(TAG + k)} = {_quoted(v)}" for k, v in tags.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def tags(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    rows = []
    for t in tables:
        for r in spark.sql(f"SHOW TBLPROPERTIES {t}").collect():
            if r["key"].startswith(TAG):
                rows.append((t, r["key"][len(TAG) :], r["value"]))
    return spark.createDataFrame(rows, "table_name string, tag_name string, tag_value string")


def tag_columns(df: DataFrame, column_tags: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Classify columns in the frame's own metadata, which Parquet writes keep."""
    out = df
    for c, t in column_tags.items():
        out = out.withMetadata(c, {**df.schema[c].metadata, "tags": dict(t)})
    return out


def column_tags(df: DataFrame) -> list[tuple[str, str, str]]:
    return [
        (f.name, k, v) for f in df.schema.fields for k, v in f.metadata.get("tags", {}).items()
    ]


# Days each layer is kept; None means for ever.
RETENTION_DAYS = {
    "bronze": None,
    "silver": 2555,
    "gold": 730,
    "rejects": 365,
    "audit": None,
}


def retention_plan(
    inventory: DataFrame, as_of, policy: Mapping[str, int | None] = RETENTION_DAYS
) -> DataFrame:
    """The parts of ``inventory`` (layer, created_on, ...) that are past their retention.

    Nothing is deleted; layers outside the policy are kept.
    """
    kept = [F.when(F.col("layer") == lyr, F.lit(d)) for lyr, d in policy.items() if d is not None]
    days = F.coalesce(F.lit(None).cast("int"), *kept)
    expires = F.date_add("created_on", days)
    day = F.lit(as_of).cast("date")
    return inventory.withColumn("expired_on", expires).filter(F.col("expired_on") <= day)


def access_log(log: DataFrame, table: str, n: int) -> DataFrame:
    """The newest ``n`` reads of a table; equal times go by user, then by all columns."""
    order = dict.fromkeys(["user_id", "action_name", *sorted(log.columns)])
    order.pop("event_time", None)
    return (
        log.filter(F.col("table_name") == table).orderBy(F.desc("event_time"), *order).limit(n)
    )


