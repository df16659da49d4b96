"""Schema drift: detect, merge additive columns, quarantine breaking changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import BRONZE_META, struct
from .projections import typed_null

# Layout of the drift log and of the quarantine table.
CHANGE_LOG = struct(
    "table_name string, change_type string, columns_affected string, detected_at timestamp"
)
QUARANTINE = struct(
    "batch_id string, table_name string, change_type string, columns_affected string, "
    "quarantined_at timestamp, resolved_by string, resolved_at timestamp, resolution_note string"
)
ADDITIVE, BREAKING = "ADDITIVE", "BREAKING"
ADDED, REMOVED, RETYPED, UNCHANGED = "ADDED", "REMOVED", "RETYPED", "UNCHANGED"
IGNORED = {*BRONZE_META, "_schema_changes", "_bucket"}


class BreakingDrift(ValueError):
    """An incoming schema drops or retypes a column.  Carries the quarantine row."""

    def __init__(self, message: str, record: DataFrame):
        super().__init__(message)
        self.record = record


def column_changes(existing: T.StructType, incoming: T.StructType) -> dict[str, str]:
    """What became of each column of either schema, but for provenance columns."""
    before, after = (
        {f.name: f.dataType for f in schema if f.name not in IGNORED}
        for schema in (existing, incoming)
    )

    def change(name: str) -> str:
        if name not in after:
            return REMOVED
        if name not in before:
            return ADDED
        return UNCHANGED if before[name] == after[name] else RETYPED

    return {name: change(name) for name in {**before, **after}}


def detect_drift(existing: T.StructType | None, incoming: T.StructType) -> dict:
    """The changes by kind.  Added columns are additive, retyped and removed ones break."""
    changes = {} if existing is None else column_changes(existing, incoming)
    kinds = {
        "additive": (ADDED,),
        "breaking": (RETYPED, REMOVED),
        "unchanged": (UNCHANGED,),
        "type_changes": (RETYPED,),
        "removed_cols": (REMOVED,),
    }
    found = {k: [c for c, change in changes.items() if change in own] for k, own in kinds.items()}
    return {"new_table": existing is None, **found}


def drift_frame(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The comparison as rows: column, kind, both types, and non-null rows on either side."""
    kinds = column_changes(existing.schema, incoming.schema)

    def filled(df, name):
        cols = [c for c in df.columns if c in kinds]
        counts = df.agg(*[F.count(c).alias(c) for c in cols])
        long = counts.unpivot([], cols, "column_name", name)
        types = F.create_map(
            *[x for c in cols for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))]
        )
        return long.withColumn(f"{name}_type", types[F.col("column_name")])

    both = filled(existing, "old").join(filled(incoming, "new"), "column_name", "full_outer")
    kind = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])
    return both.select(
        "column_name",
        kind[F.col("column_name")].alias("change"),
        F.col("old_type"),
        F.col("new_type"),
        F.coalesce("old", F.lit(0)).alias("old_filled"),
        F.coalesce("new", F.lit(0)).alias("new_filled"),
    )


def merge_additive(existing: DataFrame, incoming_schema: T.StructType) -> DataFrame:
    """``existing`` with the new columns of ``incoming_schema`` as NULL."""
    drift = detect_drift(existing.schema, incoming_schema)
    types = {f.name: f.dataType for f in incoming_schema}
    return existing.select("*", *[typed_null(c, types[c]) for c in drift["additive"]])


def drift_event(spark: SparkSession, table: str, columns: Sequence[str], detected_at):
    return spark.createDataFrame([(table, ADDITIVE, ",".join(columns), detected_at)], CHANGE_LOG)


def guard_breaking(spark: SparkSession, drift: dict, batch_id: str, table: str, at) -> None:
    """Raise on a breaking change; the exception carries the quarantine row to append."""
    if not drift["breaking"]:
        return
    row = (batch_id, table, BREAKING, ",".join(drift["breaking"]), at, None, None, None)
    raise BreakingDrift(
        f"[SCHEMA DRIFT] Breaking change in {table}: {drift['breaking']}. "
        f"Batch {batch_id} quarantined.",
        spark.createDataFrame([row], QUARANTINE),
    )


def last_drift(log: DataFrame) -> DataFrame:
    return log.groupBy("table_name", "change_type").agg(F.max("detected_at").alias("last_drift"))


def resolve(quarantine: DataFrame, batch_id: str, by: str, note: str, at) -> DataFrame:
    """Mark a quarantined batch as resolved."""
    hit = F.col("batch_id") == batch_id
    new = {
        "resolved_by": F.lit(by),
        "resolved_at": F.lit(at).cast("timestamp"),
        "resolution_note": F.lit(note),
    }
    return quarantine.withColumns(
        {c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}
    )


def rename_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of a removed and an added column with the same type and the same values.

    Values agree if count, minimum, maximum and the sum of the value hashes agree; one
    aggregate per side, whatever the number of columns.
    """
    drift = detect_drift(old.schema, new.schema)
    pairs = [
        (a, b)
        for a in drift["removed_cols"]
        for b in drift["additive"]
        if old.schema[a].dataType == new.schema[b].dataType
    ]
    schema = "old_column string, new_column string, n_values bigint"
    if not pairs:
        return old.sparkSession.createDataFrame([], schema)

    def prints(df, cols):
        def fingerprint(c):
            text = F.col(c).cast("string")
            return F.struct(
                F.count(c).alias("n"),
                F.min(c).cast("string").alias("lo"),
                F.max(c).cast("string").alias("hi"),
                F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("h"),
            ).alias(c)

        return df.agg(*[fingerprint(c) for c in cols])

    left = prints(old, sorted({a for a, _ in pairs}))
    right = prints(new, sorted({b for _, b in pairs}))
    rows = [
        left.select(
            F.lit(a).alias("old_column"), F.lit(b).alias("new_column"), F.col(a).alias("_l")
        ).withColumn("_r", right.select(b).scalar())
        for a, b in pairs
    ]
    return (
        reduce(DataFrame.unionByName, rows)
        .filter(F.col("_l").eqNullSafe(F.col("_r")))
        .select("old_column", "new_column", F.col("_l.n").alias("n_values"))
    )
