"""Typed descriptions of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Names of the columns that the library itself adds to a table.
BRONZE_META = (
    "_source_file",
    "_source_type",
    "_ingestion_ts",
    "_batch_id",
    "_row_hash",
    "_ingestion_date",
)
HISTORY_META = ("effective_start_date", "effective_end_date", "is_current", "_dq_rule_version")
REJECT_META = ("_rule_id", "_violation_detail", "_rejected_ts", "_dq_rule_version")
OPEN_END = "9999-12-31"


def struct(fields: str) -> T.StructType:
    """``"id long, name string"`` as a schema; unlike DDL it needs no running session."""
    out = T.StructType()
    for item in fields.split(","):
        name, kind = item.split()
        out = out.add(name, kind)
    return out


@dataclass(frozen=True)
class TableSpec:
    """One table of a registry: where it comes from, its schema and its key.

    ``level`` orders loads by foreign key: parents have a lower level than children.
    A table without a key is overwritten as a whole on every load.

    A keyed table is kept as snapshots, each a full copy that can be read as of then.  With
    ``buckets`` it is kept in that many parts by key hash instead, and a load rewrites only
    the parts it changes: the layout for tables that are large next to their deliveries.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    source: dict = field(default_factory=dict)
    level: int = 0
    partition_by: tuple[str, ...] = ("_ingestion_date",)
    buckets: int = 0
