"""Bronze: registry-driven loads."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from ..operators.drift import (
    BreakingDrift,
    detect_drift,
    drift_event,
    guard_breaking,
    merge_additive,
)
from ..operators.merge import upsert
from ..operators.projections import add_metadata, data_columns
from ..operators.sinks import SnapshotTable, append, read_if_exists, upsert_buckets
from ..session import materialise
from ..sources.dispatch import read_source
from ..spec import TableSpec

SUMMARY = (
    "table_name string, mode string, rows_written bigint, status string, error string"
)


def ingest_table(
    spark: SparkSession,
    spec: TableSpec,
    root: str,
    batch_id: str,
    *,
    at: datetime | None = None,
    hash_mode: str = "strict",
) -> tuple:
    """Load one table; returns its summary row.

    First load creates the table; a table without a key is replaced as a whole; any other
    one is merged by key, changed rows only.  New columns are merged in and logged, a
    breaking schema change stops the load with a quarantine record.  The row count is
    observed while writing, without a scan of its own.
    """
    source = read_source(spark, spec)
    at = at or datetime.now()
    rows = add_metadata(
        source, spec.source.get("file", spec.name), batch_id, as_of=at, hash_mode=hash_mode
    )
    if spec.buckets and spec.key:
        return _ingest_buckets(spark, spec, root, batch_id, rows, source.schema, at)
    table = SnapshotTable(spark, f"{root}/{spec.name}")
    if not table.exists():
        _guard(spark, spec, root, batch_id, None, source.schema, at)
        n = table.write(rows, "CREATE", at=at, partition_by=spec.partition_by)
        return (spec.name, "CREATE", n, "SUCCESS", None)
    old = table.read()
    drift = _guard(spark, spec, root, batch_id, old.schema, source.schema, at)
    if drift["additive"]:
        columns = data_columns(old) + drift["additive"]
        old = merge_additive(old, source.schema)
        old = old.select(*columns, *[c for c in old.columns if c not in columns])
    if not spec.key:
        n = table.write(rows, "OVERWRITE", at=at, partition_by=spec.partition_by)
        return (spec.name, "OVERWRITE", n, "SUCCESS", None)
    merged = upsert(old, rows, spec.key)
    n = table.write(merged, "MERGE", at=at, partition_by=spec.partition_by)
    return (spec.name, "MERGE", n, "SUCCESS", None)


def _guard(spark, spec, root, batch_id, old, new, at) -> dict:
    """Log additive drift; quarantine and raise on a breaking change.

    ``new`` is the schema as delivered.  A first load must bring the declared columns.
    """
    drift = detect_drift(spec.schema if old is None else old, new)
    try:
        guard_breaking(spark, drift, batch_id, spec.name, at)
    except BreakingDrift as e:
        append(e.record, f"{root}/_schema_quarantine")
        raise
    if drift["additive"]:
        append(drift_event(spark, spec.name, drift["additive"], at), f"{root}/_schema_changes")
    return drift


def _ingest_buckets(spark, spec, root, batch_id, rows, schema, at) -> tuple:
    """The same load into a bucketed table; counts the delivered rows on the way."""
    path = f"{root}/{spec.name}"
    old = read_if_exists(spark, path)
    _guard(spark, spec, root, batch_id, None if old is None else old.schema, schema, at)
    rows = materialise(rows, f"delivery-{spec.name}")
    upsert_buckets(spark, path, rows, spec.key, buckets=spec.buckets)
    return (spec.name, "CREATE" if old is None else "MERGE", rows.count(), "SUCCESS", None)


def ingest_all(
    spark: SparkSession,
    registry: Sequence[TableSpec],
    root: str,
    batch_id: str,
    *,
    only: Iterable[str] | None = None,
    at: datetime | None = None,
    parallel: int = 4,
    fail: bool = True,
) -> DataFrame:
    """Load the tables of a registry, parents before children; returns the summary.

    Tables of one level are submitted together.  A failing table does not stop the others;
    with ``fail`` the run raises at the end if any table failed.
    """
    wanted = None if only is None else set(only)
    todo = sorted((s for s in registry if wanted is None or s.name in wanted), key=_level)

    def load(spec: TableSpec) -> tuple:
        try:
            return ingest_table(spark, spec, root, batch_id, at=at)
        except Exception as e:  # noqa: BLE001 - reported per table
            return (spec.name, None, 0, "FAILED", str(e))

    results = []
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for _, level in groupby(todo, key=_level):
            results += pool.map(load, list(level))
    failed = [r[0] for r in results if r[3] != "SUCCESS"]
    if failed and fail:
        raise RuntimeError(f"ingestion failed for {len(failed)} table(s): {', '.join(failed)}")
    return spark.createDataFrame(results, SUMMARY)


def _level(spec: TableSpec) -> int:
    return spec.level
