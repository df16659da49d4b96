"""Silver: rules, rejects and history in one step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import scd2_merge
from ..operators.merge import diff
from ..operators.projections import stamp_current
from ..operators.quality import Rule, evaluate, route, rule_version
from ..operators.sinks import SnapshotTable, scd2_buckets
from ..session import materialise


def conform_table(
    spark: SparkSession,
    name: str,
    bronze: DataFrame,
    keys: Sequence[str],
    rules: Sequence[Rule],
    tables: Mapping[str, DataFrame],
    root: str,
    at: datetime,
    *,
    buckets: int = 0,
) -> None:
    """Evaluate the rules, write the rejects, then merge the clean rows into the history.

    The history is a snapshot table or, with ``buckets``, a bucketed one of which only the
    parts with changes are rewritten.  Rejects lie in one folder per run, ``_run=<at>``; a
    run that is repeated replaces its own.  The evaluated rows are written once to the shared
    folder, since both outputs read them and a lost executor must not repeat the rule joins.
    """
    version = rule_version(rules)
    evaluated = materialise(evaluate(bronze, rules, tables, name), f"evaluated-{name}")
    clean, rejects = route(evaluated, version, at)
    rejects = rejects.withColumn("_table", F.lit(name))
    run = f"{root}/{name}_rejects/_run={at:%Y%m%dT%H%M%S}"
    rejects.write.mode("overwrite").partitionBy("_rule_id").parquet(run)
    # Warnings describe this run's evaluation and are no part of a row's history hash.
    if buckets:
        path = f"{root}/{name}"
        scd2_buckets(spark, path, clean, keys, at.date(), version, buckets=buckets)
        return
    table = SnapshotTable(spark, f"{root}/{name}")
    if table.exists():
        merged = scd2_merge(table.read(), clean, keys, at.date(), version)
    else:
        merged = stamp_current(clean, at.date(), version)
    table.write(merged, "SCD2", at=at)


def change_summary(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys are new, changed, unchanged and absent."""
    return diff(old, new, keys).groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"))
