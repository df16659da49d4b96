"""Keyed merges as pure functions ``(target, incoming) -> new table``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_present(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def pack(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys plus the whole row as one struct, ready for a full outer join by key."""
    return df.select(*keys, F.struct(*df.columns).alias(name))


def unique_or_fail(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """As :func:`pack`, but the query fails if a key occurs twice.

    The grouping needs the same exchange as the merge join that follows, so the check
    costs no shuffle of its own.
    """
    packed = pack(df, keys, name)
    grouped = packed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), F.first(name).alias(name)
    )
    where = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    fail = F.raise_error(F.concat(F.lit("duplicate merge key: "), where))
    checked = F.when(F.col("_copies") > 1, fail.cast(grouped.schema[name].dataType)).otherwise(
        F.col(name)
    )
    return grouped.select(*keys, checked.alias(name))


def same_layout(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` in the column order and types of ``target``."""
    missing = [c for c in target.columns if c not in incoming.columns]
    if missing:
        raise ValueError(f"incoming rows lack columns: {missing}")
    return incoming.select(*[F.col(f.name).cast(f.dataType) for f in target.schema.fields])


def absent_from(known: DataFrame, rows: DataFrame, hash_col: str) -> DataFrame:
    """The ``rows``, each once, whose hash does not occur in ``known``."""
    seen = known.select(F.col(hash_col).alias("_known")).distinct()
    once = rows.dropDuplicates([hash_col])
    return once.join(seen, once[hash_col].eqNullSafe(seen["_known"]), "left_anti")


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    hash_col: str = "_row_hash",
    newest_by: Sequence[str] = (),
) -> DataFrame:
    """Insert new keys; replace rows whose hash differs; keep everything else as it is.

    With ``newest_by`` a row that is older than the table's, in these columns, is ignored.

    One full outer join on the key.  As in a SQL merge a NULL key matches nothing: such
    rows bypass the join, which also keeps them from piling up in one partition.  They are
    told apart by their hash, so a delivery can be merged again without adding them twice.
    """
    incoming = same_layout(target, incoming)
    present = all_present(keys)
    t = pack(target.filter(present), keys, "_t")
    s = unique_or_fail(incoming.filter(present), keys, "_s")
    joined = t.join(s, list(keys), "full_outer")
    keep = F.col("_t").isNotNull() & (
        F.col("_s").isNull() | F.col(f"_s.{hash_col}").eqNullSafe(F.col(f"_t.{hash_col}"))
    )
    if newest_by:
        age = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in newest_by])
        keep = keep | (F.col("_t").isNotNull() & (age("_t") > age("_s")))
    merged = joined.select(F.when(keep, F.col("_t")).otherwise(F.col("_s")).alias("_r"))
    loose = target.filter(~present)
    added = absent_from(loose, incoming.filter(~present), hash_col)
    return merged.select("_r.*").unionByName(loose).unionByName(added)


# Outcome of comparing two versions of a row.
NEW, CHANGED, UNCHANGED, ABSENT = "NEW", "CHANGED", "UNCHANGED", "ABSENT"


def diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str], hash_col: str = "_row_hash"
) -> DataFrame:
    """(keys, status) over two versions of a table.  Only keys and hashes are read.

    A NULL key matches nothing: such rows are ABSENT or NEW and stay out of the join.
    """
    present = all_present(keys)
    a = old.filter(present).select(*keys, F.col(hash_col).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.filter(present).select(*keys, F.col(hash_col).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, list(keys), "full_outer")
    status = (
        F.when(F.col("_in_a").isNull(), NEW)
        .when(F.col("_in_b").isNull(), ABSENT)
        .when(F.col("_a").eqNullSafe(F.col("_b")), UNCHANGED)
        .otherwise(CHANGED)
    )
    loose = [
        df.filter(~present).select(*keys, F.lit(s).alias("status"))
        for df, s in ((old, ABSENT), (new, NEW))
    ]
    compared = joined.select(*keys, status.alias("status"))
    return compared.unionByName(loose[0]).unionByName(loose[1])
