"""Change feeds: rows with an operation code and a sequence number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import absent_from, all_present, pack

# Operation codes of a change feed.
DELETE, INSERT, BEFORE, AFTER = 1, 2, 3, 4


def read_changes(df: DataFrame, seq_col: str, low, high) -> DataFrame:
    """The changes after ``low`` up to and including ``high`` (values or columns)."""
    return df.filter((F.col(seq_col) > F.lit(low)) & (F.col(seq_col) <= F.lit(high)))


def split_ops(df: DataFrame, op_col: str = "_op") -> dict[str, DataFrame]:
    """Inserts, after-images and deletes; before-images are left out."""
    op = F.col(op_col)
    return {
        "inserts": df.filter(op == INSERT),
        "updates": df.filter(op == AFTER),
        "deletes": df.filter(op == DELETE),
    }


def upserts(df: DataFrame, op_col: str = "_op") -> DataFrame:
    """Inserts and after-images together."""
    return df.filter(F.col(op_col).isin(INSERT, AFTER))


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    seq: str = "_seq",
    op: str = "_op",
    deleted: tuple[str, str] = ("status", "DELETED"),
    hash_col: str | None = None,
) -> DataFrame:
    """Apply a batch of changes to a table with unique keys.

    A key that was deleted and comes again is live again, also with the values it had.  A
    NULL key matches nothing: its after-images are added as rows, with ``hash_col`` only if
    no such row is there, so that a batch can be applied again.

    Per key the newest after-image wins by ``seq``.  If the newest operation is a delete
    the row stays and its ``deleted`` column is set.  Both facts come from one aggregate
    by key with map-side combine, so a key with very many changes costs no more than
    others.  ``seq`` must be unique per key.
    """
    columns = target.columns
    image = F.col(op).isin(INSERT, AFTER)
    live = changes.filter(all_present(keys) & (F.col(op) != BEFORE))
    newest = live.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.when(image, F.col(seq))).alias("_s"),
        F.max_by(F.col(op), F.col(seq)).alias("_last"),
    )
    present = all_present(keys)
    joined = pack(target.filter(present), keys, "_t").join(newest, list(keys), "full_outer")
    keep = F.col("_s").isNull()
    if hash_col is not None:
        same = F.col(f"_s.{hash_col}").eqNullSafe(F.col(f"_t.{hash_col}"))
        if deleted[0] in columns:
            same = same & ~F.col(f"_t.{deleted[0]}").eqNullSafe(F.lit(deleted[1]))
        keep = keep | same
    row = F.when(F.col("_t").isNotNull() & keep, F.col("_t")).otherwise(F.col("_s"))
    out = joined.select(row.alias("_r"), "_last").filter(F.col("_r").isNotNull())
    flag, value = deleted
    gone = F.coalesce(F.col("_last") == DELETE, F.lit(False))
    applied = out.select("_r.*", gone.alias("_gone")).select(
        *[
            F.when(F.col("_gone"), F.lit(value)).otherwise(F.col(c)).alias(c) if c == flag else c
            for c in columns
        ]
    )
    loose = target.filter(~present)
    added = changes.filter(~present & image).select(*columns)
    if hash_col is not None:
        added = absent_from(loose, added, hash_col)
    return applied.unionByName(loose).unionByName(added)


def advance_checkpoint(
    checkpoint: DataFrame, changes: DataFrame, source: str, seq: str, updated_at
) -> DataFrame:
    """The checkpoint table with ``source`` moved to the highest sequence of ``changes``."""
    seen = changes.agg(F.max(seq).alias("last_seq")).filter("last_seq IS NOT NULL")
    row = seen.select(
        F.lit(source).alias("source_name"),
        F.col("last_seq").cast("bigint").alias("last_seq"),
        F.lit(updated_at).cast("timestamp").alias("updated_at"),
    )
    both = checkpoint.unionByName(row)
    newest = F.max_by(F.struct("last_seq", "updated_at"), F.struct("last_seq", "updated_at"))
    return both.groupBy("source_name").agg(newest.alias("_r")).select("source_name", "_r.*")
