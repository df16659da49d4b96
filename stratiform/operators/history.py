"""Slowly changing dimensions of type 2: half-open validity ``[start, end)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import HISTORY_META, OPEN_END
from .merge import absent_from, all_present, pack, same_layout, unique_or_fail
from .ordered import carry
from .projections import stamp_current


def scd2_merge(
    history: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    as_of,
    rule_version: str,
    hash_col: str = "_row_hash",
) -> DataFrame:
    """Fold a snapshot into a history.

    Unchanged keys stay; a changed key is closed at ``as_of`` and opened again in the same
    run; a new key is opened; a key that is absent from the snapshot stays open.  A change
    to a version that was opened on ``as_of`` (or later) replaces it in place, so that no
    empty interval appears and repeating a run changes nothing.

    Closed versions pass straight through; only current rows take part in the one join.
    """
    data = [c for c in history.columns if c not in HISTORY_META]
    snapshot = same_layout(history.select(*data), incoming)
    layout = history.columns
    opened = stamp_current(snapshot, as_of, rule_version).select(*layout)
    opened = same_layout(history, opened)

    current = history.filter(F.col("is_current") & all_present(keys))
    untouched = history.filter(~(F.coalesce("is_current", F.lit(False)) & all_present(keys)))
    # A NULL key matches nothing; such rows are told apart by hash, so a repeat adds none.
    loose = absent_from(
        untouched.filter(~all_present(keys)), opened.filter(~all_present(keys)), hash_col
    )

    c = pack(current, keys, "_c")
    n = unique_or_fail(opened.filter(all_present(keys)), keys, "_n")
    joined = c.join(n, list(keys), "full_outer")

    cur, new = F.col("_c"), F.col("_n")
    day = F.lit(as_of).cast("date")
    closed = cur.withField("effective_end_date", day).withField("is_current", F.lit(False))
    replaced = new.withField("effective_start_date", F.col("_c.effective_start_date"))
    same = F.col(f"_c.{hash_col}").eqNullSafe(F.col(f"_n.{hash_col}"))
    versions = (
        F.when(cur.isNull(), F.array(new))
        .when(new.isNull() | same, F.array(cur))
        .when(F.col("_c.effective_start_date") >= day, F.array(replaced))
        .otherwise(F.array(closed, new))
    )
    merged = joined.select(F.inline(versions)).select(*layout)
    return untouched.unionByName(merged).unionByName(loose)


def check_scd2(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Integrity counters as rows (check_id, violations)."""
    per_key = history.groupBy(*keys).agg(
        F.count_if("is_current").alias("_current"),
        F.count_if(
            F.col("is_current") & (F.col("effective_end_date") != F.lit(OPEN_END).cast("date"))
        ).alias("_sentinel"),
        F.count_if(F.col("effective_start_date") >= F.col("effective_end_date")).alias("_empty"),
    )
    totals = per_key.agg(
        F.count_if(F.col("_current") > 1).alias("multiple_current"),
        F.coalesce(F.sum("_sentinel"), F.lit(0)).alias("open_end_missing"),
        F.coalesce(F.sum("_empty"), F.lit(0)).alias("empty_interval"),
    )
    return totals.unpivot([], totals.columns, "check_id", "violations")


def as_of(history: DataFrame, day) -> DataFrame:
    """The versions valid on ``day``."""
    d = F.lit(day).cast("date")
    return history.filter(
        (F.col("effective_start_date") <= d) & (d < F.col("effective_end_date"))
    )


def history_from_events(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie_break: Sequence[str],
    attrs: Sequence[str],
) -> DataFrame:
    """Intervals from an event list: a version starts where ``attrs`` change and ends where
    the next one starts (NULL while open).

    Look-back and look-ahead go along a global sort (see :mod:`ordered`), so a key with very
    many events spreads over tasks.
    """
    state = F.struct(*[F.col(a) for a in attrs])
    order = [ts, *tie_break]
    rows = events.select(*dict.fromkeys([*keys, *order, *attrs]))
    seen = carry(rows, keys, order, state, "_before")
    changes = seen.filter(~F.col("_before").eqNullSafe(state)).drop("_before")
    ended = carry(changes, keys, order, F.col(ts), "_end", backwards=True)
    return ended.select(
        *keys,
        *[a for a in attrs if a not in keys],
        F.col(ts).alias("start"),
        F.col("_end").alias("end"),
        F.col("_end").isNull().alias("is_current"),
    )


def check_intervals(
    history: DataFrame, keys: Sequence[str], start: str, end: str
) -> DataFrame:
    """Rows that overlap the previous interval of their key or leave a gap after it."""
    previous = carry(history, keys, [start, end], F.col(end), "previous_end")
    kind = F.when(F.col("previous_end") > F.col(start), "OVERLAP").when(
        F.col("previous_end") < F.col(start), "GAP"
    )
    return (
        previous.select(*keys, start, "previous_end", kind.alias("problem"))
        .filter(F.col("problem").isNotNull())
    )
