"""Key joins between tables of a class-table-inheritance model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_blank
from .merge import unique_or_fail
from .ordered import carry


def current_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_current"))


@dataclass
class Branch:
    """A table joined to a root 1:0..1.  ``columns`` maps output name to column."""

    df: DataFrame
    root_key: str
    key: str
    columns: dict[str, str | Column] = field(default_factory=dict)
    current: bool = False


def flatten(root: DataFrame, branches: Sequence[Branch]) -> DataFrame:
    """Left-join every branch to ``root``.

    The current-version test runs on the branch before the join, so it never turns the
    outer join into an inner one, and only the listed columns are read.  Branches joined
    on the same root key share the root's single shuffle; Spark broadcasts those it
    measures as small.
    """
    out = root
    for i, b in enumerate(branches):
        side = current_only(b.df) if b.current else b.df
        key = f"_bk{i}"
        side = side.select(
            F.col(b.key).alias(key),
            *[
                (F.col(c) if isinstance(c, str) else c).alias(name)
                for name, c in b.columns.items()
            ],
        )
        out = out.join(side, out[b.root_key] == side[key], "left").drop(key)
    return out


def lookup(df: DataFrame, ref: DataFrame, df_key: str, ref_key: str, columns: dict) -> DataFrame:
    """Add reference columns by key; rows without a match keep NULLs.

    The query fails if a key of ``ref`` occurs twice: it would multiply rows.  The check
    needs the exchange that the join needs anyway.
    """
    given = {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    side = ref.select(F.col(ref_key).alias("_lk"), *[c.alias(f"_l_{n}") for n, c in given.items()])
    unique = unique_or_fail(side.filter(F.col("_lk").isNotNull()), ["_lk"], "_row")
    joined = df.join(unique, df[df_key] == unique["_lk"], "left")
    return joined.select(df["*"], *[F.col(f"_row._l_{n}").alias(n) for n in columns])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-blank key has no parent."""
    keys = parent.select(F.col(parent_key).alias("_pk"))
    rows = child.filter(~is_blank(child_key))
    return rows.join(keys, rows[child_key] == keys["_pk"], "left_anti")


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def lacks(
    parent: DataFrame,
    child: DataFrame,
    parent_key: str,
    child_key: str,
    parent_cond: Column | None = None,
    child_cond: Column | None = None,
) -> DataFrame:
    """Parents (meeting ``parent_cond``) without any child (meeting ``child_cond``)."""
    left = parent if parent_cond is None else parent.filter(parent_cond)
    right = child if child_cond is None else child.filter(child_cond)
    right = right.select(F.col(child_key).alias("_ck"))
    return left.join(right, left[parent_key] == right["_ck"], "left_anti")


def cross_check(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, bad: Column, columns
) -> DataFrame:
    """Child rows joined to their parent where ``bad`` holds over both.

    ``columns`` maps the parent columns that ``bad`` refers to: ``{alias: parent column}``.
    """
    side = parent.select(
        F.col(parent_key).alias("_pk"), *[F.col(c).alias(a) for a, c in columns.items()]
    )
    joined = child.join(side, child[child_key] == side["_pk"]).filter(bad)
    return joined.select(*child.columns, *columns)


def cross_check_or_missing(
    child: DataFrame,
    parent: DataFrame,
    sibling: DataFrame,
    child_key: str,
    parent_key: str,
    sibling_key: str,
    bad: Column,
    columns,
) -> DataFrame:
    """Child rows whose parent is ``bad`` or that have no row in ``sibling``."""
    side = parent.select(
        F.col(parent_key).alias("_pk"), *[F.col(c).alias(a) for a, c in columns.items()]
    )
    sib = sibling.select(F.col(sibling_key).alias("_sk")).distinct()
    joined = child.join(side, child[child_key] == side["_pk"])
    joined = joined.join(sib, joined[child_key] == sib["_sk"], "left")
    return joined.filter(bad | F.col("_sk").isNull()).select(*child.columns, *columns)


def overlap(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Distinct keys found in both tables."""
    left = a.select(F.col(a_key).alias("key")).distinct()
    right = b.select(F.col(b_key).alias("_rk"))
    return left.join(right, left["key"] == right["_rk"], "left_semi")


def via_bridge(
    a: DataFrame, bridge: DataFrame, b: DataFrame, on_a: tuple[str, str], on_b: tuple[str, str]
) -> DataFrame:
    """``a`` to ``b`` through a many-to-many bridge."""
    left = bridge.join(a, bridge[on_a[1]] == a[on_a[0]])
    return left.join(b, left[on_b[0]] == b[on_b[1]])


def coverage(mart: DataFrame, dim: DataFrame, mart_key: str, dim_key: str) -> DataFrame:
    """One row: how many mart rows and distinct keys the dimension does not cover."""
    missing = orphans(mart, dim, mart_key, dim_key)
    return missing.agg(
        F.count(F.lit(1)).alias("missing_rows"),
        F.count_distinct(mart_key).alias("missing_keys"),
    )


def as_of_join(
    facts: DataFrame,
    history: DataFrame,
    key: str,
    ts: str,
    start: str,
    end: str,
    columns: Sequence[str],
) -> DataFrame:
    """Point-in-time lookup: the history row with ``start <= ts < end``.

    Facts and version starts are laid on one time line per key and the nearest earlier
    start is carried forward (see :mod:`ordered`), so neither a key with very many facts
    nor one with very many versions meets in a single task, and no fact x version pairs
    are formed.  History intervals of a key must not overlap.  Facts with a NULL key match
    nothing and go round the time line.
    """
    version = F.struct(F.col(end).alias("_to"), *[F.col(c) for c in columns])
    # A NULL key matches nothing.
    marks = history.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(start).cast("timestamp").alias("_at"),
        F.lit(0).alias("_kind"),
        version.alias("_version"),
        F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("_fact"),
    )
    loose = facts.filter(F.col(key).isNull())
    rows = facts.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(ts).cast("timestamp").alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(marks.schema["_version"].dataType).alias("_version"),
        F.struct("*").alias("_fact"),
    )
    line = carry(
        marks.unionByName(rows),
        ["_key"],
        ["_at", "_kind"],
        F.col("_version"),
        "_hit",
        inclusive=True,
    )
    hit = F.when(F.col("_at") < F.col("_hit._to").cast("timestamp"), F.col("_hit"))
    found = (
        line.filter("_kind = 1")
        .withColumn("_hit", hit)
        .select("_fact.*", *[F.col(f"_hit.{c}").alias(c) for c in columns])
    )
    none = [F.lit(None).cast(history.schema[c].dataType).alias(c) for c in columns]
    return found.union(loose.select("*", *none))
