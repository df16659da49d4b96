"""Look-back over ordered rows that stays bounded per task.

A plain ``lag`` window puts all rows of a key in one task, and a single key may hold a
third of a table.  Here all rows are range-sorted by key and order into one written table,
whose ranges cut any key into pieces.  One window runs inside each (key, range); the last
value of every piece is aggregated with map-side combine and carried over to later pieces
by a second window that sees one row per piece.  The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_PART, _RANGE, _VAL = "_carry_part", "_range", "_carry_value"
_IN, _CARRY = "_carry_inside", "_carry_last"


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    inclusive: bool = False,
    backwards: bool = False,
) -> DataFrame:
    """Add ``name``: the nearest non-null ``value`` before each row in ``order``.

    ``inclusive`` lets a row see its own value; ``backwards`` looks at later rows instead (a
    lead).  ``order`` must be total within a key.  Runs one job, the range sort: its cuts
    come from a sample, so they must not be drawn twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(_VAL, value).repartitionByRange(n, *keys, *order)
    ranged = materialise(ranged.withColumn(_RANGE, F.spark_partition_id()), "carry")
    # Key and range as one struct: NULLs in it compare as equal, and window, aggregate and
    # join all use the same partitioning, so the rows are exchanged once.
    work = ranged.withColumn(_PART, F.struct(*keys, _RANGE)).drop(_RANGE)
    asc = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    inside = (
        Window.partitionBy(_PART)
        .orderBy(*asc)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    rows = work.withColumn(_IN, F.last(_VAL, ignorenulls=True).over(inside)).drop(_VAL)

    rank = F.when(F.col(_VAL).isNotNull(), F.struct(*order))
    last = F.min_by(_VAL, rank) if backwards else F.max_by(_VAL, rank)
    position = F.col(f"{_PART}.{_RANGE}")
    across = (
        Window.partitionBy(*[F.col(_PART)[k] for k in keys])
        .orderBy(position.desc() if backwards else position.asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_range = (
        work.groupBy(_PART)
        .agg(last.alias(_CARRY))
        .withColumn(_CARRY, F.last(_CARRY, ignorenulls=True).over(across))
        .select(F.col(_PART).alias("_before_part"), _CARRY)
    )
    joined = rows.join(per_range, rows[_PART] == per_range["_before_part"], "left")
    return joined.withColumn(name, F.coalesce(_IN, _CARRY)).drop(_PART, _IN, _CARRY, "_before_part")
