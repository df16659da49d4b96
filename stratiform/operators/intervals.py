"""Joins of points with intervals that may overlap: every match, by equal keys only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A bin of one level holds 2^BITS bins of the level below; the lowest one is a day.
BITS = 3
LEVELS = 8
#: Bins may be so many times as long as the intervals.
WIDER = 4
#: Day number that an open end stands for (31 December 9999).
LAST_DAY = 2_932_896


def day_number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    return F.unix_date(c.cast("date"))


def cover(first: Column, last: Column, base: int = 0) -> Column:
    """The days ``first`` to ``last`` as few bins that don't overlap: array of (level, bin).

    At each level the bins up to the next whole bin of the level above stand at the left and
    at the right end; what lies between goes up.  At most 2 * (2^BITS - 1) bins a level.
    With a ``base`` no bin is of a lower level: those at the ends may reach beyond the days.
    """
    size = 1 << BITS
    none = F.array().cast("array<bigint>")

    # A bin as one number, so that bins in a row are a sequence: no function per day.
    def bins(level: int, a: Column, c: Column) -> Column:
        number = [x.cast("bigint") * LEVELS + level for x in (a, c - 1)]
        return F.when(a < c, F.sequence(*number, F.lit(LEVELS).cast("bigint"))).otherwise(none)

    def part(level: int, a: Column, c: Column) -> Column:
        if level == LEVELS - 1:
            return bins(level, a, c)
        up, down = F.shiftright(a + (size - 1), BITS), F.shiftright(c, BITS)
        ends = [bins(level, a, up * size), bins(level, down * size, c)]
        return F.when(up > down, bins(level, a, c)).when(up == down, F.concat(*ends)).otherwise(
            F.concat(*ends, part(level + 1, up, down))
        )

    numbers = part(base, F.shiftright(first, BITS * base), F.shiftright(last, BITS * base) + 1)
    return F.transform(
        numbers,
        lambda x: F.struct(
            F.pmod(x, F.lit(LEVELS)).cast("int").alias("level"), F.floor(x / LEVELS).cast("int").alias("bin")
        ),
    )


def _base(lengths: DataFrame) -> tuple[int, int]:
    """The lowest level for intervals of these ``days`` and the highest that any may need.

    A bin of the lowest level is at most WIDER times as long as the intervals are on (geometric)
    average, so some points that it holds beside those of an interval, and a few copies of each
    interval, take the place of bins for every day.
    """
    mean, most = lengths.agg(F.avg(F.log(F.col("days"))), F.max("days")).first()
    if most is None:
        return 0, 0
    low, high = (
        max([v for v in range(LEVELS) if 1 << BITS * v <= days], default=0) for days in (WIDER * math.exp(mean), most)
    )
    return low, max(low, high)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
) -> DataFrame:
    """Every pair of a point and an interval of its ``key`` with start <= at < end.

    Returns the columns of ``points`` as struct ``point`` and those of ``intervals`` as struct
    ``interval``.  ``at``, ``start`` and ``end`` are dates or timestamps; a NULL ``end`` is open.

    An interval is cut into bins of growing size, a point lies in one bin per level, and both
    meet on (key, level, bin): each pair once, as the bins of an interval don't overlap.  Then
    the exact times decide.  A hot key is spread over its bins; one bin with very many points
    is the long side of a join that AQE splits.  Points are copied for the levels in use, at
    most LEVELS; intervals have some dozen bins at most, whatever their length.  The lowest
    level follows their usual length: where they are all alike it is the only one, a point is
    shuffled once, and an interval about once or twice.

    NULL keys, points and starts match nothing, nor do intervals that end before they start.
    Rows that repeat match by themselves.
    """
    kind = {f.name: f.dataType for f in intervals.schema.fields}
    first = day_number(F.col(start), kind[start])
    last = F.coalesce(day_number(F.col(end), kind[end]), F.lit(LAST_DAY))
    sane = F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end)))
    base, top = _base(intervals.where(sane).select((last - first + 1).alias("days")))
    row = F.struct(*[F.col(f"`{c}`") for c in intervals.columns])
    cut = intervals.where(sane).select(F.col(key).alias("k"), row.alias("interval"), cover(first, last, base).alias("b"))
    bins = cut.select("k", "interval", F.inline("b"))
    # As many numbers as there are levels; a level that no interval uses costs no copies.
    used = [base] if base == top else sorted(r[0] for r in bins.select("level").distinct().collect())
    own = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    day = day_number(F.col(at), points.schema[at].dataType)
    places = F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright(day, BITS * v).alias("bin")) for v in used])
    places = places if used else F.array().cast("array<struct<level:int,bin:int>>")
    placed = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("k"), own.alias("point"), F.inline(places)
    )
    met = placed.join(bins, ["k", "level", "bin"])
    here = F.col(f"point.`{at}`")
    inside = (F.col(f"interval.`{start}`") <= here) & (
        F.col(f"interval.`{end}`").isNull() | (here < F.col(f"interval.`{end}`"))
    )
    return met.where(inside).select("point", "interval")
