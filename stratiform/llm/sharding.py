"""Shards of near-equal bytes: a minimax cut of the ordered groups of equal texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import partitions, running_sums

#: Capacities that one pass over the group starts tries.
TRIED = 32


def shard(
    docs: DataFrame,
    shards: int,
    *,
    text: str = "text",
    key: str = "doc_id",
    carry: Sequence[str] | None = None,
    purpose: str = "shard",
) -> DataFrame:
    """Cut ``docs`` into ``shards`` contiguous runs so that the fullest is as small as can be.

    Rows are ordered by the digest of their text, then by ``key``.  Equal texts are one
    atomic group and share a shard.  Adds ``_size`` (UTF-8 bytes plus 1), ``_crc32``,
    ``_shard`` and ``_slot`` (gapless from 0 in every shard) to the columns of ``docs``.

    The answer to "how small can the fullest shard be" is searched by bisection in the
    TRIED-fold: a capacity is feasible if the greedy cut needs no more than ``shards`` runs.
    The greedy cut asks for the last group start at or below an offset; a pass answers for
    all capacities of a round at once, and the passes read only group starts.  Of the cuts
    that keep the smallest capacity, each is then put where it leaves its shard nearest to an
    equal part of what is left.  A group wider than an equal part has a shard of its own, so
    it does not make the other shards unequal.

    Defined results: a NULL text has size 1, no checksum, and forms one group with the other
    NULLs; empty texts have size 1 and checksum 0; rows that repeat are kept, each with a
    slot of its own (ties in any order, as they are equal); NULL keys sort first.  Shards are
    empty only where the groups left are too few; an empty table gives an empty result.
    ``carry`` names the columns of ``docs`` to keep (all by default); other columns are not
    shuffled.  Columns with the names of added ones are replaced, others may have any name.
    """
    added = ("_size", "_crc32", "_shard", "_slot")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    sized = docs.select(
        F.struct(*carry).alias("kept") if carry else F.lit(None).cast("int").alias("kept"),
        F.col(key).alias("key"),
        F.coalesce(F.md5(text), F.lit("")).alias("group"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text).alias("crc32"),
    )
    ordered = running_sums(
        sized, [F.col("group"), F.col("key")], {"start": "size", "row": "*"}, purpose
    )
    starts = materialise(
        ordered.groupBy("group").agg(
            F.min("start").alias("start"), F.sum("size").alias("bytes"), F.min("row").alias("row")
        ),
        purpose,
    )
    total, widest = starts.agg(F.sum("bytes"), F.max("bytes")).first()

    def result(shard_of: Column, first_row: Column) -> DataFrame:
        return ordered.select(
            *(F.col(f"kept.`{c}`").alias(c) for c in carry),
            F.col("size").alias("_size"), F.col("crc32").alias("_crc32"),
            shard_of.alias("_shard"), (F.col("row") - first_row).alias("_slot"),
        )

    if total is None:
        return result(F.lit(0), F.lit(0).cast("long"))

    def groups_at(offsets: Sequence[int]) -> dict[int, tuple[int, int]]:
        """For each offset the start and end of the group that holds it; beyond all: the end."""
        inner = sorted({o for o in offsets if o < total})
        found = dict.fromkeys((o for o in offsets if o >= total), (total, total))
        if inner:
            end = F.col("start") + F.col("bytes")
            near = starts.where((F.col("start") <= inner[-1]) & (end > inner[0]))
            asked = F.lit(np.array(inner, np.int64))
            # Exactly one group holds an offset, and at most TRIED offsets are asked for.
            inside = F.filter(asked, lambda o: (F.col("start") <= o) & (o < end))
            got = near.select("start", end.alias("end"), F.explode(inside).alias("offset")).collect()
            found.update({r["offset"]: (r["start"], r["end"]) for r in got})
        return found

    def fits(capacities: Sequence[int]) -> list[int]:
        """The capacities for which the greedy cut ends in time, side by side."""
        at = dict.fromkeys(capacities, 0)
        for _ in range(shards):
            live = [c for c in capacities if at[c] < total]
            if not live:
                break
            found = groups_at([at[c] + c for c in live])
            at.update({c: found[at[c] + c][0] for c in live})
        return [c for c in capacities if at[c] == total]

    low, high = max(widest, -(-total // shards)), -(-total // shards) + widest
    while low < high:
        step = max(1, -(-(high - low) // TRIED))
        tried = sorted({*range(low, high, step), high})
        best = fits(tried)[0]
        below = [c for c in tried if c < best]
        low, high = (below[-1] + 1 if below else low), best
    # Fewer than ``shards`` groups are wider than an equal part.
    wide = starts.where(F.col("bytes") * shards > total).select("start", "bytes").collect()
    around = sorted((r["start"], r["start"] + r["bytes"]) for r in wide)
    firsts = cuts_around(groups_at, around, total, shards, high)
    if firsts is None:
        firsts = even_cuts(groups_at, total, shards, high)
    at = starts.where(F.col("start").isin(firsts))
    rows = {r["start"]: r["row"] for r in at.collect()}
    shard_of = F.lit(0)
    first_row = F.lit(0).cast("long")
    for i, c in enumerate(firsts):
        shard_of = F.when(F.col("start") >= c, i).otherwise(shard_of)
        first_row = F.when(F.col("start") >= c, rows[c]).otherwise(first_row)
    return result(shard_of, first_row)


def cuts_around(
    groups_at, wide: list[tuple[int, int]], total: int, shards: int, capacity: int
) -> list[int] | None:
    """Starts of the shards where ``wide`` groups have one each, and what lies between them
    gets its share of the others, in equal parts; None if that does not keep ``capacity``."""
    between = list(zip([0, *(e for _, e in wide)], [*(s for s, _ in wide), total]))
    each = (total - sum(e - s for s, e in wide)) / max(1, shards - len(wide))
    own, free = [list(w) for w in wide], []
    for i, (a, b) in enumerate(between):
        if 0 < b - a < each / 2:  # a small rest goes along with a wide group, if it may
            if i > 0 and b - own[i - 1][0] <= capacity:
                own[i - 1][1] = a = b
            elif i < len(own) and own[i][1] - a <= capacity:
                own[i][0] = b = a
        if b > a:
            free.append((a, b))
    spare = shards - len(wide) - len(free)
    if spare < 0:
        return None
    share = [max(1, int((b - a) / each)) for a, b in free]
    while sum(share) < shards - len(wide) and free:
        at = max(range(len(free)), key=lambda i: (free[i][1] - free[i][0]) / share[i])
        share[at] += 1
    asked = [a + (b - a) * j // n for (a, b), n in zip(free, share) for j in range(1, n)]
    found = groups_at(asked) if asked else {}
    cuts = [s if o - s <= e - o else e for o, (s, e) in found.items()]
    firsts = sorted({*(a for a, _ in free), *(s for s, _ in own), *cuts} - {total})
    sizes = [b - a for a, b in zip(firsts, [*firsts[1:], total])]
    return firsts if len(firsts) <= shards and max(sizes) <= capacity else None


def even_cuts(groups_at, total: int, shards: int, capacity: int) -> list[int]:
    """Starts of the shards, none above ``capacity``, each near an equal part of the rest."""
    # From the right: where the last j shards may begin at the earliest.
    earliest = [total]
    while len(earliest) < shards and earliest[-1] > 0:
        offset = earliest[-1] - capacity
        start, end = groups_at([offset])[offset] if offset > 0 else (0, 0)
        earliest.append(start if start == max(offset, 0) else end)
    earliest += [0] * (shards - len(earliest))
    firsts = [0]
    for left in range(shards - 1, 0, -1):
        here = firsts[-1]
        ideal, most = here + (total - here) // (left + 1), here + capacity
        found = groups_at([here, ideal, most])
        start, end = found[ideal]
        cut = start if ideal - start <= end - ideal else end
        cut = max(cut, found[here][1], earliest[left])  # a group at least, and room for the rest
        cut = min(cut, found[most][0])
        if cut >= total:
            break
        firsts.append(cut)
    return firsts


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows sorted by slot within and across files."""
    order = ["_shard", "_slot"]
    dealt = sharded.repartitionByRange(partitions(sharded.sparkSession), *order)
    dealt.sortWithinPartitions(*order).write.partitionBy("_shard").parquet(path)
