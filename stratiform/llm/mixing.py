"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import running_sums, word_count

#: No document is taken more often than this.
EPOCHS = 3


def shares(sources: DataFrame, weights: Sequence[int], epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share the sum of
    all sizes.  A target stops at ``epochs`` times the source's size; the excess is shared
    by weight among the others until none is above.  Each round is one aggregate, and only
    two sums go over the driver, whatever the number of sources.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = running_sums(sources, order, {"_rank": "*"}, "mix-sources")
    turn = (F.col("_rank") % len(weights)).cast("int") + 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn)
    ranked = materialise(ranked.withColumn("weight", weight), "mix-weights")
    cap = F.col("source_size") * epochs
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, found = None, None
    while True:
        capped = F.lit(False) if level is None else cap <= F.col("weight") * level
        sums = (
            F.sum(F.when(capped, cap).otherwise(0)).alias("full"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"),
        )
        r = ranked.agg(*sums).first()
        if r["n"] == found or not r["open"]:
            break
        found, level = r["n"], (whole - r["full"]) / r["open"]
    share = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", "weight", share.alias("target"))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    epochs: int = EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """How many copies of each document the mix holds: one row per distinct document.

    Columns: ``key``, ``source``, ``_digest`` (of the text), ``_rows`` (equal rows),
    ``size`` (words), ``source_size``, ``target``, ``copies``.

    Every source's documents queue in a shuffled order (a keyed hash, so reruns agree), up
    to ``epochs`` times over.  The virtual finish time of a document is the words its source
    has queued, itself included, divided by the source's target.  All queue entries are
    range-sorted by finish time and cut where the words reach the sum of the targets; the
    entry that crosses the budget is taken if that brings the sum nearer to it.

    The running words of a source come from one global range sort by (source, hash), less
    the words of all sources before it: a source with a third of all rows spreads over many
    tasks.  Entries carry no texts.

    Defined results: NULL and blank texts have size 0 and are never copied; a NULL source is
    a source like others; rows equal in key, source and text share one decision, and
    ``_rows`` counts them; with no words at all every target is 0.
    """
    entries = materialise(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            digest(text),
        )
        .groupBy("source", "key", "_digest", "size")
        .agg(F.count("*").alias("_rows"))
        .withColumns(
            {"_turn": F.xxhash64(F.lit(seed), "key", "_digest"), "_words": F.col("size") * F.col("_rows")}
        ),
        "mix-entries",
    )
    totals = shares(
        entries.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, epochs
    )
    by_source = [F.col("source").asc_nulls_last()]
    starts = running_sums(totals, by_source, {"_source_start": "source_size"}, "mix-starts")
    queued = running_sums(
        entries, [*by_source, *map(F.col, ("_turn", "key", "_digest"))],
        {"_before": "_words"}, "mix-queue",
    )
    s = starts.withColumnRenamed("source", "_source")
    queued = queued.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = queued.withColumn("_end", F.col("_before") + F.col("_words") - F.col("_source_start"))
    wanted = queued.where((F.col("_words") > 0) & (F.col("target") > 0))
    # An entry of a later epoch can only be taken if its source's target reaches that far,
    # give or take what one entry can overshoot; the rest of the queue is not sorted.
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    items = wanted.select("source", "key", "_digest", "size", "_words", "_end", "_turn",
                          "source_size", "target", epoch.alias("epoch"))
    finish = (F.col("epoch") * F.col("source_size") + F.col("_end")) / F.col("target")
    items = items.withColumn("_finish", finish).drop("_end", "source_size", "target")
    total = totals.agg(F.sum("target")).first()[0] or 0.0
    line = running_sums(
        items, [F.col(c) for c in ("_finish", "_turn", "source", "key", "_digest", "epoch")],
        {"_taken": "_words"}, "mix-line",
    )
    inside = F.col("_taken") + F.col("_words") / 2 <= F.lit(float(total))
    taken = line.where(inside).groupBy("source", "key", "_digest").agg(F.count("*").alias("copies"))
    t = taken.select(F.struct("source", "key", "_digest").alias("_t"), "copies")
    out = queued.join(t, F.struct("source", "key", "_digest").eqNullSafe(F.col("_t")), "left")
    return out.select(
        F.col("key").alias(key), F.col("source").alias(source), "_digest", "_rows", "size",
        "source_size", "target", F.coalesce("copies", F.lit(0).cast("long")).alias("copies"),
    )


def digest(text: str) -> Column:
    """What tells rows of one key apart: NULL and texts by value."""
    return F.xxhash64(F.col(text).isNull(), F.col(text)).alias("_digest")


def take(docs: DataFrame, plan: DataFrame, *, key: str = "doc_id", source: str = "source",
         text: str = "text") -> DataFrame:
    """``docs`` as the plan of :func:`mix` has them: each row as often as it is copied.

    Texts are shuffled once, by document; a repeated document is the long side of a join
    against unique rows, which Spark splits when it is skewed.
    """
    own = [F.col(source), F.col(key), F.col("_digest")]
    p = plan.where("copies > 0").select(
        F.xxhash64(*own).alias("entry"), F.struct(*own).alias("own"), "copies"
    )
    here = [F.col(source), F.col(key), digest(text)]
    row = F.struct(*docs.columns).alias("doc")  # apart from the helper columns, whatever its names
    d = docs.select(row, F.xxhash64(*here).alias("mine"), F.struct(*here).alias("it"))
    both = d.join(p, (F.col("mine") == F.col("entry")) & F.col("it").eqNullSafe(F.col("own")))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return both.select("doc", copy.alias("copy")).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
