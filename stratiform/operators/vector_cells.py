"""Vectors laid out by k-means cells: exact top-k by cosine that leaves cells unread.

    path/items     by cell: id, vector, block, the other columns of the items
    path/cells     per cell: centre, radius, number of items and of blocks

For unit vectors q, x and a cell of centre c and radius r, q.x is at most q.c + r, and the
distance of q and x at least that of q and c less r.  A query visits the cells of the best
bounds first, and then only those whose bound reaches its k-th score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .retrieval import RANK_DIGITS, best_of, ranked, triples, unit_rows

#: Rows that the centres are fitted on at most, and cells at most.
FITTED, CELLS = 1 << 17, 4096
#: Items of a cell, and queries that visit it, which meet in one task at most.
BLOCK, QUERIES = 16_384, 16_384
#: Cells that a query visits before it has a threshold.
PROBED = 2
#: Scores are compared to 9 digits, so a bound this little below the k-th may still tie.
SLACK = 1e-8


def create_cells(
    items: DataFrame,
    path: str,
    *,
    item_id: str,
    vector: str,
    cells: int | None = None,
    fitted: int = FITTED,
    seed: int = 1,
) -> None:
    """Lay out ``items`` under the new folder ``path``.

    Centres are fitted by k-means on at most ``fitted`` rows, those of the least hashes, as
    many as the square root of the number of items or ``cells``; then every row goes to the
    cell of its nearest centre.  The centres only decide how much a query may leave out, never
    what it finds.  NULL vectors are left out; vectors of length zero have a cell of their own.
    """
    spark = items.sparkSession
    others = [c for c in items.columns if c not in (item_id, vector)]
    rows = items.where(F.col(vector).isNotNull()).select(
        F.col(item_id).alias("_i"), F.col(vector).cast("array<double>").alias("_v"), F.struct(F.lit(0), *others).alias("_rest")
    )
    n = rows.count()
    k = max(1, min(CELLS, cells or round(n**0.5)))
    null = F.exists("_v", lambda x: x != 0)
    unit = Normalizer(p=2.0, inputCol="_raw", outputCol="features").transform(
        rows.withColumn("_raw", array_to_vector("_v"))
    ).drop("_raw")
    some = unit.where(null).select("features").orderBy(F.xxhash64("_v")).limit(fitted)
    some = materialise(some, "cells-sample")
    if some.isEmpty():
        placed, centres = unit.withColumn("prediction", F.lit(-1)), []
    else:
        model = KMeans(k=k, maxIter=8, seed=seed).fit(some)
        centres = model.clusterCenters()
        placed = model.transform(unit).withColumn("prediction", F.when(null, F.col("prediction")).otherwise(-1))
    zero = [0.0] * (len(centres[0]) if len(centres) else 1)
    middle = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)] + [(-1, zero)], "cell int, centre array<double>"
    )
    placed = placed.withColumnRenamed("prediction", "cell").join(F.broadcast(middle), "cell")  # at most CELLS rows
    off = F.zip_with(vector_to_array("features"), "centre", lambda x, c: (x - c) * (x - c))
    far = F.sqrt(F.aggregate(off, F.lit(0.0), lambda a, x: a + x))
    placed = placed.select("cell", "_i", "_v", "_rest", F.when(F.col("cell") >= 0, far).otherwise(0.0).alias("far"))
    stored = materialise(placed, "cells-placed")
    # A millionth above the measured radius: sums in another order differ by less.
    sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), (F.max("far") + 1e-6).alias("radius"))
    sizes = sizes.join(middle, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    sizes.write.parquet(f"{path}/cells")
    count = spark.read.parquet(f"{path}/cells").select("cell", "blocks")
    block = F.pmod(F.xxhash64("_i"), F.col("blocks")).cast("int")
    laid = stored.join(count, "cell").select("cell", block.alias("block"), "_i", "_v", "_rest")
    laid.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").write.parquet(f"{path}/items")


@dataclass
class Nearest:
    """``ranked``: (query_id, rank, item_id, score).  ``cells``: per query, how many cells there
    are (``cells``) and how many were visited (``visited``)."""

    ranked: DataFrame
    cells: DataFrame


def search_cells(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    *,
    query_id: str,
    item_id: str,
    vector: str,
    where: Column | None = None,
    probed: int = PROBED,
) -> Nearest:
    """The rows of :func:`retrieval.vector_topk`, from a stored layout.

    Bounds come from the centres alone, at most CELLS of them, which go to every task.  Items
    move to the block of their cell that a query visits; queries are copied per visit, items
    once per QUERIES visitors of their cell.  ``where`` filters items by their other columns,
    named ``_rest.<column>``.
    """
    held = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    number = np.array([r["cell"] for r in held], np.int64)
    size = max((len(r["centre"]) for r in held if r["cell"] >= 0), default=0)
    centre = np.array([r["centre"] if r["cell"] >= 0 else [0.0] * size for r in held]).reshape(len(held), size)
    radius = np.array([r["radius"] for r in held])
    items = spark.read.parquet(f"{path}/items")
    if where is not None:
        items = items.where(where)
    items = items.select("cell", "block", "_i", "_v")
    q = queries.where(F.col(vector).isNotNull()).select(
        F.col(query_id).alias("_q"), F.col(vector).cast("array<double>").alias("_v")
    )
    q = materialise(q, "cells-queries")

    def bounds(v: np.ndarray) -> np.ndarray:
        """Per query and cell, what the cosine of an item can be at most."""
        middle = centre if size else np.zeros((len(number), v.shape[1]))  # only vectors of length zero
        dots = v @ middle.T
        length = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] - 2 * dots + (middle * middle).sum(1)))
        apart = np.maximum(0, length - radius)
        out = np.minimum(dots + radius, 1 - apart * apart / 2)
        still = (v * v).sum(1) < 0.5  # a query of length zero has the cosine 0 with all
        out[still] = 0.0
        out[:, number < 0] = 0.0
        return out

    def visits(least: bool):
        def run(parts):
            for p in parts:
                if not len(p):
                    continue
                found = bounds(unit_rows(p["_v"]))
                order = np.argsort(-found, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(number))[None, :], axis=1)
                chosen = rank < probed
                if least:
                    chosen = ~chosen & (found >= p["least"].to_numpy()[:, None] - SLACK)
                at, cell = np.nonzero(chosen)
                yield pd.DataFrame({"_q": p["_q"].to_numpy()[at], "cell": number[cell].astype(np.int32)})

        return run

    kind = T.StructType([q.schema["_q"], T.StructField("cell", T.IntegerType())])
    blocks = spark.read.parquet(f"{path}/cells").select("cell", "blocks")
    out = triples(q.schema["_q"].dataType, items.schema["_i"].dataType)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"_q": a["_q"][:0], "_i": b["_i"][:0], "_c": []})
        if not len(a) or not len(b):
            return none
        item = unit_rows(b["_v"])
        parts = [none]
        for s in range(0, len(a), 512):
            some = a.iloc[s : s + 512]
            cos = np.round(unit_rows(some["_v"]) @ item.T, RANK_DIGITS)
            parts.append(best_of(list(some["_q"]), cos, b["_i"], k))
        return pd.concat(parts, ignore_index=True)

    def score(chosen: DataFrame) -> DataFrame:
        crowd = chosen.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("crowds"))
        spread = crowd.join(blocks, "cell")
        left = chosen.join(spread, "cell").join(q, "_q").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("_q"), F.col("crowds")).cast("int").alias("crowd"), "_q", "_v",
        )
        right = items.join(crowd, "cell").select(
            "cell", "block", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "_i", "_v"
        )
        keys = ["cell", "block", "crowd"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, out)

    first = materialise(q.mapInPandas(visits(False), kind), "cells-first")
    early = materialise(ranked(score(first), k), "cells-early")
    last = early.where(F.col("rank") == k).select("_q", F.col("_c").alias("least"))
    rest = q.join(last, "_q", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    later = materialise(rest.select("_q", "_v", "least").mapInPandas(visits(True), kind), "cells-later")
    both = early.select("_q", "_i", "_c").unionByName(score(later))
    told = ranked(both, k).select(
        F.col("_q").alias(query_id), "rank", F.col("_i").alias(item_id),
        F.round(F.greatest(F.lit(0.0), F.col("_c")), 3).alias("score"),
    )
    seen = first.union(later).groupBy("_q").agg(F.count(F.lit(1)).alias("visited"))
    seen = seen.select(F.col("_q").alias(query_id), F.lit(len(number)).cast("long").alias("cells"), "visited")
    return Nearest(told, seen)
