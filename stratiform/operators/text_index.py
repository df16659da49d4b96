"""A stored inverted index: postings in blocks, exact BM25 top-k that leaves blocks unread.

Documents lie in segments of a few dozen.  A block holds the postings of one term in one
segment, with the figures that bound what the term can add to the score of any of its
documents.  A query first adds up the bounds of its terms per segment, without any posting;
it then scores the most promising segments, and after that only those whose bound reaches
the k-th best score found there.

    path/gen=<g>/blocks   by bucket of the term: term, segment, bounds, postings; a posting has
                          the place of its document in the segment.  In bucket -1, per segment,
                          its documents with their numbers of words
    path/dead/<g>         versions of segments that no longer count, as of generation g
    path/stats/<g>        documents and words as of generation g; written last
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .retrieval import BM25_DIGITS, counted, ranked, words
from .sinks import path_exists

#: Documents of a segment, and buckets of terms (folders, of which a query opens its own).
SEGMENT, BUCKETS = 64, 64
#: Segments that a query scores before it has a threshold.
PROBED = 4
#: Bounds and scores are sums in another order; a segment this little below is still scored.
SLACK = 1e-9
#: A posting is one number: the document's place in its segment, and its frequency above.
PLACE = 20
#: Bucket of the rows that list the documents of a segment; their term is empty, as no word is.
LISTS = -1
BLOCK = (
    "term string, segment bigint, n int, most int, shortest int, postings array<bigint>, "
    "docs array<{doc}>, lens array<int>"
)
#: Blocks on their way to their bucket: those of a term from one batch of documents in a row.
PACKED = (
    "term string, segments array<bigint>, starts array<int>, n array<int>, most array<int>, shortest array<int>, "
    "postings array<bigint>, docs array<{doc}>, lens array<int>"
)
#: Queries whose choice of a segment is one number, a bit each.
BITS = 64
#: So many segments with a few hundred bytes each may be sent to all executors.
SENT = 50_000


def bags(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, len, terms) of every document; a NULL text is an empty document."""
    own = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    return docs.select(F.col(doc_id).alias("doc"), own.alias("w")).select(
        "doc", F.size("w").alias("len"), counted(F.col("w")).alias("terms")
    )


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents in order of their segment to the rows of PACKED; nothing is shuffled."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        # The last segment may go on in the next batch.
        segment = t["segment"].to_numpy()
        cut = int(np.searchsorted(segment, segment[-1]))
        rest = t.slice(cut)
        yield from _cut(t.slice(0, cut))
    if rest is not None:
        yield from _cut(rest)


def _cut(t: pa.Table) -> Iterator[pa.RecordBatch]:
    if not len(t):
        return
    t = t.combine_chunks()
    segment, length = t["segment"].to_numpy(), t["len"].to_numpy()
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(t)]))
    place = np.arange(len(t)) - first[own]
    offsets = pa.array(np.r_[first, len(t)], pa.int32())
    docs, lens = (pa.ListArray.from_arrays(offsets, t[c].chunk(0)) for c in ("doc", "len"))
    names = ["term", "segments", "starts", "n", "most", "shortest", "postings", "docs", "lens"]

    def each(values) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1), pa.int32()), pa.array(values))

    zero = each(np.zeros(len(first), np.int32))
    none = pa.array([[]] * len(first), pa.list_(pa.int64()))
    lists = [pa.array([""] * len(first)), each(segment[first]), zero, zero, zero, zero, none, docs, lens]
    yield pa.RecordBatch.from_arrays(lists, names)
    row = np.repeat(np.arange(len(t)), pc.list_value_length(t["terms"]).to_numpy())
    if not len(row):
        return
    pairs = pc.list_flatten(t["terms"].chunk(0))
    tf = pc.struct_field(pairs, "tf").to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.struct_field(pairs, "t"))
    key = coded.indices.to_numpy().astype(np.int64) * len(first) + own[row]
    order = np.argsort(key, kind="stable")
    key, row, tf = key[order], row[order], tf[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    code = key[start] // len(first)
    block = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])  # the first one of each term

    def by_term(values, ends=np.r_[block, len(start)], kind=pa.int32()) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

    parts = [
        coded.dictionary.take(pa.array(code[block])), by_term(segment[row[start]], kind=pa.int64()),
        by_term(start - np.repeat(start[block], np.diff(np.r_[block, len(start)]))),
        by_term(np.diff(np.r_[start, len(key)])), by_term(np.maximum.reduceat(tf, start)),
        by_term(np.minimum.reduceat(length[row], start)),
        by_term((tf.astype(np.int64) << PLACE) | place[row], np.r_[start[block], len(key)], pa.int64()),
        pa.nulls(len(block), docs.type), pa.nulls(len(block), lens.type),
    ]
    yield pa.RecordBatch.from_arrays(parts, names)


def _unpacked(packed: DataFrame) -> DataFrame:
    """Rows of BLOCK with their bucket."""
    blocks = """transform(segments, (s, i) -> struct(s as segment, n[i] as n, most[i] as most,
        shortest[i] as shortest, slice(postings, starts[i] + 1, n[i]) as postings))"""
    return packed.select("bucket", "term", "docs", "lens", F.expr(f"inline({blocks})"))


def _write(blocks: DataFrame, path: str, gen: int) -> None:
    """Store rows of BLOCK or PACKED: one shuffle, to some files per bucket."""
    packed = "segments" in blocks.columns
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.get("segments", F.lit(0)) if packed else F.col("segment")
    dealt = F.pmod(F.xxhash64(first), F.lit(max(1, 2 * partitions // BUCKETS)))
    bucket = F.when(F.col("term") == "", LISTS).otherwise(_bucket(F.col("term")))
    dealt = blocks.withColumns({"bucket": bucket, "_part": dealt}).repartition("bucket", "_part").drop("_part")
    dealt = dealt.sortWithinPartitions("bucket", "term", first)
    dealt = _unpacked(dealt) if packed else dealt
    dealt.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/gen={gen}/blocks")


def _write_documents(own: DataFrame, path: str, gen: int, kind: str) -> None:
    """Store the blocks of ``own`` (doc, segment, len, terms), a segment within a task."""
    _write(own.mapInArrow(_blocks, PACKED.format(doc=kind)), path, gen)


def _note(index: Index) -> None:
    """Write what is dead and, last, the figures of a load whose blocks are stored."""
    index.dead.write.parquet(f"{index.path}/dead/{index.gen}")
    again = index.read("bags").groupBy("doc").count().where("count > 1")
    row = [(index.n, index.words, not again.isEmpty(), index.kind)]
    row = index.spark.createDataFrame(row, "n long, words long, again boolean, kind string")
    row.coalesce(1).write.parquet(f"{index.path}/stats/{index.gen}")


def _totals(own: DataFrame) -> tuple[int, int]:
    n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    return n, total


def create_index(
    docs: DataFrame, path: str, *, doc_id: str, text: str, segment: int = SEGMENT
) -> None:
    """Index ``docs`` under the new folder ``path``.

    Documents of a scan task are ordered by their most frequent word and their length, so
    that a segment holds documents of one kind and its bounds are tight.  Blocks are made
    where the texts are read; they are shuffled once, to the bucket of their term.
    """
    spark = docs.sparkSession
    own = _segmented(bags(docs, doc_id, text), segment, 0)
    kind = own.schema["doc"].dataType.simpleString()
    _write_documents(own, path, 0, kind)
    none = spark.createDataFrame([], "segment long, gen int")
    index = Index(spark, path, 0, 0, 0, none, False, kind)
    index.n, index.words = _totals(index.read("bags"))
    _note(index)


def _segmented(own: DataFrame, segment: int, gen: int) -> DataFrame:
    kind = F.array_max(F.transform("terms", lambda x: F.struct(x["tf"], x["t"])))["t"]
    ordered = own.withColumn("kind", kind).sortWithinPartitions("kind", "len", F.xxhash64("doc"))
    if not 0 < segment <= 1 << PLACE:
        raise ValueError(f"a segment holds 1 to {1 << PLACE} documents")
    # Task number * 2^33 / segment + row of the task / segment; generations lie 2^50 apart.
    at = F.expr(f"monotonically_increasing_id() div {int(segment)}") + F.lit(gen * (1 << 50))
    return ordered.select("doc", at.alias("segment"), "len", "terms")


@dataclass
class Index:
    """An index as of its last finished load."""

    spark: SparkSession
    path: str
    gen: int
    n: int
    words: int
    dead: DataFrame
    #: Whether a document's id occurs twice, and the type of the ids.
    again: bool
    kind: str

    def read(self, part: str) -> DataFrame:
        """The live ``bags`` (doc, segment, place, len) or rows of BLOCK, with their generation."""
        if part == "bags":
            # A document that was replaced leaves its place, without a length.
            each = F.posexplode(F.arrays_zip("docs", "lens")).alias("place", "x")
            lists = self.read("blocks").where(F.col("bucket") == LISTS).select("segment", "gen", each)
            return lists.select(F.col("x.docs").alias("doc"), "segment", "place", F.col("x.lens").alias("len"), "gen").where("len is not null")
        # A load without documents has written no file to infer this from.
        reader = self.spark.read.schema(f"{BLOCK.format(doc=self.kind)}, bucket int")
        parts = [
            reader.parquet(f"{self.path}/gen={g}/blocks").withColumn("gen", F.lit(g))
            for g in range(self.gen + 1)
        ]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        # Versions of segments that were replaced; a narrow anti join, none after one load.
        return both if self.gen == 0 else both.join(self.dead, ["segment", "gen"], "left_anti")


def open_index(spark: SparkSession, path: str) -> Index:
    gen = 0
    while path_exists(spark, f"{path}/stats/{gen + 1}/_SUCCESS"):
        gen += 1
    n, total, again, kind = spark.read.parquet(f"{path}/stats/{gen}").first()
    return Index(spark, path, gen, n, total, spark.read.parquet(f"{path}/dead/{gen}"), again, kind)


def upsert_documents(docs: DataFrame, path: str, *, doc_id: str, text: str, segment: int = SEGMENT) -> None:
    """Add documents, or put them in place of those with the same id.

    Documents to replace leave their segments: only segments that hold one are written again,
    as part of a new generation, next to the segments of the new documents.  Earlier files
    stay as they are; the load counts once its statistics are written, so readers see all of
    it or nothing, and a load that was cut off is written over by the next.  A NULL id
    matches nothing: such documents are added.  An id twice in ``docs`` fails the load.
    """
    spark = docs.sparkSession
    now = open_index(spark, path)
    gen = now.gen + 1
    for part in ("gen={}", "dead/{}", "stats/{}"):
        _clear(spark, f"{path}/{part.format(gen)}")
    _write_documents(_segmented(bags(docs, doc_id, text), segment, gen), path, gen, now.kind)
    # The load by itself, as stored: the documents are read once.
    lists = spark.read.schema(f"{BLOCK.format(doc=now.kind)}, bucket int").parquet(f"{path}/gen={gen}/blocks")
    each = F.inline(F.arrays_zip("docs", "lens")).alias("doc", "len")
    fresh = materialise(lists.where(F.col("bucket") == LISTS).select(each), "index-documents")
    if not fresh.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty():
        _clear(spark, f"{path}/gen={gen}")
        raise ValueError("a document occurs more than once in one load")
    replaced = materialise(now.read("bags").join(fresh.select("doc"), "doc", "left_semi"), "index-replaced")
    met = replaced.groupBy("segment", "gen").agg(F.collect_set("place").alias("gone"))
    held = now.read("blocks")
    lens = held.where(F.col("bucket") == LISTS).select("segment", "gen", F.col("lens").alias("own"))
    met = materialise(met.join(lens, ["segment", "gen"]), "index-segments")
    _write(_without(held, F.broadcast(met) if met.count() <= SENT else met), path, gen)
    gone, added = _totals(replaced), _totals(fresh)
    n, total = (a - b + c for a, b, c in zip((now.n, now.words), gone, added))
    dead = now.dead.select("segment", "gen").union(met.select("segment", "gen"))
    _note(Index(spark, path, gen, n, total, dead, False, now.kind))


def _without(held: DataFrame, met: DataFrame) -> DataFrame:
    """The blocks of the segments ``met`` (segment, gen, own lengths), without the documents
    whose places are ``gone``; the other documents keep theirs."""
    place = f"cast(p & {(1 << PLACE) - 1} as int)"
    both = held.join(met, ["segment", "gen"]).withColumns(
        {
            "postings": F.expr(f"filter(postings, p -> not array_contains(gone, {place}))"),
            "lens": F.expr("transform(lens, (l, i) -> if(array_contains(gone, i), null, l))"),
        }
    )
    some = F.expr(f"if(bucket = {LISTS}, exists(lens, l -> l is not null), size(postings) > 0)")
    told = {"n": "size(postings)", "most": f"cast(array_max(transform(postings, p -> shiftright(p, {PLACE}))) as int)",
            "shortest": f"array_min(transform(postings, p -> own[{place}]))"}
    figures = {c: F.when(F.col("bucket") == LISTS, F.col(c)).otherwise(F.expr(e)) for c, e in told.items()}
    return both.where(some).withColumns(figures).select("term", "segment", "n", "most", "shortest", "postings", "docs", "lens")


def _clear(spark: SparkSession, path: str) -> None:
    """Remove what a load that was cut off has left of the same generation."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _weight(tf, length, average: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


@dataclass
class Found:
    """``ranked``: (query_id, rank, doc_id, score).  ``blocks``: per query, how many blocks its
    terms have (``blocks``) and how many were read (``read``)."""

    ranked: DataFrame
    blocks: DataFrame


def search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    *,
    doc_id: str,
    query_id: str,
    text: str,
    k1: float = 1.2,
    b: float = 0.75,
    probed: int = PROBED,
) -> Found:
    """The ``k`` best documents of each query by BM25: the rows of :func:`retrieval.bm25`.

    Terms meet the blocks' figures (no postings are read for that), the bounds of a query are
    added up per segment, and the ``probed`` best segments are scored in full.  Their k-th
    score is a threshold that segments with a lower bound can't reach.  The others are read.
    A frequent word costs its block figures everywhere, and its postings only where the rest
    of the query makes the segment count.
    """
    index = open_index(spark, path)
    average = index.words / index.n if index.words else 1.0
    terms = queries.select(
        F.col(query_id).alias("_q"), F.explode(F.array_distinct(words(F.col(text)))).alias("term")
    )
    terms = terms.where("_q is not null")
    terms = materialise(terms.withColumn("bucket", _bucket(F.col("term"))), "search-terms")
    open_buckets = [r[0] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
    blocks = index.read("blocks").where(F.col("bucket").isin(open_buckets))
    asked = terms.select("term", "bucket").distinct()
    figures = materialise(
        blocks.select("bucket", "term", "segment", "n", "most", "shortest").join(asked, ["bucket", "term"]),
        "search-figures",
    )
    held = figures.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = materialise(terms.join(held.select("term", idf.alias("idf")), "term"), "search-weights")
    bound = F.col("idf") * _weight(F.col("most"), F.col("shortest"), average, k1, b)
    asked = weighted.join(figures.select("term", "segment", "most", "shortest"), "term")
    asked = asked.select("_q", "segment", bound.alias("bound"))
    by_segment = asked.groupBy("_q", "segment").agg(F.sum("bound").alias("bound"), F.count(F.lit(1)).alias("parts"))
    best = Window.partitionBy("_q").orderBy(F.desc("bound"), "segment")
    by_segment = materialise(by_segment, "search-bounds")
    first = by_segment.withColumn("r", F.row_number().over(best)).where(F.col("r") <= probed).drop("r")
    first = materialise(first, "search-first")

    # Queries by number: in groups of BITS, a bit each.
    numbers = materialise(weighted.select("_q").distinct().withColumn("x", F.monotonically_increasing_id()), "search-queries")
    numbers = numbers.select("_q", F.expr(f"x div {BITS}").alias("group"), F.expr(f"cast(x % {BITS} as int)").alias("bit"))
    asks = weighted.join(numbers, "_q").groupBy("term", "group")
    asks = materialise(asks.agg(F.collect_list(F.struct("_q", "idf", "bit")).alias("asks")), "search-asks")
    lists = index.read("blocks").where(F.col("bucket") == LISTS).select("segment", "docs", "lens")

    def score(chosen: DataFrame) -> DataFrame:
        """The scores of all documents of the chosen (_q, segment) that hold a term.

        Blocks are shuffled once for all queries, to their segment, and meet the queries
        there; scores are complete in the task, as long as no document occurs twice.
        """
        bits = chosen.select("_q", "segment").join(numbers, "_q").groupBy("segment", "group")
        bits = bits.agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).join(lists, "segment")
        read = blocks.select("term", "segment", "postings").join(asks.select("term").distinct(), "term", "left_semi")
        read = read.join(chosen.select("segment").distinct(), "segment", "left_semi")
        met = read.join(bits, "segment").join(asks, ["term", "group"])
        own = F.expr("explode(filter(asks, a -> (shiftright(bits, a.bit) & 1L) = 1L))").alias("a")
        each = met.select("segment", "docs", "lens", "postings", own)
        each = each.select("segment", "docs", "lens", "a", F.explode("postings").alias("p"))
        place = F.expr(f"cast(p & {(1 << PLACE) - 1} as int)")
        each = each.select(
            "segment", F.col("a._q").alias("_q"), F.col("a.idf").alias("idf"), F.get("docs", place).alias("_i"),
            F.get("lens", place).alias("len"), F.shiftright("p", PLACE).alias("tf"),
        )
        x = F.col("idf") * _weight(F.col("tf"), F.col("len"), average, k1, b)
        total = F.round(F.sum(x), BM25_DIGITS).alias("_c")
        if index.again:
            return each.groupBy("_q", "_i").agg(total)
        return each.groupBy("segment", "_q", "_i").agg(total).drop("segment")

    early = materialise(ranked(score(first), k), "search-early")
    last = early.where(F.col("rank") == k).select("_q", F.col("_c").alias("least"))
    later = by_segment.join(first, ["_q", "segment"], "left_anti").join(last, "_q", "left")
    later = later.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    later = materialise(later.select("_q", "segment", "parts"), "search-later")
    both = early.select("_q", "_i", "_c").unionByName(score(later))
    out = ranked(both, k).select(
        F.col("_q").alias(query_id), "rank", F.col("_i").alias(doc_id), F.round("_c", 6).alias("score")
    )
    read = first.select("_q", "parts").union(later.select("_q", "parts"))
    read = read.groupBy("_q").agg(F.sum("parts").alias("read"))
    all_blocks = by_segment.groupBy("_q").agg(F.sum("parts").alias("blocks"))
    return Found(out, all_blocks.join(read, "_q").withColumnRenamed("_q", query_id))


def documents(spark: SparkSession, path: str, ids: Sequence | None = None) -> DataFrame:
    """(doc, len) of what the index holds now, or of some ids."""
    held = open_index(spark, path).read("bags").select("doc", "len")
    return held if ids is None else held.where(F.col("doc").isin(list(ids)))
