"""The stored index against the exact ranking, and what it leaves unread."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from stratiform.operators import retrieval as r
from stratiform.operators import text_index as ix
from stratiform.session import materialise

NAMES = {"doc_id": "doc_id", "text": "text"}
RARE = [f"rare{i}" for i in range(400)]


def some_text(rng):
    n = rng.choice([0, 1, 5, 20, 60, 200])
    return " ".join(rng.choice(["the", "of", "The", "and", rng.choice(RARE), f"w{rng.randrange(40)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, some_text(rng)) for i in range(3000)] + [(3000, None), (3001, "twin the twin"), (3002, "twin the twin")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("len", F.lit(1))


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "the"), (2, "the rare7"), (3, "rare1 rare2 w3 of"), (4, "nowhere"), (5, None), (6, "Twin twin"), (7, "the of and")]
    return spark.createDataFrame(rows, "q long, text string")


@pytest.fixture(scope="module")
def path(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    ix.create_index(docs, path, **NAMES)
    return path


def exact(docs, queries, k, rows):
    return rows(r.bm25(docs, queries, k, doc_id="doc_id", query_id="q", text="text"))


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_ranks_as_the_exact_scan(spark, rows, docs, queries, path, k):
    got = ix.search(spark, path, queries, k, doc_id="doc_id", query_id="q", text="text")
    want = exact(docs, queries, k, rows)
    assert rows(got.ranked) == want and len(want) > 3


def test_blocks_stay_unread(spark, queries, path):
    got = ix.search(spark, path, queries, 3, doc_id="doc_id", query_id="q", text="text")
    by = {x["q"]: x for x in got.blocks.collect()}
    assert by[2]["read"] < by[2]["blocks"] / 2  # a stop word beside a rare one
    assert by[1]["read"] < by[1]["blocks"]
    assert all(x["read"] <= x["blocks"] for x in by.values())
    assert 4 not in by and 5 not in by  # no block at all


def test_figures_are_read_without_postings(spark, queries, path):
    plan = ix.open_index(spark, path).read("blocks").where("bucket in (1, 2)").select("term", "segment", "n", "most")
    text = plan._jdf.queryExecution().toString()
    assert "postings" not in text.split("ReadSchema")[1].split("\n")[0] and "PartitionFilters: [bucket" in text


def test_words_are_counted_in_the_row(spark):
    rows = [(1, "b a B c b"), (2, ""), (3, None), (4, "x " * 10_000 + "y"), (5, "x")]
    got = ix.bags(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    told = {x["doc"]: (x["len"], [tuple(p) for p in x["terms"]]) for x in got}
    assert told == {1: (5, [("a", 1), ("b", 3), ("c", 1)]), 2: (0, []), 3: (0, []),
                    4: (10_001, [("x", 10_000), ("y", 1)]), 5: (1, [("x", 1)])}


def test_upserts_equal_a_new_index(spark, rows, docs, queries, tmp_path):
    path = str(tmp_path / "i")
    ix.create_index(docs, path, **NAMES)
    rng = random.Random(8)
    new = [(i, some_text(rng)) for i in [*range(0, 300, 7), *range(4000, 4050)]] + [(None, "the null"), (None, "of")]
    new += [(3000, "rare1 again"), (1, None)]
    fresh = spark.createDataFrame(new, "doc_id long, text string")
    before = ix.open_index(spark, path)
    ix.upsert_documents(fresh, path, **NAMES)
    want = docs.select("doc_id", "text").join(fresh, "doc_id", "left_anti").union(fresh)
    got = ix.search(spark, path, queries, 12, doc_id="doc_id", query_id="q", text="text")
    assert rows(got.ranked) == exact(want, queries, 12, rows)
    assert ix.documents(spark, path).count() == want.count() == ix.open_index(spark, path).n
    assert before.read("bags").count() == docs.count()  # readers of the old state keep it
    one = spark.createDataFrame([(5, "rare2"), (5, "rare3")], "doc_id long, text string")
    with pytest.raises(ValueError, match="more than once"):
        ix.upsert_documents(one, path, **NAMES)


def test_a_load_that_was_cut_off_is_not_seen(spark, rows, docs, queries, tmp_path):
    path = str(tmp_path / "i")
    ix.create_index(docs, path, **NAMES)
    docs.limit(5).write.parquet(f"{path}/gen=1/bags")  # the load ended before its statistics
    assert ix.open_index(spark, path).gen == 0
    ix.upsert_documents(docs.select("doc_id", "text").where("doc_id < 50"), path, **NAMES)
    got = ix.search(spark, path, queries, 5, doc_id="doc_id", query_id="q", text="text")
    assert rows(got.ranked) == exact(docs, queries, 5, rows)


def test_empty_index(spark, docs, queries, tmp_path):
    path = str(tmp_path / "i")
    ix.create_index(docs.limit(0), path, **NAMES)
    got = ix.search(spark, path, queries, 5, doc_id="doc_id", query_id="q", text="text")
    assert got.ranked.count() == 0
    ix.upsert_documents(docs.select("doc_id", "text").limit(3), path, **NAMES)
    assert ix.open_index(spark, path).n == 3


@pytest.fixture
def written(monkeypatch):
    """What is written on the way, by purpose."""
    seen = {}
    monkeypatch.setattr(ix, "materialise", lambda df, purpose: seen.update({purpose: df}) or materialise(df, purpose))
    return seen


def test_postings_are_stored_and_shuffled_once(spark, queries, path, written):
    assert os.listdir(f"{path}/gen=0") == ["blocks"]  # no second copy of the words by document
    ix.search(spark, path, queries, 3, doc_id="doc_id", query_id="q", text="text")
    plan = written["search-early"]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and not re.search(r"hashpartitioning\(_q#\w+, [a-z_]", plan)


def test_documents_that_occur_twice(spark, rows, queries, tmp_path):
    path = str(tmp_path / "i")
    rng = random.Random(5)
    some = [(i, some_text(rng)) for i in range(30)] + [(None, "the null")]
    docs = spark.createDataFrame(some * 2, "doc_id long, text string").coalesce(1)
    ix.create_index(docs, path, **NAMES)
    got = ix.search(spark, path, queries, 8, doc_id="doc_id", query_id="q", text="text")
    assert ix.open_index(spark, path).again and rows(got.ranked) == exact(docs, queries, 8, rows)


def test_segments_that_go_on_in_the_next_batch(spark, rows, docs, queries, tmp_path):
    path = str(tmp_path / "i")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        ix.create_index(docs, path, segment=64, **NAMES)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = ix.open_index(spark, path).read("bags").groupBy("segment").agg(F.count("doc").alias("n"), F.max("place").alias("p"))
    assert sizes.where("n > 64 or p <> n - 1").isEmpty() and sizes.where("n = 64").count() > 20
    got = ix.search(spark, path, queries, 5, doc_id="doc_id", query_id="q", text="text")
    assert rows(got.ranked) == exact(docs, queries, 5, rows)


def test_upserts_write_blocks_only(spark, rows, docs, queries, tmp_path, written):
    path, now = str(tmp_path / "i"), docs.select("doc_id", "text")
    ix.create_index(now.where("doc_id % 5 <> 0"), path, **NAMES)
    rng = random.Random(4)
    for load in (1, 2):
        fresh = [(i, some_text(rng)) for i in range(load, 3000, 40)] + [(i, "w1 the") for i in range(0, 3000, 50)]
        fresh = spark.createDataFrame(fresh, "doc_id long, text string")
        before = now.where("doc_id % 5 <> 0") if load == 1 else now
        now = before.join(fresh, "doc_id", "left_anti").union(fresh)
        ix.upsert_documents(fresh, path, **NAMES)
        assert os.listdir(f"{path}/gen={load}") == ["blocks"]
    assert not any("terms" in df.columns or "text" in df.columns for df in written.values())
    index = ix.open_index(spark, path)
    blocks = index.read("blocks").where("bucket >= 0")
    assert index.gen == 2 and blocks.where("n <> size(postings) or n = 0").isEmpty()
    # The figures of blocks that lost documents are those of the ones left.
    each = blocks.select("segment", "term", "most", "shortest", F.explode("postings").alias("p"))
    each = each.select("*", F.expr(f"cast(p & {(1 << ix.PLACE) - 1} as int)").alias("place"), F.shiftright("p", ix.PLACE).alias("tf"))
    figures = each.join(index.read("bags"), ["segment", "place"]).groupBy("segment", "term", "most", "shortest")
    figures = figures.agg(F.max("tf").alias("a"), F.min("len").alias("b"))
    assert figures.count() == blocks.count() and figures.where("a <> most or b <> shortest").isEmpty()
    got = ix.search(spark, path, queries, 12, doc_id="doc_id", query_id="q", text="text")
    assert rows(got.ranked) == exact(now, queries, 12, rows)
