"""NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from stratiform.llm import bpe, brown, minhash, mixing, neighbours, pii, sharding, toxicity, warc
from stratiform.llm import vector_duplicates as dup
from stratiform.session import scratch_path

# Columns named like those that operators use or add.
CLASH = {
    "size": 1, "target": 2, "copies": 3, "key": 4, "row": 5, "node": 6, "n": 7, "taken": 8,
    "severity": 9, "rejected": 10, "pii": 11, "ids": 12, "n_tokens": 13, "shard": 14, "bucket": 15,
    "__text": 30, "__pii": 31, "__copies": 32, "__range": 33, "_size": 34, "_start": 35, "_row": 36, "_group": 37,
    "group": 38, "start": 39, "own": 40, "doc": 41, "copy": 42, "crc32": 43,
    "kept": 16, "component_id": 17, "first": 18, "held_out": 19, "root": 20, "digest": 21,
}
LONG = "word other third " * 30_000
TEXTS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "b"),
    (2, "one two three four five six seven", "en", "b"),
    (3, "", "en", None),
    (4, None, None, None),
    (None, "a text without an id that nothing else holds at all", "de", "a"),
    (5, LONG, "en", "a"),
    (6, " \t\n ", "en", "c"),
    (7, "short", None, "c"),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or "")) for r in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return (text or "").encode().split()


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert sum(r["_rows"] for r in got) == len(TEXTS)
    by = {(r["doc_id"], r["source"], r["size"]): r for r in got}
    assert by[(2, "b", 7)]["_rows"] == 2 and by[(4, None, 0)]["copies"] == 0
    assert all(r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] for r in got)
    assert mixing.mix(none).count() == 0
    taken = mixing.take(docs, mixing.mix(docs))
    assert taken.columns == docs.columns and taken.where("n <> 7 or copies <> 3").count() == 0
    assert taken.count() == sum(r["copies"] * r["_rows"] for r in got)


def test_near_duplicates(docs, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append(r)
    assert {r["component_id"] for r in by[1] + by[2]} == {1}
    assert [r["n_shingles"] for r in by[3] + by[4] + by[6]] == [0, 0, 0]
    assert all(r["kept"] and r["first"] for r in by[3] + by[4] + by[6])
    assert by[5][0]["n_shingles"] == 3 and by[7][0]["n_shingles"] == 1
    assert all(r["kept"] for r in by[None])
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 4, None, 5, 6, 7, None], key=repr)


def test_shard(docs, none):
    got = sharding.shard(docs, 3).collect()
    assert len(got) == len(TEXTS)
    for text in {r["text"] for r in got}:
        assert len({r["_shard"] for r in got if r["text"] == text}) == 1
    for s in {r["_shard"] for r in got}:
        assert sorted(r["_slot"] for r in got if r["_shard"] == s) == list(
            range(sum(r["_shard"] == s for r in got))
        )
    for r in got:
        raw = None if r["text"] is None else r["text"].encode()
        assert r["_size"] == len(raw or b"") + 1
        assert r["_crc32"] == (None if raw is None else zlib.crc32(raw))
    assert sharding.shard(none, 3).count() == 0


def test_archive(spark, docs, none):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/\r\n%").alias("url"),
                        F.col("text").alias("html"), "size", "node", "digest")
    path = scratch_path(spark, "test-warc")
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got if r["page_id"]) == sorted(
        (i, (t or "").encode()) for i, t, *_ in TEXTS if i
    )
    assert {r["url"] for r in got} == {"http://a/\r\n%"}
    assert {r["record_type"] for r in got} == {"response"}  # repeats of the largest key, or small
    for r in got:
        assert bytes(r["record"]).startswith(bytes(r["header"]))
        assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    empty = scratch_path(spark, "test-warc")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_revisits(spark):
    """Of equal payloads of 1000 bytes or more the one with the largest key is the response."""
    big, other, small = "ü" * 500, "x" * 1500, "y" * 999
    rows = [(5, "a", big), (9, "b", big), (None, "c", big), (7, None, big), (3, "d", other),
            (4, "e", small), (8, "f", small), (1, "g", None), (2, "h", ""), (9, "b", big)]
    path = scratch_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archive(spark, path)
    told = [(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect()]
    assert sorted(told, key=repr) == sorted(
        [
            (5, "a", "revisit", 9, 1000), (7, None, "revisit", 9, 1000), (None, "c", "revisit", 9, 1000),
            (9, "b", "response", None, 1000), (9, "b", "response", None, 1000),
            (3, "d", "response", None, 1500), (4, "e", "response", None, 999),
            (8, "f", "response", None, 999), (1, "g", "response", None, 0), (2, "h", "response", None, 0),
        ],
        key=repr,
    )
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in got.collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert len(block) - 4 == length


def test_archive_notices_a_changed_payload(spark):
    path, other = scratch_path(spark, "test-warc"), scratch_path(spark, "test-warc")
    pages = spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string")
    warc.write_archive(pages, path)
    warc.write_archive(pages, other)
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"forged"))
    stored.write.parquet(f"{other}/forged")
    spark.read.parquet(f"{other}/forged").write.mode("overwrite").parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, other).collect()


def test_scores(docs, none):
    got = brown.score(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["held_out"] == (
            r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        )
    texts = {i: t for i, t, *_ in TEXTS if i}
    assert all(r["n_tokens"] == len(words(texts[r["doc_id"]])) + 1 for r in got if r["doc_id"])
    assert brown.score(none).count() == 0


def test_pseudonyms(docs, none):
    got = pii.pseudonymise(docs, "k", found_as="_found")
    assert got.columns == [*docs.columns, "_found"]
    assert got.where("text is null and _found is not null").count() == 0
    assert pii.pseudonymise(none, "k").count() == 0
    same = got.select("text", "pii").exceptAll(docs.select("text", "pii"))
    assert same.count() == 0


def test_tokens(docs, none):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    back = bpe.decode(got, ranks)
    for r in back.collect():
        assert r["decoded"].decode() == (r["text"] or "")
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame(
        [(1, 0, 1), (1, 0, 1), (5, 0, 0), (None, 0, 1), (99, 1, 1), (7, 0, None)],
        "doc_id long, quality int, toxic int",
    )
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    assert got.count() == len(TEXTS) and got.where("rejected is null").count() == 0
    assert toxicity.score(none, toxicity.fit(docs, labels)).count() == 0
    bare = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, bare).where("rejected or severity > 0.001").count() == 0
    assert toxicity.score(docs, toxicity.fit(none, labels)).where("rejected").count() == 0


VECTORS = [
    (50, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]),
    (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]),
    (7, [None, 1.0, 0.0]), (8, []), (None, [0.0, 0.9, 0.1]), (100, [float("inf"), 0.0, 0.0]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def test_near_vectors(vectors):
    got = dup.near_vectors(vectors).collect()
    assert len(got) == len(VECTORS)
    told = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr)
    alone = [(i, 0, i) for i in (4, 5, 6, 7, 8, 100)]
    want = [(1, 2, 1), (2, 2, 1), (50, 2, 1), (3, 2, 3), (3, 2, 3), (None, 2, 3), *alone]
    assert told == sorted(want, key=repr)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert dup.near_vectors(vectors.limit(0)).count() == 0
    assert dup.near_vectors(vectors.where("vec_id = 5")).collect()[0]["n_links"] == 0


def test_neighbours(vectors):
    got = neighbours.nearest(vectors).orderBy("query_id", "rank").collect()
    # Fewer than five candidates: all of them; equal cosines by the smaller key, NULL last.
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [
        (50, 1, 1), (50, 2, 2), (50, 3, 3), (50, 4, 3), (50, 5, None),
    ]
    assert got[0]["score"] == 1.0 and got[2]["score"] == 0.0
    assert neighbours.nearest(vectors.limit(0)).count() == 0
    assert neighbours.nearest(vectors.where("vec_id < 50")).count() == 0


def test_ties_go_to_the_smaller_key(spark):
    """More scaled copies of one vector than are asked for; a power of two changes no cosine."""
    rows = [(i, [2.0 ** (i % 37 - 18), 0.0, 2.0 ** (i % 37 - 18)]) for i in range(1, 41)]
    rows += [(50, [1.0, 0.0, 1.0]), (60, [1.0, 0.5, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(5))
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_stages(spark, docs, none):
    folder = scratch_path(spark, "test-pipeline")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    for df in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, folder)
            assert df.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, folder).count() == df.count()
