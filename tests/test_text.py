import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.functions.hashing import chunk_uid
from stratiform.operators import retrieval as r
from stratiform.operators import text as tx


def expected_chunks(text, limit):
    """Lines gathered up to ``limit``; a fifth of them is carried over."""
    out, held = [], []
    lines = text.strip().splitlines()
    for line in lines:
        held.append(line)
        if sum(len(x) + 1 for x in held) >= limit:
            out.append("\n".join(held).strip())
            carried = len(held) // 5
            held = held[len(held) - carried :] if carried else []
    if held:
        out.append("\n".join(held).strip())
    return [c for c in out if c]


def test_chunks_against_a_plain_fold(spark):
    rng = random.Random(11)
    breaks = ["\n", "\r\n", "\r", "\x0b", " ", "\n\n", "\n  \n"]
    texts = ["", "  \n ", "one line", " padded　"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts += ["wörd " * rng.randrange(0, 12), rng.choice(breaks)]
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for limit in (40, 200, 800):
        got = dict(df.select("i", tx.chunks_of(F.col("text"), limit)).collect())
        for i, text in enumerate(texts):
            assert got[i] == expected_chunks(text, limit), (i, limit)


def test_chunk_ids(spark):
    import hashlib

    df = spark.createDataFrame([("f.md", 3, "ä" * 80)], "s string, n int, t string")
    got = df.select(chunk_uid(F.col("s"), F.col("n"), F.col("t"))).first()[0]
    assert got == hashlib.md5(("f.md:3:" + "ä" * 50).encode()).hexdigest()


def test_requirements_rows_first_then_lines(spark, rows):
    df = spark.createDataFrame(
        [
            (1, "| REQ-01 must | load it |\n| REQ-02 | check it |"),
            (2, "see REQ-07: keep this\nand REQ-8 that too"),
            (3, "nothing"),
        ],
        "id int, body string",
    )
    got = tx.extract_requirements(df, ["id"], "body")
    assert rows(got) == [
        (1, 0, "REQ-01", "load it"), (1, 1, "REQ-02", "check it"),
        (2, 0, "REQ-07", "keep this"), (2, 1, "REQ-8", "that too"),
    ]


def test_mentions_show_the_first_lines(spark, rows):
    df = spark.createDataFrame([(1, "\n".join(f"rate {i}" for i in range(9)) + "\nother")], "id int, t string")
    got = tx.find_mentions(df, ["id"], "t", ["rate", "none"])
    assert rows(got) == [(1, "rate", "\n".join(f"rate {i}" for i in range(5)))]


@pytest.mark.parametrize("block, shard", [(512, 16384), (5, 50)])
def test_vector_topk_against_numpy(spark, monkeypatch, block, shard):
    monkeypatch.setattr(r, "QUERY_BLOCK", block)
    monkeypatch.setattr(r, "ITEM_SHARD", shard)
    rng = np.random.default_rng(4)
    items = rng.normal(size=(300, 8))
    items[10] = items[20] = items[30]  # equal vectors tie; the smaller id wins
    queries = rng.normal(size=(12, 8))
    frame = lambda m, n: spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(m)], f"{n} int, v array<double>"
    )
    got = r.vector_topk(
        frame(queries, "q"), frame(items, "i"), 5, query_id="q", item_id="i", vector="v"
    )
    found = {(x.q, x["rank"]): (x.i, x.score) for x in got.collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(unit(queries) @ unit(items).T, 9)
    for q in range(12):
        order = sorted(range(300), key=lambda i: (-cos[q, i], i))[:5]
        for n, i in enumerate(order, start=1):
            assert found[q, n][0] == i
            assert found[q, n][1] == pytest.approx(max(0, cos[q, i]), abs=6e-4)


def test_vector_topk_with_fewer_items_or_no_queries(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "i int, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "q int, v array<double>")
    ask = lambda df: r.vector_topk(df, items, 5, query_id="q", item_id="i", vector="v").collect()
    assert [(x.i, x.score) for x in sorted(ask(q), key=lambda x: x["rank"])] == [(1, 1.0), (3, 0.0)]
    assert ask(q.limit(0)) == []
    both = q.union(spark.createDataFrame([(8, None)], "q int, v array<double>"))
    assert {x.q for x in ask(both)} == {7}


def test_bm25_against_its_formula(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "été", "x1"]
    docs = [(i, " ".join(["every"] + rng.choices(words, k=rng.randrange(1, 40)))) for i in range(80)]
    docs += [(99, ""), (98, None)]
    d = spark.createDataFrame(docs, "d int, t string")
    asked = {1: {"alpha", "été"}, 2: {"gamma"}, 3: {"missing"}, 4: {"every"}}
    q = spark.createDataFrame(
        [(1, "alpha Été"), (2, "gamma, gamma"), (3, "missing"), (4, "every"), (5, None)], "q int, t string"
    )
    bags = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    held = {w: sum(w in b for b in bags.values()) for w in [*words, "every", "missing"]}
    want = set()
    for n, terms in asked.items():
        scores = []
        for i, bag in bags.items():
            s = sum(
                math.log((len(bags) - held[w] + 0.5) / (held[w] + 0.5) + 1)
                * bag.count(w) * 2.2 / (bag.count(w) + 1.2 * (0.25 + 0.75 * len(bag) / mean))
                for w in terms if w in bag
            )
            if any(w in bag for w in terms):
                scores.append((-round(s, 12), i))
        want |= {(n, r + 1, i) for r, (_, i) in enumerate(sorted(scores)[:7])}
    got = r.bm25(d, q, 7, doc_id="d", query_id="q", text="t")
    assert {(x.q, x["rank"], x.d) for x in got.collect()} == want and len(want) == 21


def test_surface_or_create(spark, rows):
    need = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    hits = spark.createDataFrame([("a", 1, 0.7), ("a", 2, 0.6), ("b", 1, 0.69)], "k string, rank int, score double")
    assert rows(r.surface_or_create(need, hits, "k"), "k", "action") == [
        ("a", "surface"), ("b", "create"), ("c", "create"),
    ]


def test_rrf(spark, rows):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "q int, rank int, d string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "z")], "q int, rank int, d string")
    got = r.rrf([a, b], "q", "d", 2)
    assert rows(got, "rank", "d", "score") == [
        (1, "y", round(1 / 61 + 1 / 62, 9)), (2, "x", round(1 / 61, 9)),
    ]
