"""Aligned tokens and corpus-wide pair counts against a plain version, token by token."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import public_tokenizers
import sentencepiece
from stratiform.llm.alignment import Tokenizers, Words, align, align_documents, aligned
from tokenizers import Tokenizer, pre_tokenizers

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
FOLDER = "/root/testdata/sf0.001"
NASTY = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \n\nb", "\t\t x", "x  y", "<|endoftext|> hi",
    "<s> hi </s> <unk>", "▁x", "x▁ y", "ﬁ Å ①", "日本語のテキスト", "😀😀 👍🏽 ok", "é é", "\x00\x01", "\x1f a\x1f b",
    "==========" * 50, "don't won't I'll", "naïve café", "a" * 3000, "😀" * 300, "1234567890 12 3.14", "a​ b",
    "mixed　 wide", "ß" * 50 + " end", "﻿bom", "x" + " " * 40 + "y",
]


def plain(rows):
    """(doc_id, text) rows to the result rows, by way of every token and every link."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    alphabet = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    # A printable byte stands for itself; the other characters follow in the order of bytes.
    shown = {c: ord(c) for c in alphabet if ord(c) < 256}
    hidden = sorted(c for c in alphabet if ord(c) >= 256)
    shown |= dict(zip(hidden, sorted(set(range(256)) - set(shown.values()))))
    docs = []
    for key, text in rows:
        ids, spans = [], []
        if text:
            a = ta.encode(" " + text, add_special_tokens=False).ids
            b = tb.encode(text)
            raw_a = [bytes(shown[c] for c in ta.id_to_token(i)) for i in a]
            raw_b = []
            for i in b:
                p = tb.id_to_piece(i)
                raw_b.append(bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode())
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ids, spans = [a, b], [raw_a, raw_b]
        found, lines, counts = collections.Counter(), [], (0, 0)
        if ids:
            ends = []
            for raw in spans:
                at, own = 0, []
                for r in raw:
                    at += len(r)
                    own.append(at)
                ends.append(own)
            counts = (len(ids[0]), len(ids[1]))
            i = j = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
                left, right = ids[0][i:x], ids[1][j:y]
                lines.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                found.update((p, q) for p in left for q in right)
                i, j = x, y
        docs.append((key, counts, found, lines))
    corpus = collections.Counter(p for d in docs for p in d[2])
    top = collections.Counter()
    for (a, _), n in corpus.items():
        top[a] = max(top[a], n)
    return sorted(
        (
            (
                key, *counts, len(lines), sum(found.values()),
                hashlib.sha256(";".join(lines).encode()).hexdigest() if lines else "",
                sum(n for p, n in found.items() if corpus[p] == top[p[0]]),
                sum(n * corpus[p] for p, n in found.items()),
            )
            for key, counts, found, lines in docs
        ),
        key=repr,
    )


def told(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(rows)
    assert told(aligned(docs.repartition(6), A, B, keep=["doc_id"])) == want
    assert sum(r[4] for r in want) > 10_000


def test_hard_texts(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(None, "a"), (0, "a b"), (0, "a b"), (90, "word " * 30_000)]
    clash = {c: F.lit(3) for c in ("kept", "chunk", "place", "pair", "docs", "best", "a", "n_a", "kind")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)
    got = aligned(docs, A, B)
    assert told(got) == plain(rows)
    assert got.where("chunk = 3 and a = 3 and kept = 3 and kind = 3").count() == len(rows)
    assert aligned(docs.limit(0), A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert told(aligned(nothing, A, B)) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


@pytest.fixture(scope="module")
def words():
    with open(A, "rb") as a, open(B, "rb") as b:
        return Words(Tokenizers(a.read(), b.read()))


def test_words_and_whole_texts_align_alike(spark, words):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    texts += [t for t in NASTY if t]
    numbers, links = align_documents(texts, words)
    whole = align(texts, words.tok)
    for c in ("n_a", "n_b", "n_groups"):
        assert numbers[c].tolist() == getattr(whole, c).tolist()
    assert links.column("pair").to_pylist() == whole.pair.tolist()
    assert links.column("links").to_pylist() == whole.links.tolist()


def test_links_of_a_group_are_counted_not_listed(words):
    got = align(["=" * 5001 + "😀" * 999], words.tok)
    assert len(got.pair) < 100 < got.links.sum()
