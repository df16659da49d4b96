"""Class-based scores: every training word takes its exchange step, whatever its rank."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratiform.llm import brown

SIZES = brown.Sizes(classes=2, core=4, middle=6, head=12)


def mirrored():
    """Texts of two languages that differ in the words' first letter only."""
    rng = random.Random(3)
    weights = [1 / (2 + i) for i in range(12)]
    texts = []
    for i in range(120):
        words = [f"{w}" for w in rng.choices(range(12), weights, k=24)]
        for at in (5, 11, 17):  # words of two occurrences, some of them side by side
            words[at : at + 1] = [f"rare{i // 2}", f"rare{(i // 2 + 1) % 60}"]
        texts.append(words)
    return [" ".join(f"{lang}{w}" for w in t) for lang in "ab" for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    texts = mirrored()
    asked = [f"{x}rare{i} {y}0 {y}1 {y}2" for i in range(20) for x in "ab" for y in "ab"]
    asked += [f"{x}{i} {y}0 {y}1 {y}2" for i in range(8, 12) for x in "ab" for y in "ab"]
    asked += [f"{y}0 {x}rare{i}" for i in range(20) for x in "ab" for y in "ab"]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(asked)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_outside_the_head_have_the_class_of_their_neighbours(docs):
    """Beyond ``core``, ``middle`` and ``head``, seldom or not, a word goes with its language."""
    got = brown.score(docs, held_out=F.col("doc_id") >= 1000, sizes=SIZES)
    score = {r["text"]: r["score"] for r in got.join(docs, "doc_id").where("held_out").collect()}
    assert len(score) > 150
    for text, s in score.items():
        first, *rest = text.split()
        other = {"a": "b", "b": "a"}
        crossed = " ".join([first, *(other[w[0]] + w[1:] for w in rest)])
        if first[0] == rest[0][0]:
            assert s > score[crossed] + 0.5, text


def test_probabilities_of_words_outside_the_head_add_up(docs):
    texts = docs.where("doc_id < 1000").select("text")
    m = brown.fit(texts, brown.word_counts(texts, "text").cache(), "text", SIZES)
    assert m.lexicon.size == 12 and m.rest_words == 2 * 60 + 12
    assert (m.of[:12] < 2).all()
    assert (10**m.transition).sum(axis=1) == pytest.approx(1)
    assert (10**m.rest).sum(axis=1) == pytest.approx(1)
    freed = brown.DISCOUNT * m.rest_words
    assert (10**m.rest_class).sum() == pytest.approx(m.rest_tokens - freed)


def classes_of(of):
    return np.eye(of.max() + 1)[of]


def test_exchange_steps_are_the_likeliest():
    rng = np.random.default_rng(4)
    for _ in range(3):
        pairs = rng.poisson(1.2, (22, 22)).astype(float)  # words, one not placed, the end
        of = np.append(rng.integers(0, 5, 20), [4, 5])
        one = classes_of(of)
        got = brown.best_classes(
            one.T @ pairs @ one, of[:20], (pairs @ one)[:20], (pairs.T @ one)[:20], np.diag(pairs)[:20]
        )
        for w in range(20):
            each = []
            for c in range(4):
                moved = classes_of(np.where(np.arange(22) == w, c, of))
                each.append(brown.likelihood(moved.T @ pairs @ moved))
            assert each[got[w]] == pytest.approx(max(each), abs=1e-6)


def test_exchange_goes_on_until_no_word_moves():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(0.4, (201, 201)).astype(float)
    of = np.append(brown.exchange(pairs, 6), 6)
    one = classes_of(of)
    whole = brown.likelihood(one.T @ pairs @ one)
    for w in range(0, 200):
        for c in range(6):
            moved = classes_of(np.where(np.arange(201) == w, c, of))
            assert brown.likelihood(moved.T @ pairs @ moved) <= whole + 1e-5
