"""Graded toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bound_batches, free_name, with_fields

LETTERS = re.compile(r"[^\W\d_]+")
#: Stems of inflected words: the first letters of a word, beside the word itself.
STEMS = (4, 5, 6, 7, 8, 9)


def words_of(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


def features_of(word: str) -> Iterator[str]:
    """The word itself, marked, and its stems."""
    yield f"{word}$"
    for n in STEMS:
        if len(word) >= n:
            yield word[:n]


@dataclass(frozen=True)
class Model:
    """P(grade <= k) = logistic(cuts[k] - weights . x): one set of weights for all cuts."""

    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def row(self, text: str | None) -> tuple[list[int], list[int], int]:
        """Features found, how often, and the number of words that have any."""
        heads = self.heads
        found: Counter = Counter()
        telling = 0
        for word, n in words_of(text).items():
            if word[: STEMS[0]] in heads:
                own = [self.index[f] for f in features_of(word) if f in self.index]
                for i in own:
                    found[i] += n
                telling += n if own else 0
        return list(found), list(found.values()), telling

    @property
    def heads(self) -> frozenset[str]:
        if "_heads" not in self.__dict__:
            heads = frozenset(f.rstrip("$")[: STEMS[0]] for f in self.index)
            object.__setattr__(self, "_heads", heads)
        return self.__dict__["_heads"]

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score, one row each."""
        below = logistic(self.cuts[None, :] - score[:, None])
        edge = np.ones((len(score), 1))
        return np.diff(np.hstack([0 * edge, below, edge]), axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_features: int,
    *, penalty: float = 1e-4, steps: int = 400, rate: float = 0.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood of a proportional-odds model by Adam, full batches.

    Cuts are ordered by construction: the first is free and each next one adds a positive
    gap.
    """
    k = int(grades.max()) + 1
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    x = np.concatenate(values) if values else np.empty(0)
    weight = 1 / len(grades)
    params = np.zeros(n_features + k - 1)
    params[n_features + 1 :] = 0.5
    params[n_features] = -0.5
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, free = params[:n_features], params[n_features:]
        gaps = np.exp(free[1:])
        cuts = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(owner, w[column] * x, len(rows))
        high = np.where(grades < k - 1, logistic(cuts[np.minimum(grades, k - 2)] - score), 1.0)
        low = np.where(grades > 0, logistic(cuts[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high), low * (1 - low)
        d_score = weight * (high + low - 1)  # of the log-likelihood
        g_w = np.bincount(column, d_score[owner] * x, n_features)
        g_cut = np.zeros(k - 1)
        np.add.at(g_cut, grades[grades < k - 1], (weight * d_high / p)[grades < k - 1])
        np.subtract.at(g_cut, grades[grades > 0] - 1, (weight * d_low / p)[grades > 0])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([g_w - penalty * w, [tail[0]], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        step = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        params = params + rate * step
    free = params[n_features:]
    return params[:n_features], free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows_per_label: int = 6000,
    features: int = 16384,
) -> Model:
    """Fit on at most ``rows_per_label`` labelled documents of either label.

    The sample holds the labelled keys with the least hashes, so reruns agree; it is the
    bound of all that reaches the driver.  Features are words and stems that tell toxic from
    other documents, at most ``features`` of them, by the likelihood ratio over the sample.  The label has two values, so the
    upper grades are derived: a toxic document with as many telling words as the median of
    the toxic ones is severe (2), with fewer it is mild (1); others are clean (0).

    Defined results: repeated labels of a key count once, as the larger; NULL labels and
    keys and labels without a document are left out; without rows of both labels the model
    has no features and grades everything 0.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    turn = [F.xxhash64("_key"), F.col("_key")]
    chosen = [known.where(F.col("_label") == v).orderBy(*turn).limit(rows_per_label) for v in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * rows_per_label rows
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    held = materialise(texts.join(sample, "_key").select("_key", "_label", "_text"), "toxicity")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen[y].update({f for w in words_of(t) for f in features_of(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in seen)],
                names=["feature", "n0", "n1"],
            )

    sizes = {r["_label"]: r["n"] for r in held.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, np.empty(0), np.array([40.0, 41.0]))
    counted = held.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature")
    counted = counted.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    r0, r1 = ((F.col(f"n{v}") + 0.5) / (sizes[v] + 1) for v in (0, 1))
    pooled = (F.col("n0") + F.col("n1") + 1) / (sizes[0] + sizes[1] + 2)
    gain = F.col("n1") * F.log(r1 / pooled) + F.col("n0") * F.log(r0 / pooled)
    counted = materialise(counted, "toxicity")
    # With so many features some look telling by chance: ask for what chance can't give.
    least = math.log(max(1, counted.count())) + 2
    best = counted.where(r1 > r0).select("feature", gain.alias("gain")).where(F.col("gain") > least)
    top = best.orderBy(F.desc("gain"), "feature").limit(features).collect()
    index = {r["feature"]: i for i, r in enumerate(top)}
    bare = Model(index, np.zeros(len(index)), np.zeros(2))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, counts, words = [], [], []
            for t in b.column(2).to_pylist():
                i, n, telling = bare.row(t)
                found.append(i), counts.append(n), words.append(telling)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int32())), pa.array(words, pa.int64())],
                names=["key", "label", "found", "counts", "words"],
            )

    kind = held.schema["_key"].dataType.simpleString()
    shape = f"key {kind}, label int, found array<int>, counts array<int>, words long"
    rows = sorted(held.mapInArrow(describe, shape).collect())
    label_of = np.array([r["label"] for r in rows])
    telling = np.array([r["words"] for r in rows])
    grades = np.where(label_of == 1, 1 + (telling >= np.median(telling[label_of == 1])), 0)
    if len(set(grades.tolist())) < 3:  # no spread among the toxic ones
        grades = np.where(label_of == 1, 2, 0)
    found = [np.array(r["found"], np.int64) for r in rows]
    values = [presence(np.array(r["counts"], np.float64)) for r in rows]
    weights, cuts = fit_ordinal(found, values, grades, len(index))
    return Model(index, weights, cuts)


def presence(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def score(
    docs: DataFrame,
    model: Model,
    *,
    text: str = "text",
    reject: float = 0.5,
    names: tuple[str, str, str] = ("severity", "p_toxic", "rejected"),
) -> DataFrame:
    """Add ``severity`` (the expected grade), ``p_toxic`` (of any grade above 0) and
    ``rejected`` (``p_toxic`` of at least ``reject``) to whole texts, under those ``names``.

    A map without shuffle; the model (bounded by its number of features) goes along.
    Defined results: NULL and empty texts have no features; rows that repeat, ties and other
    columns are untouched, but for columns of ``docs`` that clash with the added ones, which
    are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    added = dict(zip(names, ("double", "double", "boolean")))
    keep = [c for c in docs.columns if c not in added]
    source = docs.select(*keep, F.col(text).alias(free_name(keep, "__text")))
    schema = with_fields(T.StructType(source.schema.fields[:-1]), **added)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            total = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                found, counts, _ = m.row(t)
                if found:
                    total[i] = m.weights[found] @ presence(np.array(counts, np.float64))
            grades = m.grades(total)
            severity = grades @ np.arange(grades.shape[1])
            toxic = 1 - grades[:, 0]
            arrays = [*b.columns[:-1], pa.array(severity), pa.array(toxic), pa.array(toxic >= reject)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)
