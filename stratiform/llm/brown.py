"""Class-based n-gram scores: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, joined, partitions

#: Words held at once by a task; bounds memory only.
CHUNK = 400_000
#: Distinct words a task adds up before it hands them on; bounds memory only.
DISTINCT = 1_500_000
#: What absolute discounting takes from every word outside the head, for words never seen.
DISCOUNT = 0.75


@dataclass(frozen=True)
class Sizes:
    """Every training word gets one of ``classes`` classes by exchange; the rest says how.

    The ``core`` most frequent words are clustered by full exchange, those up to ``middle``
    join them next, then the whole head: the ``head`` most frequent words that occur ``least``
    times or more, whose classes travel to the tasks.  The head moves in rounds until one
    raises the likelihood by less than ``settled`` of it.  The words outside the head, however
    many, then take their exchange step against those classes, and their classes are joined."""

    classes: int = 32
    core: int = 1024
    middle: int = 16384
    head: int = 1 << 17
    least: int = 3
    settled: float = 0.002


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()  # the six ASCII blanks only
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def chunks(texts: list) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for t in texts:
        held.append(word_hashes(t))
        n += len(held[-1])
        if n > CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): occurrences of each word hash; every task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"]
            )

        for b in batches:
            for held in chunks(b.column(0).to_pylist()):
                new, n = np.unique(np.concatenate(held), return_counts=True)
                both = np.concatenate([words, new])
                words, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(words)).astype(np.int64)
                if len(words) > DISTINCT:
                    yield out()
                    words, counts = words[:0], counts[:0]
        yield out()

    found = texts.select(F.col(text)).mapInArrow(run, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Token ids: the head by rank, then one id for all other words, then the end."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.order = np.argsort(words.view(np.uint64))
        self.sorted = words.view(np.uint64)[self.order]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(hashes), self.size, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.size - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], self.size)


def lexicon_of(vocabulary: DataFrame, sizes: Sizes) -> tuple[Lexicon, np.ndarray]:
    top = vocabulary.where(F.col("n") >= sizes.least)
    top = top.orderBy(F.desc("n"), "word").limit(sizes.head).collect()
    words = np.array([r["word"] for r in top], np.int64)
    return Lexicon(words), np.array([r["n"] for r in top], np.int64)


def coded(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(row, key, held_out, ids, rare) of (key, held_out, text), written: the token ids of each
    text without its end, and the hashes of its words outside the head, in order."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            at = 0
            for held in chunks(b.column(2).to_pylist()):
                flat = np.concatenate(held)
                ids = lex.ids(flat).astype(np.int32)
                ends = np.cumsum([0] + [len(h) for h in held])
                outside = ids == lex.size
                rare_ends = np.append(0, np.cumsum(outside))[ends]
                part = b.slice(at, len(held))
                at += len(held)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), ragged(ids, ends),
                     ragged(flat[outside].view(np.int64), rare_ends)],
                    names=["key", "held_out", "ids", "rare"],
                )

    kind = texts.schema["key"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"key {kind}, held_out boolean, ids array<int>, rare array<long>")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "brown-rows")


def ragged(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def line(ids: pa.ListArray, size: int) -> np.ndarray:
    """The texts in one row of token ids, an end before the first and after each."""
    ends = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
    return np.insert(ids.flatten().to_numpy().astype(np.int64), ends, size + 1)


def pair_counts(
    rows: DataFrame, row: np.ndarray, col: np.ndarray, width: int, *, back: bool = False
) -> DataFrame:
    """(row, counts): how often a token of each row is followed by one of each column.

    ``row`` and ``col`` map token ids; a row of -1 is not counted.  With ``back`` a second
    stretch of ``width`` counts says what comes before it, and one more count how often the
    token follows itself.  A task adds up its own matrix and sends one line per row, so what is
    shuffled does not grow with the pairs.
    """
    spark = rows.sparkSession
    high = int(row.max(initial=-1)) + 1
    wide = width * 2 + 1 if back else width
    size = len(row) - 2
    shared = spark.sparkContext.broadcast((row, col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, c = shared.value
        total = np.zeros(high * wide, np.int32)  # a task meets fewer than 2^31 tokens
        for b in batches:
            if not b.num_rows:
                continue
            tokens = line(b.column(0), size)
            a, z = tokens[:-1], tokens[1:]
            from_, to = r[a], r[z]
            keep = from_ >= 0
            np.add.at(total, from_[keep] * wide + c[z[keep]], np.int32(1))
            if back:
                same = keep & (a == z)
                np.add.at(total, from_[same] * wide + 2 * width, np.int32(1))
                keep = to >= 0
                np.add.at(total, to[keep] * wide + width + c[a[keep]], np.int32(1))
        table = total.reshape(high, wide)
        used = np.flatnonzero(table.any(axis=1))
        for s in range(0, len(used), 1024):
            some = used[s : s + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), lists(table[some], np.int32)],
                names=["row", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(row: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(row), lists(sums)], names=["row", "counts"]
            )

        held = None  # the last row, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            row = b.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            table = b.column(1).flatten().to_numpy().reshape(-1, wide)
            sums, row = np.add.reduceat(table, starts, axis=0, dtype=np.int64), row[starts]
            if held is not None and held[0][0] == row[0]:
                sums[0] += held[1][0]
            elif held is not None:
                yield out(*held)
            held = row[-1:], sums[-1:].copy()
            if len(row) > 1:
                yield out(row[:-1], sums[:-1])
        if held is not None:
            yield out(*held)

    parts = rows.select("ids").mapInArrow(count, "row int, counts array<int>")
    parts = parts.repartition(partitions(spark), "row").sortWithinPartitions("row")
    return parts.mapInArrow(add, "row int, counts array<long>")


def lists(table: np.ndarray, dtype=np.int64) -> pa.ListArray:
    ends = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(table.ravel().astype(dtype)))


def collected(counts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The matrix on the driver: ``rows`` times ``width``, both bounded by parameters."""
    out = np.zeros((rows, width), np.int64)
    for r in counts.collect():
        out[r["row"]] = r["counts"]
    return out


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(n: np.ndarray, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
    """What the likelihood gains if a word joins each class.

    ``n`` counts class pairs without the word, ``after`` and ``before`` the classes next to
    it, ``own`` its pairs with itself.
    """
    k = np.arange(len(n))
    both = x_log_x(n + after[None, :]) - x_log_x(n)
    both[k, k] = 0
    cols = x_log_x(n + before[:, None]) - x_log_x(n)
    cols[k, k] = 0
    diagonal = np.diag(n)
    here = x_log_x(diagonal + after + before + own) - x_log_x(diagonal)
    # What is next to the word counts for its class, wherever the word goes.
    left, right = n.sum(axis=1) + before, n.sum(axis=0) + after
    size_l, size_r = after.sum() + own, before.sum() + own
    less = x_log_x(left + size_l) - x_log_x(left) + x_log_x(right + size_r) - x_log_x(right)
    return both.sum(axis=1) + cols.sum(axis=0) + here - less


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word.  ``pairs`` has the words by rank and, last, all other tokens.

    Words in turn leave their class for the one that makes the class bigrams likeliest, until
    a sweep moves none.  All other tokens stay in a class of their own, the last.
    """
    words = len(pairs) - 1
    of = np.append(np.arange(words) % classes, classes)
    sums = lambda v: np.bincount(of, v, classes + 1)
    n = np.zeros((classes + 1, classes + 1))
    np.add.at(n, (of[:, None], of[None, :]), pairs)
    while True:
        moved = 0
        for w in range(words):
            own = float(pairs[w, w])
            after, before = sums(pairs[w]), sums(pairs[:, w])
            a = of[w]
            after[a] -= own
            before[a] -= own
            n[a, :] -= after
            n[:, a] -= before
            n[a, a] -= own
            gain = gains(n, after, before, own)[:classes]
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-6:  # rounding alone moves no word
                b = a
            n[b, :] += after
            n[:, b] += before
            n[b, b] += own
            of[w] = b
            moved += a != b
        if not moved:
            break
    return of[:words]


def best_classes(
    n: np.ndarray, of: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray
) -> np.ndarray:
    """The exchange step of many words at once: the class each gains most by joining.

    ``n`` counts class pairs with the words in their classes ``of``, ``after`` and ``before``
    (a line per word) the classes next to each, ``own`` its pairs with itself.  The last two
    classes, words not yet placed and the end, are no targets.  Like ``gains``, but it costs
    what a word's neighbours are, not all class pairs.
    """
    k, w = len(n) - 2, np.arange(len(of))
    after, before = after.astype(float), before.astype(float)
    after[w, of] -= own
    before[w, of] -= own
    placed = np.flatnonzero(of < k)
    home = of[placed]
    out = np.zeros((len(of), k))
    for table, here, there in ((n, after, before), (n.T, before, after)):
        pairs = np.ascontiguousarray(table[:k].T)
        logs = x_log_x(pairs)
        i, c = np.nonzero(here)
        if len(i):
            x = here[i, c]
            # Words share most (neighbour, count): each is worked out once, then less the word's.
            most = x.max() + 1
            kinds, kind = np.unique(c * most + x, return_inverse=True)
            kind_c, kind_x = (kinds // most).astype(int), kinds % most
            gain = (x_log_x(pairs[kind_c] + kind_x[:, None]) - logs[kind_c])[kind]
            back = np.flatnonzero(c == of[i])
            cell = pairs[c[back]] - there[i[back], :k]
            gain[back] = x_log_x(cell + x[back, None]) - x_log_x(cell)
            inside = np.flatnonzero(of[i] < k)
            at, j = of[i[inside]], i[inside]
            cell = pairs[c[inside], at] - x[inside] - (there[j, at] + own[j]) * (c[inside] == at)
            gain[inside, at] = x_log_x(cell + x[inside]) - x_log_x(cell)
            diagonal = np.flatnonzero(c < k)
            gain[diagonal, c[diagonal]] = 0
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            out[i[starts]] += np.add.reduceat(gain, starts, axis=0)
        total, size = table.sum(axis=1)[:k], here.sum(axis=1) + own
        kinds, kind = np.unique(size, return_inverse=True)
        less = (x_log_x(total + kinds[:, None]) - x_log_x(total))[kind]
        whole = total[home]
        less[placed, home] = x_log_x(whole) - x_log_x(whole - size[placed])
        out -= less
    both = after[:, :k] + before[:, :k] + own[:, None]
    i, c = np.nonzero(both)
    cell = np.diag(n)[c] - both[i, c] * (c == of[i])
    out[i, c] += x_log_x(cell + both[i, c]) - x_log_x(cell)
    best = out.argmax(axis=1)
    stays = out[placed, best[placed]] <= out[placed, home] + 1e-6
    best[placed[stays]] = home[stays]
    return best


def class_pairs(lines: DataFrame, of: np.ndarray, width: int) -> np.ndarray:
    """How often each class follows each, from the lines of the head's words.

    Pairs among words not yet placed and ends are missing; no exchange step asks for them.
    """
    shared = lines.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 2 * width), np.int64)
        for b in batches:
            if b.num_rows:
                table = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)[:, : 2 * width]
                np.add.at(total, shared.value[b.column(0).to_numpy()], table)
        rows = np.arange(width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(rows), lists(total)], names=["row", "counts"])

    both = np.zeros((width, 2 * width), np.int64)
    for r in lines.mapInArrow(run, "row int, counts array<long>").toLocalIterator():
        both[r["row"]] += r["counts"]
    n, from_ = both[:, :width].astype(float), both[:, width:].T.astype(float)
    n[width - 2 :] = from_[width - 2 :]  # unplaced words and ends have no lines of their own
    return n


def likelihood(n: np.ndarray) -> float:
    return float(x_log_x(n).sum() - x_log_x(n.sum(axis=1)).sum() - x_log_x(n.sum(axis=0)).sum())


def placed_head(
    rows: DataFrame, pairs: np.ndarray, size: int, sizes: Sizes
) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token id, and the class pairs: the head in exchange rounds.

    All words of a round step at once, against the classes of the round before.
    """
    spark = rows.sparkSession
    k = sizes.classes
    core, middle = min(sizes.core, size), min(sizes.middle, size)
    of = np.full(size + 2, k)
    of[:core], of[size + 1] = exchange(pairs, k), k + 1

    def counted(of: np.ndarray, upto: int) -> DataFrame:
        row = np.full(size + 2, -1)
        row[:upto] = np.arange(upto)
        return materialise(pair_counts(rows, row, of, k + 2, back=True), "brown-lines")

    def stepped(of: np.ndarray, n: np.ndarray, lines: DataFrame) -> np.ndarray:
        shared = spark.sparkContext.broadcast((of, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, n = shared.value
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    part = b.slice(s, 1024)
                    t = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                    at = part.column(0).to_numpy()
                    best = best_classes(
                        n, of[at], t[:, : k + 2], t[:, k + 2 : -1], t[:, -1].astype(float)
                    )
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(best.astype(np.int32))], names=["row", "best"]
                    )

        new = of.copy()
        for r in lines.mapInArrow(run, "row int, best int").collect():  # as many as the head
            new[r["row"]] = r["best"]
        return new

    if core < middle < size:
        lines = counted(of, middle)
        of = stepped(of, class_pairs(lines, of, k + 2), lines)
    lines = counted(of, size)
    n = class_pairs(lines, of, k + 2)
    while True:
        new = stepped(of, n, lines)
        if (new == of).all():
            return of, n
        lines = counted(new, size)
        after = class_pairs(lines, new, k + 2)
        # Words that had no class yet must get one, whatever the first round brings.
        open_ = bool((of[:size] == k).any())
        gain = likelihood(after) - likelihood(n)
        if open_ or gain > 0:
            of, n = new, after
        if not open_ and gain <= sizes.settled * abs(likelihood(n)):
            return of, n


def rare_words(rows: DataFrame, size: int) -> DataFrame:
    """(row, held_out, pos, word, left, right, own): each occurrence of a word outside the head
    with the token ids next to it, and whether it follows itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens = line(b.column(2), size)
            at = np.flatnonzero(tokens == size)
            doc = np.cumsum(tokens == size + 1)[at] - 1  # the end before a text counts it
            word = b.column(3).flatten().to_numpy()
            left, right = tokens[at - 1], tokens[at + 1]
            own = np.append(False, word[1:] == word[:-1]) & (left == size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)),
                 pa.array(at.astype(np.int32)), pa.array(word), pa.array(left.astype(np.int32)),
                 pa.array(right.astype(np.int32)), pa.array(own)],
                names=["row", "held_out", "pos", "word", "left", "right", "own"],
            )

    schema = "row long, held_out boolean, pos int, word long, left int, right int, own boolean"
    return rows.select("row", "held_out", "ids", "rare").mapInArrow(run, schema)


def placed_rare(rare: DataFrame, of: np.ndarray, n: np.ndarray) -> DataFrame:
    """(word, class, n), written: the exchange step of every word outside the head.

    ``rare`` holds the occurrences in training.  A word here is rarer than all of the head,
    so none has many rows; a task takes its words batch by batch.
    """
    width = len(n)
    shared = rare.sparkSession.sparkContext.broadcast((of, n))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0].astype(np.int16)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(of[b.column(1).to_numpy()]),
                 pa.array(of[b.column(2).to_numpy()]), b.column(3)],
                names=["word", "left", "right", "own"],
            )

    def stepped(after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        return best_classes(shared.value[1], np.full(len(own), width - 2), after, before, own)

    def step(b: pa.RecordBatch, once: np.ndarray) -> pa.RecordBatch:
        word = b.column(0).to_numpy()
        new = np.diff(word, prepend=word[0]) != 0
        new[0] = True
        i, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        count = len(starts)

        def table(column: int) -> np.ndarray:
            at = i * width + b.column(column).to_numpy()
            return np.bincount(at, minlength=count * width).reshape(count, width)

        times = np.bincount(i)
        best = once[b.column(1).to_numpy()[starts], b.column(2).to_numpy()[starts]]
        more = np.flatnonzero(times > 1)
        if len(more):
            own = np.bincount(i, b.column(3).to_numpy(zero_copy_only=False), count)[more]
            best[more] = stepped(table(2)[more], table(1)[more], own)
        return pa.RecordBatch.from_arrays(
            [pa.array(word[starts]), pa.array(best.astype(np.int16)), pa.array(times)],
            names=["word", "class", "n"],
        )

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word met once has one class on each side: all cases are worked out beforehand.
        one = np.eye(width)
        once = stepped(np.tile(one, (width, 1)), np.repeat(one, width, axis=0), np.zeros(width**2))
        once = once.reshape(width, width)
        held: list[pa.RecordBatch] = []  # rows of one word that may go on
        for b in batches:
            if not b.num_rows:
                continue
            word = b.column(0).to_numpy()
            cut = int(np.searchsorted(word, word[-1]))
            if cut or (held and held[0].column(0)[0].as_py() != word[0]):
                whole = [*held, b.slice(0, cut)] if cut else held
                yield step(joined(whole), once)
                held = []
            held.append(b.slice(cut))
        if held:
            yield step(joined(held), once)

    near = rare.select("word", "left", "right", "own")
    near = near.mapInArrow(classed, "word long, left short, right short, own boolean")
    near = near.repartition("word").sortWithinPartitions("word")
    return materialise(near.mapInArrow(steps, "word long, class short, n long"), "brown-rare")


def met_words(rare: DataFrame, classes: DataFrame, of: np.ndarray) -> DataFrame:
    """(row, held_out, before, chained, class, next, n), written: each occurrence of a word
    outside the head with the class of what is before it (``chained``: a word outside the head,
    too), its own, that of what follows (the outside class: the next such word) and its count
    in training.  A word never seen has the outside class and no count."""
    size = len(of) - 2
    outside = int(of[size])
    shared = rare.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int16)
        last = outside
        for b in batches:
            if not b.num_rows:
                continue
            left, own = b.column(3).to_numpy(), b.column(5).to_numpy()
            chained = left == size
            # Sorted by position, so the word outside the head before this one is the row before.
            before = np.where(chained, np.append(np.int16(last), own[:-1]), of[left])
            last = own[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(before.astype(np.int16)), pa.array(chained),
                 b.column(5), pa.array(of[b.column(4).to_numpy()]), b.column(6)],
                names=["row", "held_out", "before", "chained", "class", "next", "n"],
            )

    joined_up = rare.drop("own").join(classes, "word", "left").select(
        "row", "held_out", "pos", "left", "right",
        F.coalesce("class", F.lit(outside).cast("short")).alias("class"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    dealt = joined_up.repartition("row").sortWithinPartitions("row", "pos")
    schema = (
        "row long, held_out boolean, before short, chained boolean, class short, next short, n long"
    )
    return materialise(dealt.mapInArrow(run, schema), "brown-met")


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    of: np.ndarray  # class of each token id; all words outside the head have one as a target
    transition: np.ndarray  # log10 P(class, or outside the head | class before)
    emission: np.ndarray  # log10 P(token | its class); 0 for words outside the head
    base: np.ndarray  # log10 of the smoothed unigram; 0 for words outside the head
    counts: np.ndarray
    tokens: int
    distinct: int
    rest_tokens: int
    rest_words: int
    rest: np.ndarray  # log10 P(class, or never seen | class before, outside the head)
    rest_class: np.ndarray  # log10 of each class's discounted count of words outside the head


def fit(texts: DataFrame, vocabulary: DataFrame, text: str, sizes: Sizes) -> Model:
    """Train on all ``texts``; ``vocabulary`` holds their word counts."""
    lexicon, counts = lexicon_of(vocabulary, sizes)
    source = texts.select(
        F.lit(0).alias("key"), F.lit(False).alias("held_out"), F.col(text).alias("text")
    )
    return train(coded(source, lexicon), vocabulary, lexicon, counts, sizes)[0]


def train(
    rows: DataFrame, vocabulary: DataFrame, lexicon: Lexicon, counts: np.ndarray, sizes: Sizes
) -> tuple[Model, DataFrame]:
    """The model of the coded texts that are not held out, and ``met_words`` of all.

    The driver sees the head of the vocabulary, one ``core`` x ``core`` matrix and matrices
    of classes, all bounded by ``sizes``; every count covers all texts.
    """
    learnt = rows.where(~F.col("held_out"))
    docs = learnt.count()
    total = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words_n, words_v = total["n"] or 0, total["v"]
    counts = np.append(counts, [0, docs])
    size = lexicon.size
    core = min(sizes.core, size)
    ids = np.minimum(np.arange(size + 2), core)
    pairs = collected(pair_counts(learnt, ids, ids, core + 1), core + 1, core + 1)
    of, n = placed_head(learnt, pairs, size, sizes)
    classes = placed_rare(rare_words(learnt, size), of, n)
    met = met_words(rare_words(rows, size), classes, of)

    # Targets: words of the head by class, any word outside it, the end.
    k, width = sizes.classes, sizes.classes + 2
    from_head = of.copy()
    from_head[size] = -1
    follow = collected(pair_counts(learnt, from_head, of, width), width, width).astype(float)
    inner = np.zeros((width, k))
    keys = ("before", "chained", "class", "next")
    for r in met.where(~F.col("held_out")).groupBy(*keys).count().collect():  # by class only
        inner[r["before"], r["class"]] += r["count"]
        if r["chained"]:
            follow[r["before"], k] += r["count"]
        if r["next"] != k:
            follow[r["class"], r["next"]] += r["count"]
            # A word never seen is followed by what follows a word outside the head.
            follow[k, r["next"]] += r["count"]
        else:
            follow[k, k] += r["count"]
    held = np.zeros((2, k))
    for r in classes.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        held[:, r["class"]] = r["n"], r["v"]

    tokens, distinct = words_n + docs, words_v + (docs > 0)
    rest_tokens, rest_words = words_n - int(counts[:size].sum()), words_v - size
    strength = 5.0
    # One occurrence more for a word never seen and for an end, so neither is impossible.
    extra = np.zeros(width)
    extra[[k, k + 1]] = 1
    met_targets = np.bincount(of, counts, width)
    met_targets[k] = rest_tokens
    share = (met_targets + extra) / (met_targets.sum() + extra.sum())
    seen = follow.sum(axis=1, keepdims=True)
    transition = (follow + strength * share[None, :]) / (seen + strength)
    never = (DISCOUNT * rest_words + 1) / (rest_tokens + 1)
    inner[k] = inner[:k].sum(axis=0)
    seen = inner.sum(axis=1, keepdims=True)
    known = (inner + strength * held[0] / max(rest_tokens, 1)) / (seen + strength)
    rest = np.hstack([(1 - never) * known, np.full((width, 1), never)])
    in_class = np.bincount(of, counts, width)
    with np.errstate(divide="ignore"):
        emission = np.log10(counts / np.maximum(in_class[of], 1))
        logs = np.log10(np.maximum(transition, 1e-300))
    emission[size], emission[size + 1] = 0.0, 0.0
    base = np.log10((counts + 1) / (tokens + distinct + 1))
    base[size] = 0.0
    model = Model(
        lexicon, of, logs, emission, base, counts, tokens, distinct, rest_tokens, rest_words,
        np.log10(np.maximum(rest, 1e-300)),
        np.log10(np.maximum(held[0] - DISCOUNT * held[1], 1e-300)),
    )
    return model, met


def score(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    held_out: Column | None = None,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """log10 probability of each whole text, learnt from the rows that are not held out.

    A token is a word (ASCII letters lower-cased) or the end of a text.  Its probability is
    that of its class after the class before, times that of the word in its class.  Classes
    come from exchange clustering of every training word (see ``Sizes``).  Class transitions
    are drawn to the class frequencies with the weight of five occurrences.  The words outside
    the head are first met as such, then by their class after the class before, then in their
    class with absolute discounting; what is taken off them is the probability of the one event
    "a word never seen", so the probabilities after any token add up to 1.

    One row per document: ``key``, ``held_out``, ``n_tokens``, ``n_known`` (seen in
    training), ``train_tokens``, ``base_score`` (add-one unigram) and ``score``.

    Pairs within the head are scored where the text lies.  Each occurrence of another word is
    joined with its class and count, and added up per document; such a word is rarer than all
    of the head, so no key of that join has many rows.

    Defined results: NULL and empty texts have one token, the end; a NULL key is never held
    out; rows that repeat are scored, and counted in training, one by one; without training
    rows every word is unknown; an empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark, 8)
    out = is_held_out(F.col(key)) if held_out is None else held_out
    source = docs.select(F.col(key).alias("key"), out.alias("held_out"), F.col(text).alias("text"))
    vocabulary = materialise(word_counts(source.where(~F.col("held_out")), "text"), "brown-words")
    lexicon, counts = lexicon_of(vocabulary, sizes)
    rows = coded(source, lexicon)
    model, met = train(rows, vocabulary, lexicon, counts, sizes)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = m.lexicon.size
        known_id = np.append(m.counts[:size] > 0, [False, m.counts[size + 1] > 0])
        for b in batches:
            if not b.num_rows:
                continue
            tokens = line(b.column(3), size)
            a, z = tokens[:-1], tokens[1:]
            sizes = b.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1
            starts = np.append(0, np.cumsum(sizes)[:-1])
            per = lambda v: np.add.reduceat(v, starts)
            head = (a != size) & (z != size)
            logs = np.where(head, m.transition[m.of[a], m.of[z]], 0.0) + m.emission[z]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(sizes),
                 pa.array(per(known_id[z].astype(np.int64))), pa.array(per(m.base[z])),
                 pa.array(per(logs))],
                names=["row", "key", "held_out", "n_tokens", "known", "base", "score"],
            )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        outside = len(m.transition) - 2
        bound = np.append(m.rest_class, 0.0)
        for b in batches:
            if not b.num_rows:
                continue
            row, n = b.column(0).to_numpy(), b.column(4).to_numpy()
            before, own, after = (b.column(i).to_numpy() for i in (1, 2, 3))
            found = n > 0
            logs = m.transition[before, outside] + m.rest[before, own]
            logs += np.where(found, np.log10(np.maximum(n, 1) - DISCOUNT) - bound[own], 0.0)
            logs += np.where(after == outside, 0.0, m.transition[own, after])
            plain = np.log10((n + 1) / (m.tokens + m.distinct + 1))
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            per = lambda v: pa.array(np.add.reduceat(v, starts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[starts]), per(found.astype(np.int64)), per(plain), per(logs)],
                names=["row", "rest_known", "rest_base", "rest_score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    near = rows.select("row", "key", "held_out", "ids").mapInArrow(
        run,
        f"row long, key {kind}, held_out boolean, n_tokens long, known long, base double, "
        "score double",
    )
    far = met.select("row", "before", "class", "next", "n").mapInArrow(
        rest, "row long, rest_known long, rest_base double, rest_score double"
    )
    sums = far.groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("rest_known", "rest_base", "rest_score"))
    )
    zero = F.lit(0.0)
    return near.join(sums, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", zero)).alias("score"),
    )
