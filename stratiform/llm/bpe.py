"""Byte-level BPE in numpy: whole matrices of pieces merge one pair per row and round."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, free_name, with_fields

#: Rank of a pair that does not merge.
NONE = np.int32(2**31 - 1)
#: Pieces longer than this merge on a heap; a row of a matrix costs the square of its length.
LONG = 512
#: Cells of one matrix, and pieces that a worker keeps encoded; both bound memory only.
CELLS = 1 << 20
KEPT = 1 << 18
#: Characters of text whose pieces are held at once.
CHUNK = 1 << 20


class Vocabulary:
    """Ranks of byte strings, and a hash table of the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(self.size)]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = self._key(np.array(left, np.int64), np.array(right, np.int64))
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        made = np.array(made, np.int32)
        while len(todo):  # open addressing: the first to come keeps a free slot
            free = self.keys[slot] < 0
            put, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[put], self.made[put] = keys[todo[won]], made[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _key(self, a, b):
        return a * (self.size + 1) + b  # id ``size`` stands for no symbol

    def _slot(self, keys):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair (a, b), NONE where it does not merge."""
        keys = self._key(a.astype(np.int64), b.astype(np.int64))
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.made[slot], NONE)
        todo = np.flatnonzero((at != keys) & (at >= 0))
        while len(todo):
            slot_t = (slot[todo] + 1) & ((1 << self.bits) - 1)
            slot[todo] = slot_t
            at = self.keys[slot_t]
            hit = at == keys[todo]
            out[todo[hit]] = self.made[slot_t[hit]]
            todo = todo[~hit & (at >= 0)]
        return out

    @cached_property
    def pairs(self) -> dict[int, int]:
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.made[used].tolist()))

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONG:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, own in buckets.items():
            step = max(1, CELLS // width)
            for s in range(0, len(own), step):
                rows = own[s : s + step]
                for i, ids in zip(rows, self.merge_rows([pieces[i] for i in rows], width)):
                    out[i] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Each round, each row merges its leftmost pair of least rank; done rows leave."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.byte_ids[raw.reshape(n, width)]
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids[np.arange(width) >= length[:, None]] = self.size
        ranks = np.full((n, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
        out: list = [None] * n
        row = np.arange(n)
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            merged = ranks[here, at]
            done = merged == NONE
            if done.any():
                for i, line in zip(row[done], ids[done]):
                    out[i] = line[line < self.size].tolist()
                live = ~done
                row, ids, ranks, at, merged = row[live], ids[live], ranks[live], at[live], merged[live]
                here = here[: len(row)]
                if not len(row):
                    break
            ids[here, at] = merged
            # The right half of the merged pair goes; every row shrinks by one cell.
            keep = np.ones(ids.shape, bool)
            keep[here, at + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            ranks = ranks[keep].reshape(len(row), -1)
            last = ids.shape[1] - 1
            right = ids[here, np.minimum(at + 1, last)]
            right = np.where(at < last, right, self.size)
            ranks[here, at] = self.lookup(merged, right)
            inner = here[at > 0]
            before = at[inner] - 1
            ranks[inner, before] = self.lookup(ids[inner, before], merged[inner])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, by a heap of pairs (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.lookup(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks != NONE)]
        heapq.heapify(heap)
        now, pairs, none = ranks.tolist() + [int(NONE)], self.pairs, int(NONE)

        def rank(i: int) -> None:
            j = after[i]
            now[i] = found = pairs.get(self._key(ids[i], ids[j]), none) if j < n else none
            if found != none:
                heapq.heappush(heap, (found, i))

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r or ids[i] < 0:
                continue
            gone = after[i]
            ids[i], ids[gone], now[gone] = r, -1, none
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            rank(i)
            if before[i] >= 0:
                rank(before[i])
        return [i for i in ids if i >= 0]


class Encoder:
    """Texts to ids and back.  Pieces seen before come from a bounded memo."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        held: list[list[str]] = []
        room = CHUNK
        for text in texts:
            held.append(self.split(text))
            room -= len(text)
            if room < 0:
                yield from self._encode(held)
                held, room = [], CHUNK
        yield from self._encode(held)

    def _encode(self, split: list[list[str]]) -> Iterator[list[int]]:
        if len(self.memo) > KEPT:
            self.memo.clear()
        new = list(set(chain.from_iterable(split)).difference(self.memo))
        ids = self.vocabulary.encode_pieces([p.encode() for p in new])
        self.memo.update(zip(new, map(tuple, ids)))  # tuples of ints cost the collector nothing
        for pieces in split:
            yield list(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def ids_digest(self, ids: Iterable[int]) -> str:
        text = ",".join(map(self.vocabulary.decimal.__getitem__, ids))
        return hashlib.sha256(text.encode()).hexdigest()


def load_ranks(path: str) -> bytes:
    """The rank file as it lies; read once, on the driver."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str) -> Encoder:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return Encoder({base64.b64decode(a): int(b) for a, b in pairs}, pattern)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    text: str = "text",
    keep: Sequence[str] | None = None,
    ids: bool = True,
) -> DataFrame:
    """Encode whole texts; add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``ids``.

    A text is split by ``pattern`` and each match is merged by itself, leftmost pair of least
    rank first; no special tokens.  The ids are then decoded again: ``decoded_sha256`` is the
    digest of those bytes and equals the digest of the text's UTF-8 bytes.

    A map without shuffle.  Every task builds the vocabulary once from the broadcast rank
    file (its size is that of the file, not of the data).

    Defined results: NULL texts are encoded as empty ones (no ids); rows that repeat, ties
    and extra columns are untouched (``keep`` names the columns to return, all by default;
    columns of ``docs`` that clash with the added ones are replaced); an empty table gives an
    empty result.  A single piece of any length costs n log n, not its square.
    """
    spark = docs.sparkSession
    bound_batches(spark, 4)
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if ids:
        added["ids"] = "array<int>"
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*keep, F.col(text).alias(free_name(keep, "__text")))
    schema = with_fields(T.StructType(source.schema.fields[:-1]), **added)
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for b in batches:
            texts = (t or "" for t in b.column(b.num_columns - 1).to_pylist())
            counts, digests, decoded, flat = [], [], [], []
            for own in encoder.encode(texts):
                counts.append(len(own))
                digests.append(encoder.ids_digest(own))
                decoded.append(hashlib.sha256(encoder.decode(own)).hexdigest())
                if ids:
                    flat.append(np.array(own, np.int32))
            arrays = [*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            arrays.append(pa.array(decoded, pa.string()))
            if ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                values = np.concatenate(flat) if flat else np.empty(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, *, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes of each row's ids; NULL ids decode to no bytes."""
    spark = tokens.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    schema = with_fields(tokens.schema, decoded="binary")
    at = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, "")
        for b in batches:
            made = [encoder.decode(i or ()) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=schema.names)

    return tokens.mapInArrow(run, schema)
