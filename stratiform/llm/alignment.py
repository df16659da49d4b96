"""Tokens of two tokenizers aligned by the byte offsets where both end, in Arrow."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bound_batches, with_fields

#: Megabytes of text per chunk: the unit whose pairs are counted together.
CHUNK_MB = 3
#: Groups of more links than this count their ids before they are joined.
LARGE = 64
#: Words that a worker keeps aligned; bounds memory only.
KEPT = 1 << 18
DOC = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}


def _byte_of() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens.

    ``by_word``: no piece of the second vocabulary joins a space to what stands before it.
    The split rules of the first never do.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of, size = _byte_of(), self.a.get_vocab_size()
        entries = (self.a.id_to_token(i) or "" for i in range(size))
        a = [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries]
        b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            raw = piece.replace("▁", " ").encode()
            b.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else raw)
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a, b)]
        self.lengths = [pc.binary_length(x).cast(pa.int64()) for x in self.bytes]
        self.by_word = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(b)))
        self.sizes = (len(a), len(b))

    def encode(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """For each text the ids of " " + text by the first and of the text by the second."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1)
        return _lists([x.ids for x in a]), _lists(b)


def _lists(ids: list[Sequence[int]]) -> pa.LargeListArray:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat))


def _ends_in_list(lengths: pa.Array, lists: pa.LargeListArray) -> pa.Array:
    """Running sums of the flattened ``lengths`` that start anew with every list."""
    total = pc.cumulative_sum(lengths)
    before = np.concatenate([[0], total.to_numpy()])[lists.offsets.to_numpy()[:-1]]
    return pc.subtract(total, pc.take(pa.array(before), pc.list_parent_indices(lists)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


def _joined(strings: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """Runs of ``strings`` joined by a separator."""
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), by)


def _spelt(tokens: pa.LargeBinaryArray, lists: pa.LargeListArray) -> pa.LargeBinaryArray:
    """The bytes of each list of tokens: they already lie one after the other."""
    if not len(tokens):
        return pa.array([b""] * len(lists), pa.large_binary())
    _, offsets, data = tokens.buffers()
    starts = np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy()]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(starts), data])


@dataclass
class Aligned:
    """Alignments of texts, as columns: one row per text, and the links of all texts in order.

    A pair is a * (size of the second vocabulary) + b.  ``spelt`` tells whether the tokens
    give the bytes of the text; where not, the other columns are zero.
    """

    spelt: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_pairs: np.ndarray
    lines: pa.Array
    pair: np.ndarray
    links: np.ndarray

    def __add__(self, other: Aligned) -> Aligned:
        def both(x, y):
            return pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate([x, y])

        return Aligned(*(both(getattr(self, f.name), getattr(other, f.name)) for f in fields(self)))


def align(texts: list[str], tok: Tokenizers) -> Aligned:
    """Align the tokens of every text.

    Both id lists are flattened; parent indices and segmented sums of token bytes give each
    token its text and end.  A hash join on text and end finds the ends that both share, and
    the number of shared ends before a token is its group.  A second one, on the group, links
    tokens.  Where a group is large, occurrences of each id are counted first: it costs the
    product of its distinct ids, not of its tokens.
    """
    lists = list(tok.encode(texts))
    want = pa.array([" " + t if t else "" for t in texts], pa.large_string()).cast(pa.large_binary())
    good = np.ones(len(texts), bool)
    for k in (0, 1):
        whole = _spelt(pc.take(tok.bytes[k], lists[k].flatten()), lists[k])
        good &= pc.equal(whole, want).to_numpy(zero_copy_only=False)
    if not good.all():
        none = pa.scalar([], lists[0].type)
        lists = [pc.if_else(pa.array(good), x, none) for x in lists]
        lists = [pa.LargeListArray.from_arrays(np.cumsum([0, *pc.list_value_length(x).to_pylist()]), x.flatten()) for x in lists]
    flat = [x.flatten() for x in lists]
    doc = [pc.list_parent_indices(x) for x in lists]
    ends = []
    for k in (0, 1):
        end = _ends_in_list(pc.take(tok.lengths[k], flat[k]), lists[k])
        document_end = pc.add(pc.shift_left(doc[k], pa.scalar(32, pa.int64())), end)
        ends.append(pa.table({"document_end": document_end, f"at_{k}": np.arange(len(end))}))
    shared = ends[0].join(ends[1], "document_end", join_type="inner", use_threads=False)
    group, cuts = [], []
    for k in (0, 1):
        last = np.zeros(len(flat[k]), bool)
        last[shared.column(f"at_{k}").to_numpy()] = True
        group.append(np.cumsum(last) - last)
        cuts.append(np.flatnonzero(last) + 1)
    doc_of_group = doc[0].to_numpy()[cuts[0] - 1]
    n_groups = np.bincount(doc_of_group, minlength=len(texts))
    large = np.diff(cuts[0], prepend=0) * np.diff(cuts[1], prepend=0) > LARGE
    parts, all_pairs = [], tok.sizes[0] * tok.sizes[1]
    for few in (True, False):
        side = []
        for k, name in ((0, "a"), (1, "b")):
            own = np.flatnonzero(large[group[k]] != few)
            t = pa.table({"g": group[k][own], name: flat[k].take(pa.array(own)), f"n_{name}": np.ones(len(own), np.int64)})
            if not few:
                t = t.group_by(["g", name], use_threads=False).aggregate([(f"n_{name}", "sum")])
                t = t.rename_columns({f"n_{name}_sum": f"n_{name}"})
            side.append(t)
        made = side[0].join(side[1], "g", join_type="inner", use_threads=False)
        pair = pc.add(pc.multiply(made.column("a").cast(pa.int64()), tok.sizes[1]), made.column("b").cast(pa.int64()))
        code = doc_of_group[made.column("g").to_numpy()] * all_pairs + pair.to_numpy()
        parts.append(pa.table({"code": code, "n": pc.multiply(made.column("n_a"), made.column("n_b"))}))
    where, pair, links = _per_document(pa.concat_tables(parts), all_pairs)
    sides = [_joined(flat[k].cast(pa.string()), cuts[k], ",") for k in (0, 1)]
    both = pc.binary_join_element_wise(*sides, "|")
    return Aligned(
        good, np.diff(lists[0].offsets), np.diff(lists[1].offsets), n_groups,
        np.bincount(where, minlength=len(texts)), _joined(both, np.cumsum(n_groups), ";"), pair, links,
    )


def _per_document(found: pa.Table, all_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) from rows (code, n): each pair of a document once, in order."""
    found = found.group_by("code", use_threads=False).aggregate([("n", "sum")]).sort_by("code")
    where, pair = np.divmod(found.column("code").to_numpy(), all_pairs)
    return where, pair, found.column("n_sum").to_numpy()


class Words:
    """Words that have been aligned, each once, in one growing set of columns.

    Where every space of a text stands alone between words, tokens of both kinds end with
    each word, and the words are aligned as documents of their own.
    """

    def __init__(self, tok: Tokenizers):
        self.tok, self.place = tok, {}
        self.known = align([], tok)

    def add(self, words: set[str]) -> None:
        if len(self.place) > KEPT:
            self.__init__(self.tok)
        new = list(words.difference(self.place))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        made = align(new, self.tok)
        # A word that is empty or ends in white space shares that with the space behind it.
        made.spelt &= np.fromiter((w != "" and not w[-1].isspace() for w in new), bool, len(new))
        self.known += made


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def align_documents(texts: list[str | None], words: Words) -> tuple[dict, pa.Table]:
    """Per text the numbers and the digest of DOC; and the links (doc, pair, links) of all.

    Texts are lists of words, gathered from those aligned; a text that is no such list, or
    with a word that the tokens don't spell, is aligned as a whole.
    """
    n, tok = len(texts), words.tok
    split = [t.split(" ") if t and tok.by_word else [] for t in texts]
    missing = set(chain.from_iterable(split))
    words.add(missing)
    sizes = np.fromiter(map(len, split), np.int64, n)
    at = np.fromiter(map(words.place.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    known = words.known
    doc = np.repeat(np.arange(n), sizes)
    whole = np.bincount(doc[~known.spelt[at]], minlength=n) > 0
    whole |= np.fromiter((bool(t) and not tok.by_word for t in texts), bool, n)
    even = ~whole[doc]
    at, doc = at[even], doc[even]
    own = np.flatnonzero(whole)
    rest = align([texts[i] for i in own], tok)

    first = np.cumsum(known.n_pairs) - known.n_pairs
    of_word = known.n_pairs[at]
    picked = _ranges(first[at], of_word)
    all_pairs = tok.sizes[0] * tok.sizes[1]
    code = np.concatenate([
        np.repeat(doc, of_word) * all_pairs + known.pair[picked],
        np.repeat(own, rest.n_pairs) * all_pairs + rest.pair,
    ])
    where, pair, links = _per_document(
        pa.table({"code": code, "n": np.concatenate([known.links[picked], rest.links])}), all_pairs
    )
    numbers = {}
    for c in ("n_a", "n_b", "n_groups"):
        total = np.bincount(doc, getattr(known, c)[at], minlength=n).astype(np.int64)
        total[own] = getattr(rest, c)
        numbers[c] = total
    numbers["n_links"] = np.bincount(where, links, minlength=n).astype(np.int64)
    ends = np.cumsum(np.bincount(doc, minlength=n))
    lines = _joined(known.lines.take(pa.array(at)), ends, ";").to_pylist()
    for i, line in zip(own, rest.lines.to_pylist()):
        lines[i] = line
    numbers["groups_sha256"] = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines]
    return numbers, pa.table({"doc": where, "pair": pair, "links": links})


@lru_cache(maxsize=1)
def _words(byte_level: bytes, pieces: bytes) -> Words:
    return Words(Tokenizers(byte_level, pieces))


def aligned(
    docs: DataFrame,
    byte_level_path: str,
    pieces_path: str,
    *,
    text: str = "text",
    keep: Sequence[str] | None = None,
    chunk_mb: int = CHUNK_MB,
) -> DataFrame:
    """Align the tokens of two tokenizers in every text and count their links corpus-wide.

    The first tokenizer (a ``tokenizers`` file of byte-level BPE) encodes a space and the
    text, the second (a sentencepiece model, which adds that space) the text.  Bytes at which
    tokens of both end cut a text into groups; all pairs of tokens in a group are linked.
    Adds ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best``
    (links of a pair that no other pair of its first id beats) and ``count_sum`` (summed over
    links, in how many rows their pair of ids is linked).

    Texts are encoded once, without shuffle, in chunks of ``chunk_mb`` (an Arrow batch, or
    one longer text).  A chunk counts its own pairs of ids before anything is shuffled; Spark
    adds the partial counts, finds each first id's highest, and the counts go back to the
    chunks that hold the pair.  There they are joined to the links by place in the chunk's
    list of pairs.  No key is hot: a pair occurs once in a chunk, and a chunk is bounded.

    Defined results: texts that are NULL, empty, or that the tokens of either tokenizer do not
    spell exactly have no tokens: all numbers 0 and the digest ''.  Rows that repeat count
    as documents of their own.  ``keep`` names the columns to return (all by default);
    columns with the names of added ones are replaced.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark, chunk_mb)
    added = DOC | {"n_best": "long", "count_sum": "long"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    kept = F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept")
    source = docs.select(kept, F.col(text).cast("string").alias("text"))
    files = []
    for path in (byte_level_path, pieces_path):
        with open(path, "rb") as f:
            files.append(spark.sparkContext.broadcast(f.read()))
    row = T.StructType([T.StructField("kept", source.schema["kept"].dataType)])
    # Rows of one kind hold a document, those of the other the chunk's pairs and their counts.
    shape = with_fields(
        row, chunk="long", **DOC, pair="array<int>", links="array<int>",
        a="array<int>", b="array<int>", held="array<int>",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(files[0].value, files[1].value)
        types = pa.schema([])
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            numbers, links = align_documents(batch.column(1).to_pylist(), words)
            counted = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
            place = pc.index_in(links.column("pair"), counted.column("pair").combine_chunks())
            per = np.bincount(links.column("doc").to_numpy(), minlength=n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, _one(x.cast(pa.int32())))
                for x in (place, links.column("links"))
            ]
            chunks = pa.array(np.full(n, chunk), pa.int64())
            none = pa.nulls(n, pa.list_(pa.int32()))
            docs_of = [batch.column(0), chunks]
            docs_of += [pa.array(numbers[c]) for c in DOC]
            docs_of += [*lists, none, none, none]
            names = shape.names
            made = pa.RecordBatch.from_arrays(docs_of, names=names)
            types = made.schema
            yield made
            pairs = [*np.divmod(counted.column("pair").to_numpy(), words.tok.sizes[1]), counted.column("count_all").to_numpy()]
            whole = {"chunk": pa.array([chunk], pa.int64())}
            for c, v in zip(("a", "b", "held"), pairs):
                ends = pa.array([0, len(v)], pa.int32())
                whole[c] = pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [whole.get(f.name, pa.nulls(1, f.type)) for f in types], names=names
            )
            chunk += 1
            del numbers, links, counted, place, lists, docs_of, made
            pa.default_memory_pool().release_unused()

    stored = materialise(source.mapInArrow(run, shape), "alignment")
    pairs = stored.where("a is not null").select(
        "chunk", F.posexplode(F.arrays_zip("a", "b", "held")).alias("place", "p")
    )
    pairs = pairs.select("chunk", "place", "p.a", "p.b", "p.held")
    total = pairs.groupBy("a", "b").agg(F.sum("held").alias("docs"))
    total = materialise(total, "alignment-pairs")
    highest = total.groupBy("a").agg(F.max("docs").alias("highest"))
    ranked = total.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("highest")).cast("int").alias("best"))
    told = pairs.drop("held").join(ranked, ["a", "b"]).select("chunk", "place", "docs", "best")
    right = stored.where("a is null").select(F.col("chunk").alias("own"), "kept", *DOC, "pair", "links")
    out = with_fields(T.StructType([stored.schema["kept"]]), **added)

    def look_up(counts: pa.Table, rows: pa.Table) -> pa.Table:
        """The counts of a chunk's pairs, taken by the links of its documents."""
        pair, links = (_one(rows.column(c)) for c in ("pair", "links"))
        at, n = pair.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(pc.list_value_length(pair).to_numpy())
        arrays = [rows.column("kept"), *(rows.column(c) for c in DOC)]
        for c in ("best", "docs"):
            value = np.zeros(counts.num_rows, np.int64)
            value[counts.column("place").to_numpy()] = counts.column(c).to_numpy()
            arrays.append(pa.array(_sums(value[at] * n, ends)))
        return pa.table(arrays, names=out.names)

    met = told.groupBy("chunk").cogroup(right.groupBy("own"))
    done = met.applyInArrow(look_up, out)
    return done.select(*(F.col(f"kept.`{c}`").alias(c) for c in keep), *added)


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
