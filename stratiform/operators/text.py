"""Text operators: chunking, requirement extraction, mentions.  All run inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import chunk_uid

# What ends a line, what counts as white space, and the chunk parameters.
LINE_BREAK = "[\\n-\\r\\x1c-\\x1e\\u0085\\u2028\\u2029]"
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CHUNK_CHARS = 800
OVERLAP_PART = 5


def strip(c: Column) -> Column:
    """Without white space at either end (any Unicode white space, not just blanks)."""
    return F.btrim(c, F.lit(SPACE))


def lines_of(text: Column) -> Column:
    """The lines of a text; a carriage return with a line feed ends one line, not two."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_BREAK)


def chunks_of(text: Column, max_chars: int = CHUNK_CHARS) -> Column:
    """The chunks of a text, in order.

    Lines are collected until they hold ``max_chars`` characters (one is added per line
    for its break); the last fifth of a closed chunk's lines opens the next one.  Lines
    left at the end form the last chunk; blank chunks are dropped.  One fold per row.
    """
    body = strip(text)
    lines = F.when(body == "", F.array().cast("array<string>")).otherwise(
        lines_of(body)
    )
    start = F.struct(
        F.array().cast("array<string>").alias("open"),
        F.lit(0).alias("n"),
        F.array().cast("array<string>").alias("done"),
    )

    def with_chunk(done, parts):
        chunk = strip(F.array_join(parts, "\n"))
        return F.concat(done, F.filter(F.array(chunk), lambda c: c != ""))

    def add(state, line):
        parts = F.concat(state["open"], F.array(line))
        n = state["n"] + F.length(line) + 1
        kept = F.floor(F.size(parts) / OVERLAP_PART).cast("int")
        tail = F.slice(parts, F.size(parts) - kept + 1, kept)
        tail_n = F.aggregate(tail, F.lit(0), lambda a, s: a + F.length(s) + 1)
        closed = F.struct(
            tail.alias("open"), tail_n.alias("n"), with_chunk(state["done"], parts).alias("done")
        )
        going = F.struct(parts.alias("open"), n.alias("n"), state["done"].alias("done"))
        return F.when(n >= max_chars, closed).otherwise(going)

    def finish(state):
        return F.when(F.size(state["open"]) > 0, with_chunk(state["done"], state["open"])).otherwise(
            state["done"]
        )

    return F.aggregate(lines, start, add, finish)


def chunk(
    df: DataFrame, source: Column, text: str, source_type: Column, max_chars: int = CHUNK_CHARS
) -> DataFrame:
    """(uid, source, source_type, chunk_no, text) rows; no shuffle."""
    rows = df.select(
        source.cast("string").alias("source"),
        source_type.alias("source_type"),
        F.posexplode(chunks_of(F.col(text), max_chars)).alias("chunk_no", "text"),
    )
    uid = chunk_uid(F.col("source"), F.col("chunk_no"), F.col("text"))
    return rows.select(uid.alias("uid"), "source", "source_type", "chunk_no", "text")


# The two notations of a requirement.
REQUIREMENT_ROW = r"\|?\s*(REQ-\d+)[^\|]*\|([^\|]+)\|?"
REQUIREMENT_LINE = r"(REQ-\d+)[:\s]+([^\n]+)"


def extract_requirements(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, req_no, req_id, req_text): table rows, or plain lines if there are none."""

    def found(pattern):
        ids = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        texts = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.arrays_zip(ids.alias("id"), texts.alias("body"))

    rows = found(REQUIREMENT_ROW)
    hits = F.when(F.size(rows) > 0, rows).otherwise(found(REQUIREMENT_LINE))
    out = df.select(*keys, F.posexplode(hits).alias("req_no", "_r"))
    return out.select(
        *keys,
        "req_no",
        strip(F.col("_r.id")).alias("req_id"),
        strip(F.col("_r.body")).alias("req_text"),
    )


def find_mentions(
    df: DataFrame, keys: Sequence[str], text: str, names: Sequence[str], first: int = 5
) -> DataFrame:
    """(keys, name, lines): the first lines of each text that contain a name.

    The report shows ``first`` lines per text and name; the whole text is searched.
    """
    lines = lines_of(F.col(text))

    def hits(name):
        kept = F.slice(F.filter(lines, lambda s: s.contains(name)), 1, first)
        return F.struct(F.lit(name).alias("name"), F.array_join(kept, "\n").alias("lines"))

    mentioned = F.array_compact(
        F.array(*[F.when(F.col(text).contains(n), hits(n)) for n in names])
    )
    return df.select(*keys, F.inline(mentioned))
