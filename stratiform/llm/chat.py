"""Conversations as one text each, with a loss mask, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role COLON text END; texts of merged turns are parted by PART.
OPEN, COLON, PART, END = "### ", ": ", "</part>", "</turn>\n"
#: What a text may not hold as it stands, and what stands for it.  The backslash comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\#\\#\\#"), ("</part>", "<\\/part>"), ("</turn>", "<\\/turn>"))
#: The same for roles, which end at the first COLON.
ROLE_ESCAPES = (("%", "%25"), (":", "%3A"), ("<", "%3C"))
SPANS = "array<struct<start:int,chars:int>>"


def escape(text: Column) -> Column:
    """``text`` without any control string; :func:`unescape` gives it back."""
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    for raw, code in ROLE_ESCAPES:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for raw, code in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def format_chats(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: its key, ``formatted`` and ``loss_mask``.

    The turns of a conversation are collected as structs and sorted by ``turn``; adjacent
    turns of one role share a header, their texts parted by a control string, so that every
    row can be read back.  Texts are escaped before they are collected.  ``loss_mask`` holds
    (start, chars) in code points of ``formatted``, one span per text of the role ``learn``:
    what a model is trained on, headers and marks left out.

    A conversation is one output text and is built in one task; there is no larger unit.

    Defined results: a NULL text is empty and a NULL role is the empty role; turns of equal
    number are ordered by role, then escaped text, a NULL number comes first, and repeated
    rows are turns of their own; a row without a conversation key is a conversation by itself,
    so such rows are never gathered; an empty table gives an empty result.  Other columns are
    not read.
    """
    row = F.struct(
        F.col(turn).alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("e"),
    )
    own = turns.select(F.col(conversation).alias("c"), row.alias("row"))
    keyed = own.where("c is not null").groupBy("c")
    gathered = keyed.agg(F.sort_array(F.collect_list("row")).alias("rows")).union(
        own.where("c is null").select("c", F.array("row"))
    )

    def add(done: Column, new: Column) -> Column:
        """Append one turn: a header where the role changes, else a mark between the texts."""
        started = done["role"].isNotNull()
        same = F.coalesce(done["role"] == new["r"], F.lit(False))
        header = F.concat(F.lit(OPEN), _escape_role(new["r"]), F.lit(COLON))
        closed = F.when(started, F.concat(F.lit(END), header)).otherwise(header)
        mark = F.when(same, F.lit(PART)).otherwise(closed)
        start = done["chars"] + F.length(mark)
        chars = F.length(new["e"])
        span = F.array(F.struct(start.alias("start"), chars.alias("chars")))
        spans = F.when(new["r"] == learn, F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(
            new["r"].alias("role"), (start + chars).alias("chars"),
            F.concat(done["pieces"], F.array(mark, new["e"])).alias("pieces"),
            spans.alias("spans"),
        )

    nothing = F.struct(
        F.lit(None).cast("string").alias("role"), F.lit(0).alias("chars"),
        F.array().cast("array<string>").alias("pieces"), F.array().cast(SPANS).alias("spans"),
    )
    merged = gathered.select("c", F.aggregate("rows", nothing, add).alias("m"))
    return merged.select(
        F.col("c").alias(conversation),
        F.concat(F.array_join("m.pieces", ""), F.lit(END)).alias("formatted"),
        F.col("m.spans").alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The rows of a formatted conversation: array of (role, text), texts unescaped."""
    blocks = F.split(formatted, F.lit(END))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def rows(block: Column) -> Column:
        cut = F.instr(block, COLON)
        role = F.substring(block, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        body = F.substring(block, cut + len(COLON), F.length(block))
        return F.transform(
            F.split(body, F.lit(PART)),
            lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, rows))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(
        loss_mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["chars"]))
    )
