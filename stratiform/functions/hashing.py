"""Row hashes and content ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(columns: Iterable[str], mode: str = "strict") -> Column:
    """SHA-256 over the values of ``columns``.

    ``compat`` joins the values with ``|`` and skips NULLs, so rows that differ only in
    where a NULL stands share a hash.  ``strict`` marks NULLs and prefixes lengths, which
    keeps such rows apart.
    """
    cols = [F.col(f"`{c}`") for c in columns]
    if mode == "compat":
        return F.sha2(F.concat_ws("|", *cols), 256)
    if mode != "strict":
        raise ValueError(f"unknown row hash mode: {mode}")
    tokens = []
    for c in cols:
        text = c.cast("string")
        tokens.append(
            F.when(c.isNull(), F.lit("-")).otherwise(
                F.concat(F.length(text).cast("string"), F.lit(":"), text)
            )
        )
    return F.sha2(F.concat_ws("|", *tokens), 256)


def chunk_uid(source: Column, number: Column, text: Column) -> Column:
    """Stable id of a text chunk: MD5 of ``source:number:first 50 characters``."""
    return F.md5(F.concat_ws(":", source, number.cast("string"), F.substring(text, 1, 50)))
