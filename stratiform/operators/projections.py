"""Column-level operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import row_hash
from ..spec import BRONZE_META, OPEN_END


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BRONZE_META]


def add_metadata(
    df: DataFrame,
    source_file: str | Column,
    batch_id: str,
    *,
    source_type: str | None = None,
    as_of=None,
    hash_mode: str = "strict",
) -> DataFrame:
    """Append the provenance columns.  The hash covers the data columns only."""
    ts = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    new = {
        "_source_file": F.lit(source_file) if isinstance(source_file, str) else source_file,
        "_ingestion_ts": ts,
        "_batch_id": F.lit(batch_id),
        "_row_hash": row_hash(df.columns, hash_mode),
        "_ingestion_date": F.to_date(ts),
    }
    if source_type is not None:
        new["_source_type"] = F.lit(source_type)
    return df.withColumns(new)


def stamp_current(df: DataFrame, as_of, rule_version: str) -> DataFrame:
    """Mark every row as the current version, open from ``as_of`` on."""
    return df.withColumns(
        {
            "effective_start_date": F.lit(as_of).cast("date"),
            "effective_end_date": F.lit(OPEN_END).cast("date"),
            "is_current": F.lit(True),
            "_dq_rule_version": F.lit(rule_version),
        }
    )


def select_as(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Select by ``{new name: column or expression}``."""
    return df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in mapping.items()]
    )


def typed_null(name: str, data_type: str | T.DataType) -> Column:
    return F.lit(None).cast(data_type).alias(name)


def coalesce_priority(candidates: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """First non-null of ``(label, column)`` pairs: its label and its value."""
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(lbl)) for lbl, c in candidates])
    value = F.coalesce(*[F.col(c) for _, c in candidates])
    return label, value


def derive_when(name: str, condition: Column, value: Column, data_type="decimal(18,6)") -> Column:
    """``value`` where ``condition`` holds, else NULL."""
    return F.when(condition, value.cast(data_type)).alias(name)


def pivot_eav(df: DataFrame, key: Sequence[str], name: str, value: str, names: Sequence[str]):
    """(key, name, value) rows to one column per name; the largest value wins.

    Written as conditional maxima, one partial aggregate per map task.
    """
    return df.groupBy(*key).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    )


def unpivot_wide(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key and non-null column."""
    long = df.select(*key, *[F.col(c).cast("string") for c in columns]).unpivot(
        list(key), list(columns), "id_type", "identifier_value"
    )
    return long.filter(F.col("identifier_value").isNotNull())


def conform(
    df: DataFrame, schema: T.StructType, *, on_bad: str = "null", extra: str = "drop"
) -> DataFrame:
    """Bring a frame to ``schema``: order, types, missing columns as NULL.

    A value that does not fit its type becomes NULL (``on_bad="null"``) or raises
    (``"raise"``).  Columns outside the schema are dropped or kept at the end.
    """
    have = set(df.columns)
    out = []
    for f in schema.fields:
        if f.name not in have:
            out.append(typed_null(f.name, f.dataType))
        elif on_bad == "null":
            out.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    if extra == "keep":
        out += [F.col(c) for c in df.columns if c not in schema.names]
    return df.select(*out)


# Column-name patterns and the SQL type each of them proposes, in order.
NAME_TYPES = (
    (r"_(amount|price|rate|value)$", "DECIMAL(18,6)"),
    (r"_date$", "DATE"),
    (r"^is_|_flag$", "BOOLEAN"),
)
DEFAULT_TYPE = "STRING"


def proposed_type(column_name: Column) -> Column:
    return F.coalesce(
        *[F.when(column_name.rlike(p), F.lit(t)) for p, t in NAME_TYPES], F.lit(DEFAULT_TYPE)
    )
