"""Source dispatch by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import TableSpec
from . import files, jdbc, messages, paged


def _files(spark: SparkSession, spec: TableSpec, cfg: dict) -> DataFrame:
    """Files as they were delivered: their own columns, so that a changed schema is seen."""
    base = cfg["path"].rstrip("/")
    path = f"{base}/{cfg['file']}" if cfg.get("file") else base
    kind = cfg.get("format", "csv")
    if kind == "csv":
        return files.read_csv(spark, path, spec.schema, delimiter=cfg.get("delimiter", ","))
    if kind == "parquet":
        merge = str(cfg.get("options", {}).get("mergeSchema", "false")).lower() == "true"
        return files.read_parquet(spark, path, None, merge)
    if kind == "json":
        return files.read_json_as_delivered(spark, path, spec.schema, cfg.get("multi_line", True))
    raise ValueError(f"Unsupported file format: {kind}")


def _jdbc(spark, spec, cfg):
    return jdbc.read_jdbc(
        spark,
        cfg["url"],
        cfg.get("dbtable", spec.name),
        partition_column=cfg.get("partition_column"),
        bounds=(cfg["lower_bound"], cfg["upper_bound"]) if "lower_bound" in cfg else None,
        num_partitions=cfg.get("num_partitions", 8),
        predicates=cfg.get("predicates"),
        fetch_size=cfg.get("fetch_size", 10_000),
        properties=cfg.get("properties"),
    )


def _api(spark, spec, cfg):
    source = paged.paged_source(
        f"paged_{spec.name}",
        cfg["fetch"],
        spec.schema,
        pages=cfg["max_pages"],  # a full last page fails: there may be more
        page_size=cfg["page_size"],
        response_path=cfg.get("response_path", ""),
    )
    return paged.read_paged(spark, source)


def _kafka(spark, spec, cfg):
    return messages.decode_messages(messages.read_topic(spark, cfg["options"]), spec.schema)


def _table(spark, spec, cfg):
    return files.read_table(spark, cfg.get("table", spec.name))


READERS = {
    "volume": _files,
    "adls": _files,
    "s3": _files,
    "gcs": _files,
    "jdbc": _jdbc,
    "api": _api,
    "kafka": _kafka,
    "delta": _table,
    "table": _table,
}


def read_source(spark: SparkSession, spec: TableSpec, config: dict | None = None) -> DataFrame:
    cfg = {**spec.source, **(config or {})}
    kind = cfg.get("type")
    if kind not in READERS:
        raise ValueError(f"Unsupported source type: {kind}")
    return READERS[kind](spark, spec, cfg)
