"""The batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import row_hash
from ..operators.sinks import BUCKET, upsert_buckets
from ..operators.windows import latest_per_key
from ..sources.messages import decode_messages


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    *,
    max_files_per_trigger: int | None = None,
    pattern: str | None = None,
    **options,
) -> DataFrame:
    """New files of a folder, each once; the query's checkpoint remembers them."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def bronze_stream(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed, stamped rows from a stream of JSON messages."""
    return decode_messages(messages, schema).withColumns(
        {"_ingestion_ts": F.current_timestamp(), "_batch_id": F.lit("streaming")}
    )


def dedupe_offsets(
    stream: DataFrame, keys: Sequence[str], ts: str = "_kafka_timestamp", delay: str = "1 hour"
) -> DataFrame:
    """Drop messages seen before; state older than ``delay`` is forgotten."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process what is there in micro-batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append to a folder; the file sink commits each micro-batch exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_stream(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
    *,
    buckets: int,
) -> None:
    """Upsert each micro-batch into a bucketed table, newest row per key by ``order``.

    Rows that arrive late do not replace newer ones, whatever batch they come in.  A replayed
    batch finds its rows in the table already and writes nothing, so the result does not
    depend on how often a batch runs.  Only buckets with changes are rewritten.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = latest_per_key(
            batch, keys, [F.desc(c) for c in order], [F.desc(c) for c in batch.columns]
        )
        rows = newest.withColumn("_row_hash", row_hash(newest.columns))
        upsert_buckets(spark, path, rows, keys, buckets=buckets, newest_by=order)

    run_available(stream, each, checkpoint)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)
