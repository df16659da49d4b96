"""Message envelopes: (key, value, offset, timestamp) rows of a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_messages(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Envelope columns plus the typed fields of the JSON value.

    Works on batch and streaming frames alike.  A value that is not JSON gives NULL fields.
    """
    return df.select(
        F.col("key").cast("string").alias("_kafka_key"),
        F.col("offset").alias("_kafka_offset"),
        F.col("timestamp").alias("_kafka_timestamp"),
        F.from_json(F.col("value").cast("string"), schema).alias("_data"),
    ).select("_kafka_key", "_kafka_offset", "_kafka_timestamp", "_data.*")


def read_topic(spark: SparkSession, options: dict, *, stream: bool = False) -> DataFrame:
    """A topic through Spark's Kafka connector, which must be on the class path.

    ``maxOffsetsPerTrigger`` among the options caps each micro-batch.
    """
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**options).load()
