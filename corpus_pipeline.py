"""From raw documents to token ids: five stages, each one operator of ``stratiform.llm``.

A stage takes (spark, docs, folder) and works on all rows its predecessor kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm.bpe import encode
from stratiform.llm.minhash import without_near_duplicates
from stratiform.llm.mixing import mix, take
from stratiform.llm.pii import pseudonymise
from stratiform.llm.queries import SECRET
from stratiform.llm.toxicity import fit, score
from stratiform.session import materialise

RANKS = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the graded model does not reject."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    graded = score(docs, fit(docs, labels), names=("__severity", "__p_toxic", "__rejected"))
    return graded.where(~F.col("__rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word runs."""
    return without_near_duplicates(docs).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the new text."""
    clean = pseudonymise(docs, SECRET, found_as="__pii_found").select(*docs.columns)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at their target shares: a document occurs as often as the mix takes it."""
    return take(docs, mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, checked by decoding them again."""
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    return encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: A fitted model, signatures and merges are not SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``, each written before the next reads it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
