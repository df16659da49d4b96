"""Rule sets on a stream.  Key rules hold across micro-batches, with the result of a batch run.

Two queries read the stream.  One evaluates the row rules of each micro-batch and writes its
rows.  The other counts the keys of the key rules in Spark's state store and writes those that
fail, as soon as they do.  A key that comes again fails the row written before, too: the
verdict on a row is its own failures and those of its keys, joined when it is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.quality import Rule, add_key_failures, evaluate, route
from ..operators.sinks import overwrite_partitions, read_if_exists
from ..session import materialise
from .ingest import run_available

BATCH = "_stream_batch"


def _key_rules(rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if r.enabled and r.keys]


def running_keys(stream: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The state of every key of every key rule: (rule_id, k0.., n, lo0.., hi0..).

    One streaming aggregate for all rules: a row counts once per rule, under a struct of that
    rule's key columns; the structs of the other rules are NULL.  Rows are counted before they
    are shuffled, so a hot key costs one row per task.  The state holds each key once, and
    the smallest and largest owner where a rule asks for owners; it grows with the keys.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    own = _key_rules(rules)

    def key_struct(r: Rule) -> Column:
        return F.struct(*[F.col(c).alias(c) for c in r.keys])

    def entry(r: Rule) -> Column:
        fields = [F.lit(r.rule_id).alias("rule_id")]
        for i, other in enumerate(own):
            mine = other is r
            key = key_struct(r) if mine else F.when(F.lit(False), key_struct(other))
            fields.append(key.alias(f"k{i}"))
            if other.owner:
                owner = F.col(other.owner) if mine else F.lit(None)
                fields.append(owner.cast(kinds[other.owner]).alias(f"o{i}"))
        found = F.struct(*fields)
        return F.when(~P.is_blank(r.keys[0]), found) if r.owner else found

    entries = F.explode(F.array_compact(F.array(*map(entry, own))))
    flat = stream.select(entries.alias("e")).select("e.*")
    seen = [F.count(F.lit(1)).alias("n")]
    for i, r in enumerate(own):
        if r.owner:
            seen += [F.min(f"o{i}").alias(f"lo{i}"), F.max(f"o{i}").alias(f"hi{i}")]
    return flat.groupBy("rule_id", *(f"k{i}" for i in range(len(own)))).agg(*seen)


def _fails(rules: Sequence[Rule]) -> Column:
    bad = F.lit(False)
    for i, r in enumerate(_key_rules(rules)):
        test = F.col(f"lo{i}") != F.col(f"hi{i}") if r.owner else F.col("n") > 1
        bad = bad | ((F.col("rule_id") == r.rule_id) & F.coalesce(test, F.lit(False)))
    return bad


def evaluate_stream(
    stream: DataFrame,
    rules: Sequence[Rule],
    path: str,
    checkpoint: str,
    tables: Mapping[str, DataFrame] | None = None,
) -> None:
    """Process what is there: ``path/rows`` and ``path/keys``, partitioned by micro-batch.

    ``stream`` must be deterministic, as both queries read it.  A replayed micro-batch
    replaces its own partition.  Foreign-key and cross-table rules see the static ``tables``.
    """
    apart = [r for r in rules if not r.keys]

    def rows(batch: DataFrame, number: int) -> None:
        found = evaluate(batch, apart, tables)
        found.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={number}")

    def keys(batch: DataFrame, number: int) -> None:
        failing = batch.where(_fails(rules)).drop("n")
        failing.write.mode("overwrite").parquet(f"{path}/keys/{BATCH}={number}")

    run_available(stream, rows, f"{checkpoint}/rows")
    if _key_rules(rules):
        run_available(running_keys(stream, rules), keys, f"{checkpoint}/keys", "update")


def _bad_keys(found: DataFrame, rules: Sequence[Rule]) -> dict[str, DataFrame]:
    own = enumerate(_key_rules(rules))
    return {r.rule_id: found.where(F.col("rule_id") == r.rule_id).select(f"k{i}.*").distinct() for i, r in own}


def read_evaluated(spark: SparkSession, path: str, rules: Sequence[Rule]) -> DataFrame:
    """All rows with everything they fail, as of what both queries have processed."""
    rows = spark.read.parquet(f"{path}/rows")
    found = read_if_exists(spark, f"{path}/keys")
    if found is None:  # no key rule, or its query has not run yet
        return rows
    return add_key_failures(rows, rules, _bad_keys(found, rules))


def conform_stream(
    stream: DataFrame,
    rules: Sequence[Rule],
    rule_version: str,
    as_of,
    clean_path: str,
    rejects_path: str,
    checkpoint: str,
    tables: Mapping[str, DataFrame] | None = None,
) -> None:
    """Evaluate what is there, then bring the clean rows and the rejects up to date."""
    staged = f"{checkpoint}/staged"
    evaluate_stream(stream, rules, staged, checkpoint, tables)
    publish(stream.sparkSession, staged, rules, rule_version, as_of, clean_path, rejects_path)


def publish(
    spark: SparkSession,
    staged: str,
    rules: Sequence[Rule],
    rule_version: str,
    as_of,
    clean_path: str,
    rejects_path: str,
) -> list[int]:
    """Route the staged rows into two tables; returns the micro-batches that were written.

    Written are the micro-batches that are new, and those with rows whose key has begun to
    fail since the last call: such a row leaves the clean table.  The staged rows are never
    changed.  What has been published is noted last, so a call that was cut off is repeated
    by the next one; a micro-batch whose rows are all clean, or all rejected, leaves an
    empty partition rather than old rows.  Only numbers of micro-batches reach the driver.
    """
    noted = read_if_exists(spark, f"{staged}/published")
    last = noted.agg(F.max("rows"), F.max("keys")).first() if noted is not None else (-1, -1)

    def newest(df: DataFrame, before: int) -> int:
        found = df.agg(F.max(BATCH)).first()[0]
        return before if found is None else max(found, before)

    rows = spark.read.parquet(f"{staged}/rows")
    keys = read_if_exists(spark, f"{staged}/keys")
    old, touched = rows.where(F.col(BATCH) <= last[0]), set()
    done = (newest(rows, last[0]), last[1] if keys is None else newest(keys, last[1]))
    if keys is not None:
        late = _bad_keys(keys.where(F.col(BATCH) > last[1]), rules)
        for r in _key_rules(rules):
            same = [old[c].eqNullSafe(late[r.rule_id][c]) for c in r.keys]
            hit = old.join(late[r.rule_id], same, "left_semi").select(BATCH).distinct()
            touched |= {x[0] for x in hit.collect()}
    fresh = rows.where(F.col(BATCH) > last[0]).select(BATCH).distinct().collect()
    numbers = sorted(touched | {x[0] for x in fresh})
    if numbers:
        evaluated = read_evaluated(spark, staged, rules).where(F.col(BATCH).isin(numbers))
        routed = route(materialise(evaluated, "stream-evaluated"), rule_version, as_of)
        for out, path in zip(routed, (clean_path, rejects_path)):
            _replace(out, path, numbers)
    note = spark.createDataFrame([done], "rows int, keys int")
    note.coalesce(1).write.mode("append").parquet(f"{staged}/published")
    return numbers


def _replace(out: DataFrame, path: str, numbers: Sequence[int]) -> None:
    """Put ``out`` in place of the partitions ``numbers``, also of those it has no rows of."""
    overwrite_partitions(out, path, [BATCH])
    held = {r[0] for r in out.select(BATCH).distinct().collect()}
    for n in sorted(set(numbers) - held):
        empty = out.where(F.lit(False)).drop(BATCH)
        empty.write.mode("overwrite").parquet(f"{path}/{BATCH}={n}")
