from pyspark.sql import functions as F

from stratiform.operators import quality as q
from stratiform.spec import struct
from stratiform.streaming import ingest as st
from stratiform.streaming import rules as sr

SCHEMA = struct("id string, seq long, v string")


def put(spark, path, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_files_are_read_once(spark, rows, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    put(spark, src, [("a", 1, "x")])
    for extra in (None, ("b", 2, "y"), None):
        if extra:
            put(spark, src, [extra])
        st.append_stream(st.stream_files(spark, src, SCHEMA), out, cp)
    assert rows(spark.read.parquet(out), "id") == [("a",), ("b",)]


def test_upsert_over_batches_and_replay(spark, rows, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    put(spark, src, [("a", 5, "new"), ("b", 1, "one"), ("b", 1, "one")])

    def run(checkpoint):
        stream = st.stream_files(spark, src, SCHEMA)
        st.upsert_stream(stream, out, ["id"], ["seq"], str(tmp_path / checkpoint), buckets=2)
        return rows(st.read_upserted(spark, out), "id", "seq", "v")

    assert run("cp") == [("a", 5, "new"), ("b", 1, "one")]
    put(spark, src, [("a", 4, "late"), ("b", 2, "two"), ("c", 1, "c")])
    want = [("a", 5, "new"), ("b", 2, "two"), ("c", 1, "c")]
    assert run("cp") == want
    # A new checkpoint replays every file; the table stays as it is.
    assert run("again") == want


def test_messages_become_typed_columns(spark, rows, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    envelope = struct("key string, value string, offset long, timestamp timestamp")
    rows_in = spark.createDataFrame(
        [("k", '{"id": "a", "seq": 3}', 1), ("k", "not json", 2), (None, None, 3)],
        "key string, value string, offset bigint",
    ).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows_in.write.parquet(src)
    stream = st.bronze_stream(st.stream_files(spark, src, envelope), struct("id string, seq long"))
    st.append_stream(st.dedupe_offsets(stream, ["_kafka_offset"]), out, str(tmp_path / "cp"))
    got = spark.read.parquet(out)
    assert rows(got, "_kafka_offset", "id", "seq", "_batch_id") == [
        (1, "a", 3, "streaming"), (2, None, None, "streaming"), (3, None, None, "streaming"),
    ]


def test_rules_on_a_stream(spark, rows, tmp_path):
    src, clean, rejects = (str(tmp_path / n) for n in ("src", "clean", "rejects"))
    put(spark, src, [("a", 1, "x"), ("b", 2, None)])
    rules = [q.not_null_rule("R1", "t", "v")]
    for _ in range(2):
        sr.conform_stream(
            st.stream_files(spark, src, SCHEMA), rules, "v1", "2024-01-01 00:00:00",
            clean, rejects, str(tmp_path / "cp"),
        )
    assert rows(spark.read.parquet(clean), "id") == [("a",)]
    assert rows(spark.read.parquet(rejects), "id", "_rule_id") == [("b", "R1")]


KEY_RULES = [
    q.unique_rule("K1", "t", ["id"]),
    q.not_null_rule("R1", "t", "v", q.MEDIUM),
    q.owner_rule("K2", "t", "v", "seq"),
    q.unique_rule("K3", "t", ["seq", "v"], q.LOW, scope=lambda: F.col("seq") > 1),
]
FILES = [
    [("a", 1, "x"), ("b", 2, "y"), (None, 7, None)],
    [("c", 3, "z"), ("d", 3, "z"), ("e", 4, " ")],
    [("a", 9, "w"), ("f", 2, "y"), ("g", 5, "")],
    [(None, 8, None), ("h", 6, "x"), ("h", 6, "x"), ("i", 4, " ")],
    [("j", 1, "only")],
]


class Arriving:
    """Files that arrive one by one, and the tables that a stream makes of them."""

    def __init__(self, spark, folder):
        self.spark, self.rules = spark, KEY_RULES
        self.path, self.clean, self.rejects, self.cp = (str(folder / n) for n in ("src", "clean", "rejects", "cp"))
        self.seen = []

    def run(self, *files):
        for f in files:
            self.seen += f
            put(self.spark, self.path, f)
        stream = st.stream_files(self.spark, self.path, SCHEMA, max_files_per_trigger=1)
        sr.conform_stream(stream, self.rules, "v1", "2024-01-01 00:00:00", self.clean, self.rejects, self.cp)

    def check(self, rows):
        """Equal to one batch over all that has arrived."""
        whole = q.evaluate(self.spark.createDataFrame(self.seen, SCHEMA), self.rules)
        clean, rejects = q.route(whole, "v1", "2024-01-01 00:00:00")
        for got, want in ((self.clean, clean), (self.rejects, rejects)):
            got = self.spark.read.parquet(got)
            assert set(got.columns) == {*want.columns, "_stream_batch"}
            assert rows(got, *want.columns) == rows(want)
        staged = sr.read_evaluated(self.spark, f"{self.cp}/staged", self.rules)
        assert rows(staged, "id", "seq", "v", "_failed") == rows(whole, "id", "seq", "v", "_failed")


def test_key_rules_hold_across_batches(spark, rows, tmp_path):
    feed = Arriving(spark, tmp_path)
    for files in (FILES[:2], FILES[2:3], FILES[3:]):
        feed.run(*files)
        feed.check(rows)
    assert ("a", 1) not in rows(spark.read.parquet(feed.clean), "id", "seq")
    assert ("a", 1) in rows(spark.read.parquet(feed.rejects), "id", "seq")


def test_replayed_batches_change_nothing(spark, rows, tmp_path):
    feed = Arriving(spark, tmp_path)
    feed.run(*FILES[:4])
    for query in ("rows", "keys"):  # as if the last two micro-batches had been cut off
        for number in (2, 3):
            for name in (f"{number}", f".{number}.crc"):
                (tmp_path / "cp" / query / "commits" / name).unlink(missing_ok=True)
    feed.run()
    feed.check(rows)
    # As if the tables had been published, but not noted: the next call repeats it.
    for note in (tmp_path / "cp" / "staged" / "published").glob("*"):
        note.unlink()
    spark.catalog.clearCache()
    feed.run(*FILES[4:])
    feed.check(rows)


def test_only_batches_with_new_verdicts_are_written(spark, tmp_path):
    feed = Arriving(spark, tmp_path)
    feed.run([("a", 1, "x")], [("b", 2, "y")], [("c", 3, "z")])
    put(spark, feed.path, [("b", 9, "w")])
    stream = st.stream_files(spark, feed.path, SCHEMA, max_files_per_trigger=1)
    staged = f"{feed.cp}/staged"
    sr.evaluate_stream(stream, KEY_RULES, staged, feed.cp)
    at = {r["id"]: r["_stream_batch"] for r in spark.read.parquet(f"{staged}/rows").collect() if r["seq"] < 9}
    wrote = sr.publish(spark, staged, KEY_RULES, "v1", "2024-01-01 00:00:00", feed.clean, feed.rejects)
    assert wrote == sorted([at["b"], 3])
