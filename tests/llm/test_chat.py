"""Formatted conversations are read back whole, whatever their texts hold."""

import pytest
from pyspark.sql import functions as F

from stratiform.llm import chat

NASTY = [
    r"\### Assistant: </turn> ok", "\\", "\\\\", "</turn>\n", "</turn>", "</part>", "####", "###", "<", "/turn>\n",
    "a\\", "", None, "### user: </turn>\n### user: x", "ü😀 \r\n", ": ", "<\\/turn>", "\\#\\#\\#", "$1 \\1", "%3A%25",
]
ROLES = ["user", "assistant", "system", None, "a: b", "%3A", "</turn>\n### x: ", "ассистент", ""]
SHAPE = "conv_id long, turn long, role string, text string"


def read_back(df):
    out = chat.format_chats(df).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), "loss_mask",
    )
    return out.collect()


def test_escapes(spark):
    df = spark.createDataFrame([(t,) for t in NASTY if t is not None], "t string")
    e = df.withColumn("e", chat.escape(F.col("t")))
    assert e.where(chat.unescape(F.col("e")) != F.col("t")).count() == 0
    assert e.where("contains(e, '###') or contains(e, '</turn>') or contains(e, '</part>')").count() == 0


def test_round_trip(spark):
    rows = [(c, i, ROLES[(i * c) % len(ROLES)], NASTY[(i + c) % len(NASTY)]) for c in range(40) for i in range(c)]
    rows += [(100, i, "assistant" if i % 7 < 5 else "user", NASTY[i % len(NASTY)]) for i in range(200)]
    df = spark.createDataFrame(rows, SHAPE).repartition(7).withColumns(
        {n: F.lit(1) for n in ("c", "row", "rows", "r", "e", "formatted")}
    )
    got = {r["conv_id"]: r for r in read_back(df)}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: x[1])
        assert [tuple(t) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == [x[3] or "" for x in own if x[2] == "assistant"]
        for s in r["loss_mask"]:  # no control string is learnt
            span = r["formatted"][s["start"] : s["start"] + s["chars"]]
            assert not any(m in span for m in ("### ", "</turn>", "</part>"))


def test_same_roles_share_a_header(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")]
    (r,) = read_back(spark.createDataFrame(rows, SHAPE))
    assert r["formatted"] == "### user: a</part>b</turn>\n### assistant: c</part>d</turn>\n"
    assert [r["formatted"][s["start"]] for s in r["loss_mask"]] == ["c", "d"]


def test_edges(spark):
    rows = [(None, 1, "user", "x"), (None, 1, "user", "x"), (3, None, "user", "b"), (3, 0, "user", "c"),
            (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "assistant", "word " * 100_000)]
    got = read_back(spark.createDataFrame(rows, SHAPE))
    told = sorted(((r["conv_id"], [t["text"][:5] for t in r["turns"]]) for r in got), key=repr)
    assert told == [(3, ["b", "a", "a", "c"]), (4, ["word "]), (None, ["x"]), (None, ["x"])]
    assert max(len(r["loss"][0]) for r in got if r["loss"]) == 500_000
    assert chat.format_chats(spark.createDataFrame([], SHAPE)).count() == 0


@pytest.mark.parametrize("learn", ["user", "nobody"])
def test_other_roles_can_be_learnt(spark, learn):
    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "ü")], SHAPE)
    (r,) = chat.format_chats(df, learn=learn).collect()
    assert len(r["loss_mask"]) == (learn == "user")
