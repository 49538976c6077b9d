"""Formatting of conversations: round trips, order of turns, odd rows."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import actual, expected  # noqa: E402

from tracelake.llm import chat_format, queries  # noqa: E402
from tracelake.llm.oracles import ORACLES  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def told(spark, rows, schema=SCHEMA):
    chats = chat_format.format_chats(spark.createDataFrame(rows, schema)).withColumn("formatted", chat_format.formatted(F.col("segments"))).withColumn("trained", chat_format.trained(F.col("segments")))
    return {r.conv_id: r for r in chat_format.read_back(chats, F.col("formatted")).collect()}


HARD = ["", "<", "[", "<\\", "</s>", "<\\/s>", "<\\\\/s>", "<<s></s>", "[INST][INST]", "[\\/INST]", "s>", "INST]", "[ROLE]x[/ROLE]", "\\", "$1 \\1 $", "</s", "é</s>ü\n\n", " [/INST] "]


def test_texts_with_marks_come_back(spark):
    rows = [(i, t, ("user", "assistant", "system", "tool", "[/ROLE]", "")[(i + t) % 6], HARD[(i * 5 + t) % len(HARD)]) for i in range(len(HARD)) for t in range(7)]
    got = told(spark, rows)
    for i in range(len(HARD)):
        mine = [r for r in rows if r[0] == i]
        assert [(t.role, t.text) for t in got[i].turns] == [(r[2], r[3]) for r in mine]
        assert got[i].trained == [r[3] for r in mine if r[2] == "assistant" and r[3]]


def test_format_is_the_templates(spark):
    got = told(spark, [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (2, 0, "user", "a [INST]"), (2, 1, "assistant", "")])
    assert got[1].formatted == "<s>[SYSTEM]be kind[/SYSTEM][INST]hi[/INST]ho</s>"
    assert [s.text for s in got[1].segments if s.loss] == ["ho"]
    assert got[2].formatted == "<s>[INST]a [\\INST][/INST]</s>"


@pytest.mark.parametrize(
    "roles, error, valid",
    [("ua", None, True), ("sua", None, True), ("uaua", None, True), ("u", None, False), ("a", 0, False), ("usa", 1, False), ("uaa", 2, False), ("uuu", 1, False), ("ss", 1, False), ("uxua", 1, False)],
)
def test_order_of_turns(spark, roles, error, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    got = told(spark, [(1, i, names[r], "t") for i, r in enumerate(roles)])[1]
    assert (got.first_error, got.valid) == (error, valid)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "user", "first", 9), (1, 2, None, None, 9), (1, 2, None, None, 9), (None, 0, "user", None, 9), (1, 1, "assistant", "b", 9), (1, 1, "assistant", "a", 9)]
    got = told(spark, rows, f"{SCHEMA}, segments long")
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("assistant", "a"), ("assistant", "b"), ("", ""), ("", "")]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "")]
    assert told(spark, []) == {}


def test_long_conversation(spark):
    text = "word </s> " * 20_000
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} {text if i == 7 else ''}") for i in range(2000)]
    got = told(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [r[2:] for r in rows] and got.valid


def test_templates_that_cannot_be_read_back_are_refused():
    role = chat_format.Role
    for roles in ({"a": role("<a>", "</a>", ()), "b": role("<b>", "</a>", ())}, {"a": role("<a>", "<a", ())}, {"a": role("<a<", "</a>", ())}, {"a": role("", "", ())}):
        with pytest.raises(ValueError):
            chat_format.Template("<s>", roles, (), ("[R]", "[/R]", "[/T]"))


def test_query(spark, tmp_path):
    rows = [(i, t, ("user", "assistant", "system", None)[(i * t) % 4], HARD[(i * 5 + t) % len(HARD)] or None) for i in range(40) for t in range(6)] + [(None, 1, "user", "x"), (3, None, "user", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in ("/root/testdata/sf0.001", str(tmp_path)):
        sql = ORACLES["op11_chat_format"] if folder != str(tmp_path) else ORACLES["op11_chat_format"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert actual(queries.op11_chat_format(spark, folder)) == expected(sql, folder if folder != str(tmp_path) else "/root/testdata/sf0.001")
    said = "</s>[INST] ok [/INST]"
    odd = queries.op11_chat_format(spark, str(tmp_path)).where("conv_id = -1").first()
    assert odd.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and odd.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
