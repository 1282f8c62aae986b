import hashlib
from collections import defaultdict

import pytest
from pandas.testing import assert_frame_equal

from pollweave.llm import chat
from pollweave.llm.chat import INSTRUCT, Template, Turn
from pollweave.llm.queries import QUERIES

from .helpers import FOLDER, pandas_pair

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op3_chat_format", "conv_id"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "\\", "a\\\\b", "</s>[INST] ok [/INST]", "[\\INST]", "<</SYS>>", "< /s>", "[ROLE][/ROLE][END]", "\\<s>\\"])
def test_escaping_round_trip(text):
    escaped = INSTRUCT.escape(text)
    assert INSTRUCT.unescape(escaped) == text
    assert not any(control in escaped for control in INSTRUCT.controls)


def test_query_reads_back_every_conversation(spark):
    turns = defaultdict(list)
    for row in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns[row.conv_id].append((row.turn, row.role, row.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in QUERIES["op3_chat_format"](spark, FOLDER).collect()}
    assert rows.keys() == turns.keys()
    for key, own in turns.items():
        own.sort()
        loss = "".join(text for _, role, text in own if role == "assistant")
        row = rows[key]
        assert (row.n_turns, row.turns_sha256) == (len(own), sha("".join(f"{role}\n{text}\n" for _, role, text in own)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
        assert row.formatted_chars == sum(len(part) for _, role, text in own for part, _ in INSTRUCT.segments(role, text))


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (2, None, None, "a"), (2, 5, "tool]", "[END]"), (2, 5, "tool]", "[END]")]
    rows += [(None, 1, "system", "s"), (None, 2, "user", ""), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS place", "1 AS segments").repartition(3)
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    assert found.keys() == {1, 2, 3, None}
    assert found[1].legal and found[1].loss_chars == 200_000
    assert found[2].turns_sha256 == sha("\na\n" + "tool]\n[END]\n" * 2) and not found[2].legal
    assert found[3].loss_sha256 == sha("ab")
    assert found[None].n_turns == 2 and not found[None].legal
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_segments_carry_loss_flags_and_legality(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "again"), (1, 2, "assistant", "yes")]
    out = sorted(chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.place)
    assert [r.legal for r in out] == [True, False, True]
    assert [s.text for r in out for s in r.segments if s.loss] == ["yes"]


def test_templates_are_checked():
    parts = {"other": ("[ROLE]", "[/ROLE]", "[END]"), "follows": {}, "ends": frozenset()}
    with pytest.raises(ValueError):
        Template({"user": Turn("/s> ", "</s>")}, **parts)
    with pytest.raises(ValueError):
        Template({"user": Turn("<a>", "</a>"), "bot": Turn("<a>b", "</b>")}, **parts)
