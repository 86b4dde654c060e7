"""Formatted conversations read back as they were."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from tallyfold.llm.chat import CONTROLS, digests, escape, format_turn, format_turns, parse, unescape
from tallyfold.llm.queries import QUERIES

PARTS = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "s>", "]", ">", "a", "<\\/s>", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>", "[TEXT]"]) | PARTS, PARTS), max_size=5))
def test_any_turns_round_trip(turns):
    formatted = "".join(format_turn(*t)[0] for t in turns)
    assert [t[:2] for t in parse(formatted)] == turns
    for t in parse(formatted):
        assert unescape(formatted[t.start:t.end]) == t.text


@given(PARTS)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROLS)


def test_plain_text_is_not_escaped():
    assert format_turn("user", "a < b [x] \\n")[0] == "[INST]a < b [x] \\n[/INST]"
    assert format_turn("assistant", "</s>[INST] ok [/INST]")[0] == "<s><\\/s>[\\INST] ok [\\/INST]</s>"


@pytest.mark.parametrize("text", ["x", "[INST]a", "[INST]a</s>", "<s>a<s>b</s>", "[ROLE]r</s>", "[ROLE]r[TEXT]t", "[/INST]"])
def test_what_is_no_conversation_is_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def plain(rows):
    turns = "".join(f"{role or ''}\n{text or ''}\n" for role, text in rows)
    learnt = "".join(text or "" for role, text in rows if role == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_rows_of_all_kinds(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 3, "assistant", ""), (None, None, "user", "<s>"),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "tool\n", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS loss_chars")
    got = {r.conv_id: tuple(r)[1:5] for r in digests(format_turns(df)).collect()}
    assert got == {1: plain([("user", "a"), ("assistant", "b</s>")]), 2: plain([(None, None)]),
                   None: plain([("user", "<s>"), ("assistant", "")]), 3: plain([("assistant", "same")] * 2), 4: plain([("tool\n", "x" * 200_000)])}
    assert digests(format_turns(df.limit(0))).count() == 0


def test_query(spark, sf):
    odd = "</s>[INST] ok [/INST]"
    turns = {-7: [("user", odd), ("assistant", odd)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op8_chat_round_trip"](spark, sf).collect()}
    assert got == {k: plain(v) for k, v in turns.items()}
