"""Chat formatting against plain Python: every example whole, masks, segments of long conversations, odd rows."""

import re

import pytest
from conftest import SMALL

from markfield.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", None), (1, 1, "assistant", "<\\s> </s>"), (1, 2, "user", "tail [INST]"), (1, 1, "assistant", "<\\s> </s>"),
    (2, 0, None, "<|end|>"), (None, 0, "assistant", "x"), (None, None, "user", ""), (3, 5, "assistant", "<|body|>\\<|turn|>"), (3, 6, "assistant", ""),
    *[(4, i, ("user", "assistant")[i % 2], f"turn {i} <\\|end|> " + "é" * (i % 7)) for i in range(60)],
]


def escaped(s):
    return re.sub(chat.ESCAPE, r"\1\2\\\3", s)


def whole(rows):
    """conv_id -> list of (text, loss or None), every context whole."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        text, examples = "", []
        for n, (*_, role, said) in enumerate(turns):
            text += f"{chat.TURN}{escaped(role)}{chat.BODY}{escaped(said)}{chat.END}"
            if role == "assistant" or n == len(turns) - 1:
                examples.append((text, escaped(said) if role == "assistant" else None))
        out[c] = examples
    return out


@pytest.mark.parametrize("segment", [chat.SEGMENT, 200])
def test_every_example_is_whole(spark, segment):
    told = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as at", "2 as example", "'x' as parts", "3 as first")
    got = {}
    for r in sorted(chat.prefix_examples(told, segment=segment).collect(), key=lambda r: r.example):
        got.setdefault(r.conv_id, []).append(r)
    want = whole(ROWS)
    assert set(got) == set(want)
    for c, examples in want.items():
        before = ""
        for r, (text, loss) in zip(got[c], examples, strict=True):
            assert before + r.text == text and r.skipped == len(before)
            assert (None if r.loss_start is None else r.text[r.loss_start : r.loss_start + r.loss_length]) == loss
            before += r.text if r.closes else ""
        assert before == examples[-1][0]
    assert (max(len(r.text) for r in got[4]) < 400) == (segment == 200)
    assert all(r.skipped == 0 for r in got[4]) == (segment == chat.SEGMENT)


@pytest.mark.parametrize("segment", [chat.SEGMENT, 150])
def test_round_trip(spark, segment):
    back = {r.conv_id: r for r in chat.read_back(chat.prefix_examples(spark.createDataFrame(ROWS, SCHEMA), segment=segment)).collect()}
    for c in back:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in ROWS if r[0] == c)
        assert [tuple(t) for t in back[c].turns] == [t[2:] for t in turns]
        assert back[c].loss_text == "".join(t[3] for t in turns if t[2] == "assistant")


def test_long_conversation_and_empty(spark):
    long = spark.range(4000).selectExpr("7L as conv_id", "id as turn", "case when id % 2 = 1 then 'assistant' else 'user' end as role", "repeat('word ', 60) as text")
    r = chat.read_back(chat.prefix_examples(long, segment=1 << 16)).first()
    assert (len(r.turns), r.n_examples, r.formatted_chars) == (4000, 2000, 4000 * (300 + 23) + 2000 * (4 + 9))
    assert r.example_chars < 2000 * ((1 << 16) + 1000)
    assert chat.read_back(chat.prefix_examples(long.limit(0))).count() == 0


def test_long_conversations_are_expanded_whole(spark, same_as_sql, tmp_path):
    import os

    for name in os.listdir(SMALL):
        if name != "conversations.parquet":
            (tmp_path / name).symlink_to(f"{SMALL}/{name}")
    told = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    long = spark.range(80).selectExpr("9000001L as conv_id", "id as turn", "case when id % 2 = 1 then 'assistant' else 'user' end as role", "repeat('word ', 4000) as text")
    made = tmp_path / "made"
    told.unionByName(long.select(*(long[c].cast(told.schema[c].dataType) for c in told.columns))).coalesce(1).write.parquet(str(made))
    next(made.glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    out = chat.op2_chat_formatting(spark, str(tmp_path))
    assert same_as_sql(out, chat.OP2_SQL, str(tmp_path)) > 2
    r = out.where("conv_id = 9000001").first()
    assert r.formatted_chars > chat.SEGMENT and r.example_chars > 20 * chat.SEGMENT
