import random

import pytest
from pyspark.sql import functions as F

from scenewright.llm import chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<sep>", "[ROLE]", "[/ROLE]", "[/END]"]


def by_hand(turns):
    """The formatted string of (role, text) turns, character by character."""

    def safe(text):
        out, i = "", 0
        while i < len(text):
            out += text[i]
            if text[i] in "<[":
                k = i + 1
                while k < len(text) and text[k] == "\\":
                    k += 1
                if any(text.startswith(c[1:], k) for c in CONTROLS):
                    out += text[i + 1 : k] + "\\"
                    i = k - 1
            i += 1
        return out

    out, last = "<s>", None
    for i, (role, text) in enumerate(turns):
        before, after = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n"), "assistant": (" ", "</s>")}.get(
            role, ("[ROLE]" + safe(role) + "[/ROLE]", "[/END]")
        )
        out += ("<sep>" if role == last else before) + safe(text)
        last = role
        if i + 1 == len(turns) or turns[i + 1][0] != role:
            out += after
    return out


def read_back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string").repartition(3)
    told = chat.format_chats(df)
    out = told.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt"))
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_random_conversations(spark):
    draw = random.Random(12)
    parts = [*CONTROLS, "<\\s>", "<\\\\/s>", "[\\/INST]", "<", "[", "\\", "\\\\", "/", "s>", "INST]", " ", "\n", "", "é", "漢", "🙂", "$1", "a", "</S>"]
    rows, want = [], {}
    for c in range(250):
        turns = []
        for t in range(draw.randrange(1, 9)):
            role = draw.choice(["user", "assistant", "system", "tool", "[/ROLE]", ""])
            turns.append((role, "".join(draw.choices(parts, k=draw.randrange(7)))))
            rows.append((c, t, *turns[-1], "x"))
        want[c] = turns
    got = read_back(spark, draw.sample(rows, len(rows)))
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert r.formatted == by_hand(turns), (turns, r.formatted)
        assert [(x.role, x.text) for x in r.turns] == turns
        assert r.learnt == "".join(t for role, t in turns if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.blocks == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))


def test_nulls_ties_long_texts_and_empty_tables(spark):
    long = "</s>" * 200_000 + "<" + "\\" * 100_000 + "s>"
    rows = [(None, None, None, None, "x"), (None, 1, "user", "b", "x"), (None, 1, "user", "a", "x"), (None, 1, "user", "a", "x"), (7, 0, "assistant", long, "x")]
    rows += [(8, t, "user" if t % 2 else "assistant", str(t), "x") for t in range(3000)]
    got = read_back(spark, rows)
    assert [(x.role, x.text) for x in got[None].turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(x.role, x.text) for x in got[7].turns] == [("assistant", long)] and got[7].learnt == long
    assert [x.text for x in got[8].turns] == [str(t) for t in range(3000)] and got[8].learnt == "".join(str(t) for t in range(0, 3000, 2))
    assert read_back(spark, [])== {}


@pytest.mark.parametrize("text", ["plain", "a < b [1]", "C:\\dir", "<div>", "[inst]"])
def test_texts_without_control_strings_stay_as_they_are(spark, text):
    assert spark.range(1).select(chat.escaped(F.lit(text)).alias("x")).first().x == text
