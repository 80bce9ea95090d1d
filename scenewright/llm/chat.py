"""Chat formatting by Spark expressions.

A conversation's turns are collected as structs and sorted; runs of turns of one role become one block each, whose
texts are joined with a mark between them, and the blocks are concatenated between the template's marks. Texts that
hold a control string of the template (its first character may be either of < and [, backslashes may follow it) get one
more backslash there, so no text holds a control string and the whole can be read back. All is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The mark before all, and the one between the texts of one block.
BEGIN, BETWEEN = "<s>", "<sep>"
#: What stands before and after a role's block. Other roles stand between OTHER's first two marks.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n"), "assistant": (" ", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/END]")
#: The role whose texts are learnt.
LEARNT = "assistant"

#: The control strings behind their first character, < or [.
_TAILS = r"(/?s>|sep>|</?SYS>>|/?INST\]|/?ROLE\]|/END\])"
_BLOCK = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>\n.*?\n<</SYS>>\n|\[ROLE\].*?\[/ROLE\].*?\[/END\]| .*?</s>"


def escaped(text: Column) -> Column:
    """text without control strings; unescaped() undoes it."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAILS}", r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\{_TAILS}", "$1$2$3")


def _before(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _after(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_chats(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its id, blocks (how many), formatted, and segments, an array of (text, loss) whose
    texts make up `formatted` and whose loss tells what is learnt: an assistant's texts, without the marks.

    Turns stand by turn, null first, then by role and text; repeated rows are turns like others. A null text or role is
    an empty one; a null id is one conversation. An empty table gives no rows; other columns are not read. A
    conversation is one string, so it has to fit into a row (2 GB)."""
    turns = df.select(
        F.col(conversation).alias(conversation),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_turn"),
    )
    told = turns.groupBy(conversation).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    # where blocks begin: turns of another role than the one before
    place = F.sequence(F.lit(0), F.size("_turns") - 1)
    told = told.withColumn("_starts", F.filter(place, lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.coalesce(F.get("_turns", i - 1)["role"], F.lit("")))))
    told = told.withColumn(
        "_blocks",
        F.transform("_starts", lambda at, k: F.slice("_turns", at + 1, F.coalesce(F.get("_starts", k + 1), F.size("_turns")) - at)),
    )

    def segments(block: Column) -> Column:
        of = F.get(block, 0)["role"]
        inner = F.transform(
            block,
            lambda t, i: F.filter(
                F.array(_segment(F.lit(BETWEEN), F.lit(False)), _segment(escaped(t["text"]), t["role"] == LEARNT)), lambda x, j: (i > 0) | (j > 0)
            ),
        )
        return F.concat(F.array(_segment(_before(of), F.lit(False))), F.flatten(inner), F.array(_segment(_after(of), F.lit(False))))

    told = told.withColumn("segments", F.concat(F.array(_segment(F.lit(BEGIN), F.lit(False))), F.flatten(F.transform("_blocks", segments))))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return told.select(conversation, F.size("_blocks").alias("blocks"), formatted.alias("formatted"), "segments")


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order, read from the string alone."""

    def turns(block: Column) -> Column:
        named = F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
        role, before, after = F.lit(LEARNT), F.lit(len(MARKS[LEARNT][0])), F.lit(len(MARKS[LEARNT][1]))
        for name, (x, y) in MARKS.items():
            if name != LEARNT:
                here = F.startswith(block, F.lit(x))
                role = F.when(here, F.lit(name)).otherwise(role)
                before, after = F.when(here, F.lit(len(x))).otherwise(before), F.when(here, F.lit(len(y))).otherwise(after)
        here = F.startswith(block, F.lit(OTHER[0]))
        role = F.when(here, unescaped(named)).otherwise(role)
        before = F.when(here, len(OTHER[0]) + F.length(named) + len(OTHER[1])).otherwise(before)
        after = F.when(here, F.lit(len(OTHER[2]))).otherwise(after)
        inner = F.substring(block, before + 1, F.length(block) - before - after)
        return F.transform(F.split(inner, BETWEEN, -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCK), 0), turns))


def learnt_text(segments: Column) -> Column:
    """All text under the loss, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
