"""Chat formatting in DataFrame functions only.

A declarative ``Template`` names the control strings, the roles whose texts are learned, and a finite
state machine over roles. Each conversation's turns run through the machine in turn order and become
text segments, each with a loss flag; the formatted text is the segments' concatenation.

Roles and texts are escaped so that no control string can arise inside them: the escape character is
doubled, and put after the first character of every control string. ``parse`` undoes both.

Scale: one shuffle by conversation (a conversation's text is one value, so its turns meet in one
row; a conversation must fit in memory, conversations are independent). Ties: equal turn numbers are
ordered by role, then text. Null roles and texts are empty; a null conv_id is a conversation; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    turn_open: str = "<s>[ROLE]"
    text_open: str = "[INST]"
    turn_close: str = "[/INST]</s>"
    #: Every string that a tokenizer would treat as control, those above in parts.
    control: tuple[str, ...] = ("<s>", "</s>", "[ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state. Any other step is an error and stays one.
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def _escaped(text: Column, t: Template) -> Column:
    doubled = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    # A control string's first character is parted from the rest; the rest must follow, so overlapping ones are all met.
    first = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(t.control, key=len, reverse=True))
    return F.regexp_replace(doubled, f"({first})", "$1" + (t.escape * 2 if t.escape == "\\" else t.escape))


def _plain(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(t.escape)}(.)", "$1")


def _state(roles: Column, t: Template) -> Column:
    steps = F.create_map(*[F.lit(x) for (state, role), to in t.steps.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit(t.start), lambda s, r: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\n"), r)), F.lit("error")))


def format_chat(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn, role, text) rows to conv_id, state, valid, segments (array of text and loss), formatted."""
    t = template
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(x: Column) -> Column:
        head = F.concat(F.lit(t.turn_open), _escaped(x["role"], t), F.lit(t.text_open))
        return F.array(segment(head, F.lit(False)), segment(_escaped(x["text"], t), x["role"].isin(*t.learned)), segment(F.lit(t.turn_close), F.lit(False)))

    out = grouped.select(
        "conv_id",
        _state(F.transform("turns", lambda x: x["role"]), t).alias("state"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    )
    return out.withColumns({"valid": F.col("state").isin(*t.accepting), "formatted": F.array_join(F.transform("segments", lambda s: s["text"]), "")})


def parse(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Back from the output: ``formatted`` plus turns (array of role and text, from the formatted text) and learned (unescaped text under the loss flags)."""
    t = template

    def turn(x: Column) -> Column:
        cut = F.split(F.replace(x, F.lit(t.turn_close), F.lit("")), re.escape(t.text_open), -1)
        return F.struct(_plain(cut[0], t).alias("role"), _plain(cut[1], t).alias("text"))

    parts = F.split("formatted", re.escape(t.turn_open), -1)
    return formatted.withColumns(
        {
            "turns": F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn),
            "learned": F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _plain(s["text"], t)), ""),
        }
    )
