"""Chat formatting with built-in functions: a finite-state check of the roles and text segments with loss flags.

A template is data: for each role what opens and closes its turn and whether its text is learnt; other roles are written
with their name.  A control string inside a text has a backslash put after its first character (one more, if there are some
already), so that no text contains a control string and every text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``turns``: role → (opening, closing, learnt).  All control strings start with a character they contain once."""

    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    between: str = "\n"
    # state → role → next state; the last state of a conversation should be one of ``ends``.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    ends: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        found = [c for opening, closing, _ in self.turns.values() for c in (opening, closing)] + list(self.other)
        return sorted(set(found), key=len, reverse=True)


def _inner(template: Template) -> tuple[str, str]:
    """Patterns of the first characters and of the rests of all control strings."""
    rests = "|".join(re.escape(c[1:]) for c in template.controls())
    return "([" + "".join(sorted({re.escape(c[0]) for c in template.controls()})) + "])", f"(?={rests})"


def escaped(text: Column, template: Template) -> Column:
    first, rest = _inner(template)
    return F.regexp_replace(text, f"{first}(\\\\*){rest}", "$1\\\\$2")


def unescaped(text: Column, template: Template) -> Column:
    first, rest = _inner(template)
    return F.regexp_replace(text, f"{first}\\\\(\\\\*){rest}", "$1$2")


def end_state(roles: Column, template: Template) -> Column:
    """The state after all roles; ``bad`` from the first role that may not follow."""
    steps = [F.lit(x) for state, row in template.moves.items() for role, then in row.items() for x in (f"{state} {role}", then)]
    moves = F.create_map(*steps)
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", s, r)), F.lit("bad")))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, segments, state, valid)``, one row for each conversation of ``turns(conv_id, turn, role, text)``.

    ``segments`` is an array of ``(text, loss)``; their texts joined are the formatted conversation.  Rows go by ``turn`` (null
    first), ties by role and text; repeated rows are repeated turns; null text and null role are empty; null
    ``conv_id`` is a conversation of its own.  Conversations that break the order of roles are formatted too, with state ``bad``.
    """
    template = template or Template()
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def segment(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def written(t: Column) -> Column:
        text, (opening, middle, closing) = escaped(t["text"], template), template.other
        out = F.array(segment(F.concat(F.lit(opening), escaped(t["role"], template), F.lit(middle)), False),
                      segment(text, False), segment(F.lit(closing + template.between), False))
        for role, (opening, closing, learnt) in template.turns.items():
            own = F.array(segment(F.lit(opening), False), segment(text, learnt), segment(F.lit(closing + template.between), False))
            out = F.when(t["role"] == role, own).otherwise(out)
        return out

    state = end_state(F.col("turns.role"), template)
    return chats.select("conv_id", F.flatten(F.transform("turns", written)).alias("segments"), state.alias("state"), state.isin(*template.ends).alias("valid"))


def read_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, formatted, turns, learnt)`` read back from segments: turns as ``(role, text)``, and the learnt texts."""
    template = template or Template()
    either = "|".join(re.escape(c) for c in template.controls())
    marks, parts = F.regexp_extract_all("formatted", F.lit(f"({either})"), F.lit(1)), F.split("formatted", f"(?:{either})", -1)
    rows = chats.withColumn("formatted", F.array_join("segments.text", "")).withColumns({"_marks": marks, "_parts": parts})

    def part(i: Column) -> Column:
        return unescaped(F.get(F.col("_parts"), i), template)

    def read(mark: Column, i: Column) -> Column:
        opening, middle, _ = template.other
        out = F.when(mark == opening, F.struct(part(i + 1).alias("role"), part(i + 2).alias("text")))
        for role, (opening, _, _) in template.turns.items():
            out = F.when(mark == opening, F.struct(F.lit(role).alias("role"), part(i + 1).alias("text"))).otherwise(out)
        return out

    turns = F.filter(F.transform("_marks", read), lambda t: t.isNotNull())
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    return rows.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))
