"""Chat formatting by a finite-state machine over roles, with DataFrame functions only.

A template is declared as data: the transitions between roles, the control strings around a turn,
and the roles whose text is trained on. The machine walks over the roles of a conversation and says
whether the order is one it accepts and where it first is not. Every turn becomes text segments with
a loss flag each. Control strings inside texts are escaped by an escape mark behind their first
character, one more than stands there already, so the output can be parsed and unescaped again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``moves`` are (state, role, next state). Control strings begin with a character that they hold once."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>\n"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accepts: tuple[str, ...] = ("assistant",)
    trained: tuple[str, ...] = ("assistant",)
    #: Strings of other templates that must not appear in the output either.
    foreign: tuple[str, ...] = ("[INST]", "[/INST]", "<s>", "</s>", "<|im_start|>", "<|im_end|>")
    mark: str = "~"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        found = tuple(dict.fromkeys(c.strip() for c in (self.turn, self.text, self.end, *self.foreign)))
        for c in found:
            if len(c) < 2 or c[0] in c[1:] or self.mark in c:
                raise ValueError(f"control string {c!r} can't be escaped")
        object.__setattr__(self, "controls", found)

    def escape(self, text: Column) -> Column:
        m = re.escape(self.mark)
        for c in self.controls:
            text = F.regexp_replace(text, f"({re.escape(c[0])})((?:{m})*)({re.escape(c[1:])})", f"$1{self.mark}$2$3")
        return text

    def unescape(self, text: Column) -> Column:
        m = re.escape(self.mark)
        for c in reversed(self.controls):
            text = F.regexp_replace(text, f"({re.escape(c[0])}){m}((?:{m})*)({re.escape(c[1:])})", "$1$2$3")
        return text


def _walk(roles: Column, template: Template) -> Column:
    """struct(state, bad): the last state, and the index of the first turn out of order (-1: none).

    After such a turn the machine goes on in the state that its role leads to elsewhere.
    """
    sep = "\x00"
    table = F.create_map(*[F.lit(x) for s, r, n in template.moves for x in (s + sep + r, n)])
    anywhere = F.create_map(*[F.lit(x) for r, n in {r: n for _, r, n in template.moves}.items() for x in (r, n)])

    def step(at: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(at["state"], F.lit(sep), role))
        return F.struct(
            F.coalesce(to, F.try_element_at(anywhere, role), F.lit("unknown")).alias("state"),
            F.when((at["bad"] < 0) & to.isNull(), at["n"]).otherwise(at["bad"]).alias("bad"),
            (at["n"] + 1).alias("n"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("n"))
    return F.aggregate(roles, start, step)


def format_chats(
    rows: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each conversation: ``segments`` array<struct<text, loss>>, ``formatted`` (their texts
    joined), ``valid`` (the machine accepts the roles) and ``first_bad_turn`` (index, -1: none).

    Turns are in the order of their number (null first); rows with equal numbers are in the order of role and
    text, and repeated rows all count. Null roles and texts are empty; a null conversation is one of
    its own. Turns out of order are formatted all the same. An empty table gives an empty result;
    other columns are ignored. A conversation is one row of the result, so it has to fit a row.
    """
    t = template or Template()
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(t.turn), t.escape(x["role"]), F.lit(t.text)), F.lit(False)),
            part(t.escape(x["text"]), x["role"].isin(*t.trained)),
            part(F.lit(t.end), F.lit(False)),
        )

    walked = grouped.withColumn("walk", _walk(F.transform("turns", lambda x: x["role"]), t)).withColumn("segments", F.flatten(F.transform("turns", segments)))
    return walked.select(
        F.col("conv").alias(conv_col),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((F.col("walk.bad") < 0) & F.col("walk.state").isin(*t.accepts)).alias("valid"),
        F.col("walk.bad").alias("first_bad_turn"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> that a formatted conversation holds."""
    t = template or Template()
    bodies = F.split(formatted, re.escape(t.turn), -1)

    def turn(body: Column) -> Column:
        parts = F.split(body, re.escape(t.text), -1)
        text = F.get(parts, 1)
        return F.struct(
            t.unescape(F.get(parts, 0)).alias("role"),
            t.unescape(F.substring(text, F.lit(1), F.char_length(text) - len(t.end))).alias("text"),
        )

    return F.transform(F.slice(bodies, F.lit(2), F.size(bodies) - 1), turn)


def trained_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
