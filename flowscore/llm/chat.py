"""Chat formatting with a declarative template, in DataFrame expressions only.

A finite-state machine over roles checks the order of turns. The output is a
list of text segments, each with a flag that says whether it is trained on;
joined, they are the formatted text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles are trained on, which orders are valid.

    ``moves`` maps a state to the roles it allows; the state after a turn is
    its role. ``start`` is the state before the first turn.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )


# Control strings begin with "<|". Codes of a backslash, of "<|", of a line end.
CODES = (("\\", "\\b"), ("<|", "\\c"), ("\n", "\\n"))


def escaped(text: Column, line_ends: bool = False) -> Column:
    """Text without control strings; ``unescaped`` gives the text back."""
    for plain, code in CODES if line_ends else CODES[:2]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _first_invalid(turns: Column, template: Template) -> Column:
    """Number of the first turn that the machine does not allow, else null."""
    pairs = [F.lit(f"{state}\n{role}") for state, roles in template.moves.items() for role in roles]
    allowed = F.array(*pairs)
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(0).alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        n = acc["n"] + 1
        fits = F.array_contains(allowed, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        bad = F.when((acc["bad"] == 0) & ~fits, n).otherwise(acc["bad"])
        return F.struct(turn["role"].alias("state"), n.alias("n"), bad.alias("bad"))

    return F.aggregate(turns, start, step, lambda acc: F.nullif(acc["bad"], F.lit(0)))


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, formatted, segments, first_invalid`` for each conversation.

    ``rows`` has ``conv_id, turn, role, text``. Turns are in the order of
    ``turn`` (null first), rows of one turn by role and text. Null role and
    text are empty. ``segments`` is an array of ``text, loss``; ``formatted``
    is their texts joined. ``first_invalid`` is the number (from 1) of the
    first turn out of order, null if there is none; such conversations are
    formatted too. A null conv_id is a conversation of its own. Repeated rows
    are repeated turns. Other columns are ignored; no rows give no rows. A
    conversation is one output row, so its turns meet in one task.
    """
    template = template or Template()
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id")
    chats = chats.agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def parts(t: Column) -> Column:
        head = F.concat(
            F.lit(template.open), escaped(t["role"], line_ends=True), F.lit("\n")
        )
        loss = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.close + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.flatten(F.transform("turns", parts))
    out = chats.select(
        "conv_id", segments.alias("segments"), _first_invalid(F.col("turns"), template).alias("first_invalid")
    )
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", joined.alias("formatted"), "segments", "first_invalid")


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (``role, text``) that a formatted text was made of."""
    template = template or Template()
    mark = "".join("\\" + c if c in "|<>" else c for c in template.open)
    pieces = F.filter(F.split(formatted, mark, -1), lambda p, i: i > 0)
    tail = len(template.close) + 1

    def turn(p: Column) -> Column:
        head = F.instr(p, "\n")
        body = F.substring(p, head + 1, F.length(p) - head - tail)
        return F.struct(
            unescaped(F.substring(p, F.lit(1), head - 1)).alias("role"),
            unescaped(body).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text that is trained on, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescaped(s["text"])), "")
