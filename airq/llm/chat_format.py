"""Chat formatting by a declarative template and a finite-state machine over roles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Turns that are put together before the parts of a conversation meet.
PART = 256

#: Control strings of common chat formats, fixed values: a text that holds one is escaped too.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
           "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles under the loss, legal moves (state -> role -> next state), end states, and the escape.

    In texts and roles an escape character is doubled, and each control string is broken by escape + filler after its
    first character, so no control string is left in them and the change can be undone.
    """
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    begin: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"}})
    ends: tuple[str, ...] = ("answered",)
    foreign: tuple[str, ...] = FOREIGN
    escape: str = "␛"
    filler: str = "."

    def __post_init__(self) -> None:
        for control in self.controls:
            if len(control) < 2 or self.escape in control or control.startswith(self.filler):
                raise ValueError(f"{control!r} cannot be a control string")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.foreign)

    def escaped(self, column: Column) -> Column:
        doubled = F.replace(column, F.lit(self.escape), F.lit(self.escape * 2))
        any_control = "|".join(f"\\Q{c}\\E" for c in self.controls)
        return F.regexp_replace(doubled, f"(?s)(?=(?:{any_control}))(.)", f"$1{self.escape}{self.filler}")

    def unescaped(self, column: Column) -> Column:
        return F.regexp_replace(column, f"{self.escape}(?:({self.escape})|{re.escape(self.filler)})", "$1")


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, valid, n_legal, segments, formatted), one row per conversation.

    Turns are put in order of (turn, role, text), nulls first. ``segments`` are (text, loss) in order: the head of a
    turn, its escaped text, which is under the loss where the role is, and its end; ``formatted`` is their
    concatenation. ``n_legal`` counts the turns before the first that the machine refuses, ``valid`` says that all are
    legal and the machine stops in an end state. Conversations that are not valid are formatted all the same.

    A null role or text is an empty one (no legal role), repeated rows are turns of their own, and rows without conv_id
    are one conversation. An empty table gives no rows. Further columns are not read. A conversation's row holds its
    whole text, so its parts are put together first and only parts meet.
    """
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw"))
    part = rows.withColumn("text", template.escaped(F.col("raw"))).groupBy("conv_id", F.floor(F.col("turn") / PART).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "raw", "text"))).alias("turns"))
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "turns"))).alias("parts")).select(
        "conv_id", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"))

    moves = [F.lit(x) for state, roles in template.moves.items() for role, to in roles.items() for x in (f"{state}\n{role}", to)]
    table = F.create_map(*moves)
    begin = F.struct(F.lit(template.begin).cast("string").alias("state"), F.lit(0).cast("long").alias("legal"))

    def move(at: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(at["state"], F.lit("\n"), turn["role"]))
        return F.struct(F.coalesce(to, F.lit("")).alias("state"), (at["legal"] + to.isNotNull().cast("long")).alias("legal"))

    def segments(turn: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.turn), template.escaped(turn["role"]), F.lit(template.text))
        return F.array(segment(head, F.lit(False)), segment(turn["text"], turn["role"].isin(*template.loss_roles)),
                       segment(F.lit(template.end), F.lit(False)))

    run = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", begin, move).alias("run"),
                       F.flatten(F.transform("turns", segments)).alias("segments"))
    return run.select("conv_id", "n_turns", F.col("run.state").isin(*template.ends).alias("valid"), F.col("run.legal").alias("n_legal"),
                      "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: DataFrame, template: Template = Template(), *carried: str) -> DataFrame:
    """(conv_id, turns, loss_text) from segments and formatted text alone: the turns' roles and texts, and what is learned.

    ``carried`` names columns that come along.
    """
    pieces = F.split("formatted", f"\\Q{template.turn}\\E", -1)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, f"\\Q{template.text}\\E", -1)
        text = F.split(F.get(halves, F.lit(1)), f"\\Q{template.end}\\E", -1)
        return F.struct(template.unescaped(F.get(halves, F.lit(0))).alias("role"), template.unescaped(F.get(text, F.lit(0))).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    return formatted.select("conv_id", F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn).alias("turns"),
                            F.array_join(loss, "").alias("loss_text"), *carried)
