"""Chat formatting: a finite-state machine over roles, and segments of text with loss flags from a declarative template.

All of it is DataFrame functions. A template says in which order roles may speak, which marks stand
around a turn and whose texts are learnt. A control string starts with the template's mark; of a text's own marks each
gets one more backslash inside, so that no text holds a control string and every text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How conversations are written.

    before, after_role and after are what stands before a turn's role, between role and text, and after the
    text; line_feed is a line feed inside a role. machine has the roles that each state lets speak and
    the state that follows; START is the first state.
    """

    before: str = "<|im_start|>"
    after_role: str = "\n"
    after: str = "<|im_end|>\n"
    line_feed: str = "<|lf|>"
    learnt: tuple[str, ...] = ("assistant",)
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )


START = "start"
CHATML = Template()
#: What every control string starts with, apart from the line feed after a role.
MARK = "<|"


def escaped(text: Column) -> Column:
    """text with one more backslash inside each of its marks: no MARK is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """The text that escaped() was given."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns array<struct<role, text>> in order of turn, null first, then role and text; nulls are empty.

    A conversation is one row, since it is one text; its turns meet in one task.
    """
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    found = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def states(roles: Column, template: Template = CHATML) -> Column:
    """struct<state, bad_turn>: the machine's state after all roles, and the place from 0 of the first role that it doesn't let speak, after which its state is null."""
    pairs = [x for state, after in template.machine.items() for role, to in after.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    machine = F.create_map(*pairs)
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad_turn"))

    def step(x: Column, role: Column) -> Column:
        state = F.try_element_at(machine, F.concat(x["state"], F.lit("\n"), role))
        bad = F.coalesce(x["bad_turn"], F.when(state.isNull(), x["at"]))
        return F.struct(state.alias("state"), (x["at"] + 1).alias("at"), bad.alias("bad_turn"))

    return F.aggregate(roles, start, step, lambda x: F.struct(x["state"].alias("state"), x["bad_turn"].alias("bad_turn")))


def segments(found: Column, template: Template = CHATML) -> Column:
    """array<struct<text, loss>> of turns: the pieces of the formatted text, one after another, and whether they are learnt."""

    def written(turn: Column) -> Column:
        role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit(template.line_feed))
        pieces = [(F.lit(template.before), F.lit(False)), (role, F.lit(False)), (F.lit(template.after_role), F.lit(False))]
        pieces += [(escaped(turn["text"]), turn["role"].isin(*template.learnt)), (F.lit(template.after), F.lit(False))]
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in pieces))

    return F.flatten(F.transform(found, written))


def formatted(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, segments, formatted (their texts joined), state and bad_turn of every conversation of conversations(conv_id, turn, role, text).

    A conversation that breaks the order of roles is formatted too; bad_turn tells where. Rows without
    a conv_id are one conversation. Repeated rows are turns of their own. An empty table has no rows.
    """
    found = turns(conversations)
    found = found.select("conv_id", segments(F.col("turns"), template).alias("segments"), states(F.col("turns.role"), template).alias("end"))
    return found.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "end.state", "end.bad_turn")


def read_back(text: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.split(text, re.escape(template.before))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.after_role, 1)
        rest = F.substr(part, F.char_length(role) + F.lit(len(template.after_role) + 1))
        end = template.after.removesuffix("\n")
        role = unescaped(F.replace(role, F.lit(template.line_feed), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(F.substring_index(rest, end, 1)).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def digests(found: DataFrame, template: Template = CHATML) -> DataFrame:
    """Counts and digests of the turns and of what is learnt, read back from what formatted() returns."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    read = found.select(
        "conv_id", "formatted", "bad_turn",
        read_back(F.col("formatted"), template).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"])), "").alias("learnt"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        sha(F.col("learnt")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("bad_turn").isNull().alias("valid"),
    )
