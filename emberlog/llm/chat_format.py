"""Chat formatting from a declarative template, with DataFrame functions only.

A template gives each role its marks, says whether its text is under the loss mask, and which role may follow which.
A finite-state machine walks over the roles and reports the first turn that breaks the order. Each turn becomes three
segments: opening mark, text, closing mark. Control strings inside a text are split by an escape sign, so that marks
in the output are always the template's own and the text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    #: role -> (opening mark, closing mark, is the text under the loss mask)
    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)}
    )
    #: Any other role, which is then written out before its text.
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    #: state -> role -> next state; a turn without an entry breaks the order.
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> list[str]:
        """All control strings, the longest first."""
        return sorted({m for o, c, _ in self.roles.values() for m in (o, c)} | set(self.other), key=lambda m: (-len(m), m))

    @property
    def outer(self) -> str:
        """A pattern of the marks between segments."""
        return "|".join(re.escape(m) for m in self.marks if m != self.other[1])

    @property
    def inner(self) -> str:
        """A pattern of a control string, as its first sign and the rest."""
        return "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in self.marks)


def escape(text: Column, template: Template) -> Column:
    """Doubles escape signs, then puts one behind the first sign of each control string."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, f"({template.inner})", "$1" + re.escape(ESCAPE))


def unescape(text: Column) -> Column:
    """Pairs of escape signs become one; single ones go."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, template: Template, what, other: Column) -> Column:
    out = None
    for name, spec in template.roles.items():
        out = F.when(role == name, F.lit(what(spec))) if out is None else out.when(role == name, F.lit(what(spec)))
    return out.otherwise(other)


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, segments, formatted, valid, broken_at): one row for each conversation.

    Turns stand in order of turn (null first), then role, then text; repeated rows are turns of their own. A null
    text or role is ''. Conversations that break the order are formatted like the rest: valid is false and broken_at
    counts the turns before the first wrong one, or all if only the end is wrong. segments holds
    (text, loss) in output order. Null conv_ids make one conversation.
    """
    t = template or Template()
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    body = F.when(role.isin(*t.roles), escape(text, t)).otherwise(F.concat(escape(role, t), F.lit(t.other[1]), escape(text, t)))
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"), role.alias("role"), text.alias("raw"), body.alias("body"),
            _by_role(role, t, lambda s: s[0], F.lit(t.other[0])).alias("open"), _by_role(role, t, lambda s: s[1], F.lit(t.other[2])).alias("close"),
            _by_role(role, t, lambda s: s[2], F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(x["open"].alias("text"), no.alias("loss")), F.struct(x["body"].alias("text"), x["loss"].alias("loss")), F.struct(x["close"].alias("text"), no.alias("loss"))
            ),
        )
    )
    steps = F.create_map(*(F.lit(x) for state, nexts in t.turns.items() for role_, to in nexts.items() for x in (f"{state}\n{role_}", to)))
    machine = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen")),
        lambda acc, x: F.struct(
            F.coalesce(F.when(acc["state"] == "broken", F.lit("broken")).otherwise(F.try_element_at(steps, F.concat(acc["state"], F.lit("\n"), x["role"]))), F.lit("broken")).alias("state"),
            (acc["seen"] + F.when((acc["state"] != "broken") & F.try_element_at(steps, F.concat(acc["state"], F.lit("\n"), x["role"])).isNotNull(), 1).otherwise(0)).alias("seen"),
        ),
    )
    out = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), machine.alias("m"))
    valid = F.col("m.state").isin(*t.ends)
    return out.select(
        "conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        valid.alias("valid"), F.when(~valid, F.col("m.seen")).alias("broken_at"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds turns, an array of (role, text, loss), to rows with a column formatted: the marks alone tell them apart."""
    t = template or Template()
    pieces, marks = F.split("formatted", t.outer, -1), F.regexp_extract_all("formatted", F.lit(f"({t.outer})"), 1)
    role_of = F.create_map(*(F.lit(x) for name, (o, _, _) in t.roles.items() for x in (o, name)))
    losses = [name for name, (_, _, loss) in t.roles.items() if loss]

    def turn(k: Column) -> Column:
        mark, piece = F.get(F.col("_marks"), k * 2), F.get(F.col("_pieces"), k * 2 + 1)
        cut = F.split(piece, re.escape(t.other[1]), 2)
        known = F.try_element_at(role_of, mark)
        role = F.coalesce(known, unescape(F.get(cut, F.lit(0))))
        return F.struct(
            role.alias("role"),
            unescape(F.when(known.isNull(), F.get(cut, F.lit(1))).otherwise(piece)).alias("text"),
            F.coalesce(known.isin(*losses), F.lit(False)).alias("loss"),
        )

    numbers = F.when(F.size("_marks") < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor(F.size("_marks") / 2).cast("int") - 1))
    return formatted.withColumns({"_pieces": pieces, "_marks": marks}).withColumn("turns", F.transform(numbers, turn)).drop("_pieces", "_marks")


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, broken_at, read from the output.

    Turns and loss are both told from the formatted text by its marks. Repeated rows are turns of their own, ties of
    turn stand in order of role and text, texts may be of any length, and an empty table gives no row.
    """
    done = read_back(format_turns(conversations, template), template)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    df = done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), lost.alias("lost"), "formatted", "valid", "broken_at")
    return df.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "broken_at",
    )
