"""Chat formatting by a finite-state machine over roles (DataFrame functions only).

A declarative template gives the marks around each turn and which roles carry loss.
The formatter validates turn order with the machine's transition table, escapes the
control characters inside roles and texts reversibly, and emits text segments with a
loss flag each; their concatenation is the formatted conversation. ``read_back``
parses turns from the formatted string alone and the loss text from the segments.

Defined cases: a null text is empty; a null role is an empty role; turns are ordered
by (turn, role, text), nulls first; a null conversation id is a conversation of its
own; equal rows are turns each; an order the machine refuses gives valid = false and
is formatted all the same; other columns are ignored; an empty table gives an empty
result. A formatted conversation is one value, so all its turns meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is before + role + between + text + after."""
    before: str = "### "
    between: str = ": "
    after: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}
    order: dict = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    accept: tuple[str, ...] = ("answered",)
    #: character -> letter after the escape sign; covers the first character of every mark
    escapes: tuple[tuple[str, str], ...] = (("\\", "b"), ("#", "h"), ("<", "l"), (":", "c"))


TEMPLATE = Template()


def _escape(c: Column, t: Template) -> Column:
    for char, letter in t.escapes:  # the escape sign itself goes first
        c = F.replace(c, F.lit(char), F.lit("\\" + letter))
    return c


def _unescape(c: Column, t: Template) -> Column:
    for char, letter in reversed(t.escapes):  # and comes back last
        c = F.replace(c, F.lit("\\" + letter), F.lit(char))
    return c


def _final_state(roles: Column, t: Template) -> Column:
    table = F.create_map(*[F.lit(x) for s, moves in t.order.items() for r, to in moves.items()
                           for x in (f"{s} {r}", to)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(
        F.element_at(table, F.concat(state, F.lit(" "), role)), F.lit("refused")))


def format_chat(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, valid, segments: array<struct<text, loss>>, formatted: string."""
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("raw"),
                    F.concat(F.lit(t.before), _escape(role, t), F.lit(t.between)).alias("head"),
                    _escape(text, t).alias("body"))
    convs = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        segment(x["head"], F.lit(False)), segment(x["body"], x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.after), F.lit(False)))))
    roles = F.transform("turns", lambda x: x["role"])
    out = convs.select("conv_id", _final_state(roles, t).isin(*t.accept).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Adds ``turns``: array<struct<role, text>> parsed from ``formatted``, and
    ``loss_text``: all unescaped text under the loss mask."""
    t = template
    parts = F.array_remove(F.split(F.col("formatted"), _quote(t.after)), "")
    role = lambda p: F.split_part(F.substring(p, len(t.before) + 1, 1 << 30), F.lit(t.between), F.lit(1))
    # an escaped role holds no ':', so the first mark ends it
    body = lambda p: F.substr(p, F.length(role(p)) + len(t.before) + len(t.between) + 1)
    turns = F.transform(parts, lambda p: F.struct(_unescape(role(p), t).alias("role"), _unescape(body(p), t).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _unescape(s["text"], t)), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"
