"""Chat formatting: a state machine over roles, and a declarative template with a loss flag for each segment.

Rows of a conversation are taken by turn (then role and text, so ties have one order). The machine reads the roles and
tells whether the turn order is valid; every conversation is formatted either way. Each turn becomes three segments:
the template's opening for its role, its escaped text, and the closing. Only the text segments of the roles that
``loss_roles`` names bear loss. Control strings inside texts are escaped reversibly, so the formatted text can be read
back exactly.

Defined results: a null text or role is the empty string, a null turn comes first; repeated rows are turns of their
own; an empty table gives an empty result. Extra columns are passed over. DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``opening`` has ``{role}`` in it. No escaped text contains ``<`` or ``>``, so the marks stand out."""

    opening: str = "<turn:{role}>"
    closing: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Reversible escapes, in order; the first guards the escape character itself.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
    #: The machine: from state to {role: next state}; a role that isn't named leads to "bad".
    start: str = "start"
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepts: tuple[str, ...] = ("answered",)


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    for plain, safe in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, template: Template = CHAT) -> Column:
    for plain, safe in reversed(template.escapes):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _step(state: Column, role: Column, template: Template) -> Column:
    out = F.lit("bad")
    for source, moves in template.moves.items():
        for name, target in moves.items():
            out = F.when((state == source) & (role == name), F.lit(target)).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: Template = CHAT, id_col: str = "conv_id") -> DataFrame:
    """``id_col, n_turns, valid, segments array<struct<text, loss>>, formatted`` of every conversation."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text")))).alias("turns"))
    turns = F.col("turns")
    before, after = template.opening.split("{role}")
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                segment(F.concat(F.lit(before), escape(t["role"], template), F.lit(after)), F.lit(False)),
                segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.closing), F.lit(False)),
            ),
        )
    )
    state = F.aggregate(turns, F.lit(template.start), lambda s, t: _step(s, t["role"], template))
    out = rows.select(id_col, F.size("turns").cast("long").alias("n_turns"), state.isin(*template.accepts).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns ``array<struct<role, text>>`` that a formatted text holds."""
    before, after = template.opening.split("{role}")
    parts = F.split(formatted, f"\\Q{template.closing}\\E")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        gap = F.locate(after, p)
        role = F.substring(p, F.lit(len(before) + 1), gap - 1 - len(before))
        return F.struct(unescape(role, template).alias("role"), unescape(F.substring(p, gap + len(after), F.length(p)), template).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
