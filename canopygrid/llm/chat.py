"""Chat formatting: a finite-state machine over roles and a declarative template.

The land-cover project keeps no conversations, so this operator is general: any table with
one row per turn will do. Everything is built-in column functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.common import need

# Each escaped character and its two-character form. No form contains another
# escaped character, so undoing them from the last to the first is exact.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("|", "\\3"))


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles carry loss and which role may follow which.

    ``opening`` holds ``{role}``. Every control string of the template begins with one of the
    escaped characters, so no text can imitate one.
    """

    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("assistant",)


def escape(c: Column) -> Column:
    for raw, coded in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def _final_state(roles: Column, t: Template) -> Column:
    """State after all roles; ``error`` once a role is not allowed."""
    pairs = [F.lit(x) for a, bs in t.moves.items() for b in bs for x in (f"{a}>{b}", b)]
    table = F.create_map(*pairs)
    step = lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), r)), F.lit("error"))
    return F.aggregate(roles, F.lit(t.start), step)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", template: Template | None = None) -> DataFrame:
    """One row per conversation: ``conv, n_turns, valid, end_state, segments, formatted``.

    ``segments`` is an array of (text, loss): three per turn, in order; ``formatted`` is their
    concatenation. ``valid`` tells whether the roles follow the machine and end in an accepting
    state; an invalid conversation is formatted all the same. Turns are ordered by ``turn``
    (null first), then role, then text, so repeated turn numbers and repeated rows have one
    order. A null role or text counts as empty; rows with a null conversation key form one
    conversation. Other columns are ignored; an empty table gives no rows. One conversation is
    one output value, so its texts must fit one row.
    """
    t = template or Template()
    need(turns, conv, turn, role, text)
    before, after = t.opening.split("{role}")
    row = F.struct(F.col(turn).alias("k"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    g = turns.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    three = lambda x: F.array(
        segment(F.concat(F.lit(before), escape(x["role"]), F.lit(after)), F.lit(False)),
        segment(escape(x["text"]), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.closing), F.lit(False)))
    out = g.select(
        conv, F.size("_turns").cast("long").alias("n_turns"),
        _final_state(F.col("_turns.role"), t).alias("end_state"),
        F.flatten(F.transform("_turns", three)).alias("segments"))
    return out.select(conv, "n_turns", F.col("end_state").isin(*t.accepting).alias("valid"), "end_state", "segments",
                      F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_turns(formatted: Column | str, template: Template | None = None) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    t = template or Template()
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    quote = lambda s: "\\Q" + s + "\\E" if s else ""
    before, after = t.opening.split("{role}")
    pattern = F.lit(f"{quote(before)}([^<\\[|]*){quote(after)}([^<\\[|]*){quote(t.closing)}")
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("role"),
                         F.regexp_extract_all(c, pattern, F.lit(2)).alias("text"))
    return F.transform(pairs, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))


def loss_text(segments: Column | str) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    c = F.col(segments) if isinstance(segments, str) else segments
    kept = F.filter(c, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
