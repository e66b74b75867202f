"""Conversation structure repair by depth-first branch-and-bound.

The land-cover project keeps no conversations, so this operator is general: any table with one
row per turn will do. Rows are judged (blank, duplicate, truncated) with built-in functions;
then each conversation is read once as a stream of short codes, without texts, and the
cheapest edits that give it a legal order of roles are searched. The texts are joined
to the edits afterwards, row by row, so no conversation's texts are ever held at once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from canopygrid.llm.common import need
from canopygrid.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
# What each edit costs; KEPT_TRUNCATED comes on top of keeping or reroling such a row.
REROLE, DELETE, INSERT, KEPT_TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what stands last
FOLLOWS = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FINAL = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
CACHED = 4096  # plans of short conversations kept in a worker
SHORT = 64
FLUSH = 20_000  # rows in an output batch


# ---------------------------------------------------------------- the search

@dataclass(frozen=True, slots=True, eq=False)
class Step:
    """The last edit of a prefix; ``depth`` edits lead to it."""

    parent: Step | None
    letter: str
    depth: int


def before(a: Step | None, b: Step | None) -> bool:
    """Whether the letters up to ``a`` are ASCII-less than those up to ``b``."""
    x = y = ""
    longer = (a.depth if a else 0) - (b.depth if b else 0)
    for _ in range(longer):
        x, a = a.letter, a.parent
    for _ in range(-longer):
        y, b = b.letter, b.parent
    ends = longer < 0  # a is the shorter one, and less if it begins b
    while a is not b:
        x, y, a, b = a.letter, b.letter, a.parent, b.parent
        ends = x < y
    return ends


def steps_of(path: Step | None) -> list[Step]:
    steps = []
    while path:
        steps.append(path)
        path = path.parent
    return steps[::-1]


def needed(state: int) -> int:
    """The role that an inserted or reroled turn gets after ``state``."""
    return ASSISTANT if state == USER else USER


def edits(code: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows read, next state) of every edit of a row, by letter.

    A code is the row's role initial, ``x`` for any other; upper case for truncated rows, and ``-`` for rows that must go.
    Without a code (the conversation's end) only insertion is left.
    """
    if code:
        yield "D", DELETE, 1, state
    yield "I", INSERT, 0, needed(state)
    if code and code != "-":
        extra = KEPT_TRUNCATED if code.isupper() else 0
        role = code.lower()
        if state in FOLLOWS.get(role, ()):
            yield "K", extra, 1, STATE_OF[role]
        yield "R", REROLE + extra, 1, needed(state)


def suffix_bounds(codes: str) -> list[list[int]]:
    """Least cost of the rows from each place on, by state: no completion is cheaper."""
    bounds = [[0, 2 * INSERT, INSERT, 0]]
    for code in reversed(codes):
        after = bounds[-1]
        now = [min(cost + after[to] for _, cost, rows, to in edits(code, q) if rows) for q in range(4)]
        for _ in range(2):  # insertions stay at the row; two of them lead round
            now = [min(now[q], INSERT + now[needed(q)]) for q in range(4)]
        bounds.append(now)
    return bounds[::-1]


def no_bounds(codes: str) -> list[list[int]]:
    return [[0] * 4] * (len(codes) + 1)


def repair_plan(codes: str, bounds: Callable[[str], list[list[int]]] = suffix_bounds) -> tuple[int, str]:
    """The least cost, and the ASCII-least letters of the edits that reach it.

    Depth first with a stack of its own. A prefix is dropped if its cost and suffix bound exceed
    the incumbent, if they equal it with letters that are no less, or if its node (row and state) was reached by
    a prefix that is cheaper, or as cheap and less in letters. Equal costs never have letters of which one begins the
    other, so what is less at a node stays less at the end. The incumbent is proved when the stack is empty.
    """
    rest, n = bounds(codes), len(codes)
    best, line = None, []  # the incumbent: its cost and its steps
    table: dict[int, tuple[int, Step | None]] = {}
    stack: list[tuple[int, int, int, int, Step | None]] = [(rest[0][START], 0, 0, START, None)]
    while stack:
        bound, cost, i, q, path = stack.pop()
        if best is not None and (bound > best or (bound == best and path and not before(path, line[:path.depth][-1]))):
            continue
        known = table.get(4 * i + q)
        if known and (known[0] < cost or (known[0] == cost and not before(path, known[1]))):
            continue
        table[4 * i + q] = (cost, path)
        if i == n and q in FINAL and (best is None or cost < best or before(path, line[-1])):
            best, line = cost, steps_of(path)
        depth = path.depth + 1 if path else 1
        nexts = [(cost + c + rest[i + rows][to], letter, cost + c, i + rows, to) for letter, c, rows, to in edits(codes[i:i + 1], q)]
        for f, letter, c, j, to in sorted(nexts, reverse=True):  # the least bound, then the least letter, is popped first
            stack.append((f, c, j, to, Step(path, letter, depth)))
    return best, "".join(s.letter for s in line)


@functools.lru_cache(maxsize=CACHED)
def _short_plan(codes: str) -> tuple[int, str]:
    return repair_plan(codes)


def plan_of(codes: str) -> tuple[int, str]:
    """``repair_plan``, remembered for short conversations."""
    return _short_plan(codes) if len(codes) <= SHORT else repair_plan(codes)


def applied(codes: str, audit: str) -> Iterator[tuple[str, int | None, str | None]]:
    """(letter, row, new role) of every edit in turn; no row for insertions, no role where it stays."""
    i, state = 0, START
    for letter in audit:
        role = NAMES[needed(state)] if letter in "IR" else None
        if letter == "K":
            state = STATE_OF[codes[i].lower()]
        elif role:
            state = needed(state)
        yield letter, None if letter == "I" else i, role
        i += letter != "I"


# ---------------------------------------------------------------- on tables

@dataclass(frozen=True)
class Repair:
    """``report``: one row per conversation, ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``;
    ``turns``: the repaired rows, ``conv, place`` (from 0)``, edit, turn, role, text``."""

    report: DataFrame
    turns: DataFrame


def _judged(turns: DataFrame) -> DataFrame:
    """Rows with what is known of each by itself."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return turns.withColumns({
        "said": F.sha2(said, 256), "blank": bare == "", "open": ~F.substring(bare, -1, 1).isin(*ENDS)})


def _codes(rows: DataFrame) -> DataFrame:
    """One row per different row (``copies`` of it), with its code as the first one that says so, and the initial."""
    once = rows.groupBy("conv", "turn", "role", "said").agg(
        F.count("*").alias("copies"), F.bool_or("blank").alias("blank"), F.bool_or("open").alias("open"))
    earlier = F.row_number().over(W.partitionBy("conv", "said").orderBy(F.asc_nulls_first("turn"))) > 1
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return once.select("conv", "turn", "role", "said", "copies", known.alias("code"), "blank", earlier.alias("again"), "open")


def _report_fields() -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
        T.StructField("audit", T.StringType())]


def _search(rows: DataFrame) -> DataFrame:
    """Reports and edits of all conversations, one kind of row with ``place`` null, the other with it."""
    key = rows.schema["conv"].dataType
    schema = T.StructType([
        T.StructField("conv", key), *_report_fields(), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("turn", T.LongType()), T.StructField("old_role", T.StringType()), T.StructField("said", T.StringType()),
        T.StructField("role", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows_ in _conversations(batches):
            out.extend((conv, *r) for r in _repaired(rows_))
            while len(out) >= FLUSH:
                yield _batch(out[:FLUSH], schema)
                del out[:FLUSH]
        if out:
            yield _batch(out, schema)

    order = ["conv", F.asc_nulls_first("turn"), "role", "said"]
    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of equal first columns, with the other columns of their rows."""
    conv, rows, begun = None, [], False
    for b in batches:
        for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if begun and key != conv:
                yield conv, rows
                rows = []
            conv, begun = key, True
            rows.append(tuple(row))
    if begun:
        yield conv, rows


def _repaired(rows: list[tuple]) -> Iterator[tuple]:
    """The report row, then the edits that leave a turn."""
    codes, kept, initials = [], [], []
    blank = duplicate = truncated = 0
    turns = [r[0] for r in rows if r[0] is not None]
    for turn, role, said, copies, code, is_blank, again, is_open in rows:
        initials.append(code * min(copies, 2))  # more copies add pairs of the same kind
        illegal_more = max(copies - 2, 0)
        if is_blank:
            blank += copies
            codes.append("-" * copies)
        else:
            copies_lost = copies if again else copies - 1
            duplicate += copies_lost
            if not again:
                truncated += is_open
                codes.append(code.upper() if is_open else code)
            codes.append("-" * copies_lost)
        kept.append((turn, role, said, copies, illegal_more))
    line = "".join(initials)
    illegal = sum(line[i:i + 2] not in LEGAL for i in range(len(line) - 1)) + sum(k[4] for k in kept)
    gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
    whole = "".join(codes)
    cost, audit = plan_of(whole)
    yield gaps, blank, duplicate, truncated, illegal, cost, audit, None, None, None, None, None, None
    owner = iter([(k[:3], c) for k in kept for c in range(k[3])])
    place = 0
    for letter, row, role in applied(whole, audit):
        of = next(owner)[0] if row is not None else (None, None, None)
        if letter != "D":
            yield *(None,) * 7, place, letter, *of, role if role else of[1]
            place += 1


def repair_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults of every conversation and the cheapest edits that repair it.

    A conversation is its rows by ``turn`` (nulls first; rows of one turn by role, then by a digest of role and text). A row's first fault
    counts: blank (white space only), duplicate (role and text stood earlier), truncated (the last character that is
    no white space is none of ``.!?``). Roles count by their initial. Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (a must for
    blank and duplicate rows), Insert of an empty user or assistant turn 5; a truncated row that is not deleted adds 5. The result is
    empty, or an optional system turn and pairs of user and assistant. ``audit`` has the edits' initials, the ASCII-least of the cheapest.
    ``gaps`` are turn numbers missing between the least and the largest; ``illegal`` counts neighbouring rows, before repair, whose initials are
    none of su, ua, au. Null roles and texts count as one space, rows with a null conversation are one conversation, other columns are
    ignored, an empty table gives empty tables.
    """
    need(turns, conv, turn, role, text)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _judged(turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text")))
    done = cut_lineage(_search(_codes(rows.drop("text"))))
    report = done.where(F.col("place").isNull()).select(F.col("conv").alias(conv), *[f.name for f in _report_fields()])
    left = done.where(F.col("place").isNotNull()).select("conv", "place", "edit", "turn", "old_role", "said", "role")
    # a row that stays is the only one of its role and text in its conversation, so its key is never hot
    texts = rows.groupBy("conv", "turn", F.col("role").alias("old_role"), "said").agg(F.first("text").alias("text"))
    same = [left["conv"].eqNullSafe(texts["conv"]), left["turn"].eqNullSafe(texts["turn"]), left["old_role"] == texts["old_role"], left["said"] == texts["said"]]
    found = left.join(texts, functools.reduce(Column.__and__, same), "left").select(
        left["conv"].alias(conv), "place", "edit", left["turn"].alias(turn), left["role"].alias(role), F.coalesce("text", F.lit("")).alias(text))
    return Repair(report, found)


def digests(turns: DataFrame, conv: str = "conv_id", place: str = "place", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, sha256``: lowercase hex of each conversation's ``role:text``, newline-joined, by place.

    Read as a stream in order, whatever the length of a conversation; an empty table gives no rows.
    """
    need(turns, conv, place, role, text)
    schema = T.StructType([T.StructField("conv", turns.schema[conv].dataType), T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for b in batches:
            for now, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sha is None or now != key:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(said.encode())
                else:
                    sha.update(b"\n" + said.encode())
            if out:
                yield _batch(out, schema)
                out = []
        if sha:
            yield _batch([(key, sha.hexdigest())], schema)

    lines = turns.select(F.col(conv).alias("conv"), F.concat(role, F.lit(":"), text).alias("said"), F.col(place).alias("place"))
    ordered = lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "said")
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv)
