"""Repair of conversation structure by weighted CYK parsing.

A well-formed conversation is nothing, or an optional system turn and then pairs of a user and an assistant turn.
The repair grammar is in Chomsky normal form.  Its symbols are fragments ``pq`` of well-formed conversations, from what
stands before (``p``) to what stands last (``q``): 0 nothing, 1 system, 2 user, 3 assistant.  Rules are ``pq -> pr rq``;
a row is kept, given another role or deleted, and turns may be inserted.  A cell holds for each symbol over a
span the least (cost, audit); the cell of a row is closed under insertions on both sides.

Charts combine spans bottom-up by length over 16 rows; the cells of 16 such spans are the bottom row of the next
chart, and so on.  This is exact: a symbol's fragments may be split at any row, and two audits of equal cost over one
span are never prefixes of each other, so the least audit of a whole is made of the least audits of its parts.
Long conversations are cut into portions that are parsed by different tasks and then combined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import stored, streamed_sha256

Cell = dict[str, tuple[int, str]]

#: Costs of edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SYMBOLS = ("00", "01", "02", "03", "11", "12", "13", "22", "23", "32", "33")
RULES = tuple((p + q, p + r, r + q) for p in "0123" for r in "0123" for q in "0123" if {p + r, r + q} <= set(SYMBOLS))
#: Symbols that a single turn of a role makes, and those of a whole conversation.
TURNS = {"s": ("01",), "u": ("02", "12", "32"), "a": ("23",)}
WHOLE = ("00", "03")
ROLES = {"2": "user", "3": "assistant"}
#: Spans in a chart, and rows of a conversation that one task parses at once.
CHART, PORTION = 16, 256


def join(left: Cell, right: Cell, best: Cell | None = None) -> Cell:
    """The least ways to make each symbol of two neighbouring spans, and of ``best``."""
    best = {} if best is None else best
    for whole, first, second in RULES:
        if first in left and second in right:
            (a, x), (b, y) = left[first], right[second]
            known = best.get(whole)
            if known is None or a + b < known[0] or (a + b == known[0] and x + y < known[1]):
                best[whole] = (a + b, x + y)
    return best


def _inserted() -> Cell:
    """The cell of an empty span: every symbol that inserted turns can make."""
    cell: Cell = {p + p: (0, "") for p in "0123"} | {s: (INSERT, "I") for role in "ua" for s in TURNS[role]}
    while (more := join(cell, cell, dict(cell))) != cell:
        cell = more
    return cell


NOTHING = _inserted()


def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row, by the initial of its role and its fault (blank, duplicate, truncated or none)."""
    cell: Cell = {p + p: (DELETE, "D") for p in "0123"}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        ways = [(s, (REROLE + extra, "R")) for role in "ua" for s in TURNS[role]] + [(s, (KEEP + extra, "K")) for s in TURNS.get(initial, ())]
        for symbol, way in ways:
            cell[symbol] = min(way, cell.get(symbol, way))
    return join(join(NOTHING, cell), NOTHING)


def parse(cells: list[Cell]) -> Cell:
    """CYK over neighbouring spans: the chart is filled by span length, each entry from all its splits."""
    chart = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for i in range(len(cells) - length + 1):
            best: Cell = {}
            for k in range(i + 1, i + length):
                join(chart[i, k], chart[k, i + length], best)
            chart[i, i + length] = best
    return chart[0, len(cells)]


def combined(cells: list[Cell]) -> Cell:
    """The cell of all spans together, chart by chart."""
    while len(cells) > 1:
        cells = [parse(cells[i : i + CHART]) for i in range(0, len(cells), CHART)]
    return cells[0] if cells else NOTHING


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``conv`` (the id as text), ``pos`` from 0 on, ``fault``, and flags of ``illegal`` steps and ``fresh`` turns.

    Rows are ordered by turn, nulls first, then by role and text.  The first fault counts: blank without a sign that is no ASCII white
    space, duplicate if role and text stood earlier, truncated if the last such sign is none of ``.!?``.  Null role or text counts
    as one space.  Rows with a null conv_id are one conversation.
    """
    blank = F.lit(" ")
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.lag(F.substring("role", 1, 1)).over(order)
    pair = F.concat(before, F.substring("role", 1, 1))
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))
    rows = rows.select("*", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), new_turn.alias("fresh"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("pos")) > 1
    fault = F.when(~F.col("text").rlike(r"[^ \t-\r]"), "blank").when(again, "duplicate").when(~F.col("text").rlike(r"[.!?][ \t-\r]*\z"), "truncated")
    return rows.withColumn("fault", F.coalesce(fault, F.lit("")))


def structure(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal) from ``ordered_rows``; ``gaps``: turns missing between the least and the largest."""
    def count(c: Column) -> Column:
        return F.count(F.when(c, 1))

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0))
    faults = [count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    return rows.groupBy("conv").agg(gaps.alias("gaps"), *faults, count(F.col("illegal")).alias("illegal"))


def _cells_table(keys: list, cells: list[Cell]) -> pa.RecordBatch:
    cost = pa.array([[c[s][0] if s in c else None for s in SYMBOLS] for c in cells], pa.list_(pa.int64()))
    audit = pa.array([[c[s][1] if s in c else None for s in SYMBOLS] for c in cells], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.int64()), cost, audit], names=["conv", "portion", "cost", "audit"])


def parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of portions (conv, portion, rows)."""
    known: dict[tuple[str, str], Cell] = {}

    def cell(initial: str, fault: str) -> Cell:
        kind = (initial if initial in TURNS else "", fault)
        if kind not in known:
            known[kind] = row_cell(*kind)
        return known[kind]

    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield _cells_table(keys, [combined([cell(r["initial"], r["fault"]) for r in rows]) for rows in b.column(2).to_pylist()])


def parse_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of neighbouring portions together (conv, portion, parts)."""
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        cells = [[{s: (c, a) for s, c, a in zip(SYMBOLS, p["cost"], p["audit"], strict=True) if c is not None} for p in parts] for parts in b.column(2).to_pylist()]
        yield _cells_table(keys, [combined(c) for c in cells])


CELLS = "conv string, portion long, cost array<long>, audit array<string>"


def cheapest_edits(rows: DataFrame, portion: int = PORTION) -> DataFrame:
    """(conv, cost, audit) from ``ordered_rows``: the cheapest repair, and its edits' initials, the least in ASCII order."""
    at = F.floor(F.col("pos") / portion).cast("long")
    step = F.struct("pos", F.substring("role", 1, 1).alias("initial"), "fault")
    parts = rows.groupBy("conv", at.alias("portion")).agg(F.sort_array(F.collect_list(step)).alias("rows"))
    cells = stored(parts.mapInArrow(parse_rows, CELLS))
    while not cells.where("portion > 0").isEmpty():
        up = F.floor(F.col("portion") / CHART).cast("long")
        cells = cells.groupBy("conv", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("portion", "cost", "audit"))).alias("parts"))
        cells = stored(cells.mapInArrow(parse_portions, CELLS))
    best = F.array_min(F.array(*[F.struct(F.get("cost", F.lit(i)).alias("cost"), F.get("audit", F.lit(i)).alias("audit")) for i in map(SYMBOLS.index, WHOLE)]))
    return cells.select("conv", best.alias("best")).select("conv", "best.cost", "best.audit")


def edits_of(audit: str) -> Iterator[tuple[str, str | None, str]]:
    """For every row: lines inserted before it, its new role ("" keeps its own, null if deleted), lines inserted after the last row.

    An odd number of turns is left only if the first is a system turn; from then on users and assistants alternate.
    """
    made, left = sum(e != "D" for e in audit) % 2, audit.rstrip("I")
    lines: list[str] = []
    place = 0

    def role() -> str:
        return ROLES["3" if (place + made) % 2 else "2"]

    for at, edit in enumerate(left):
        if edit == "I":
            lines.append(f"{role()}:")
            place += 1
            continue
        now = None if edit == "D" else "" if edit == "K" else role()
        place += edit != "D"
        after = []
        if at == len(left) - 1:
            for _ in audit[len(left) :]:
                after.append(f"{role()}:")
                place += 1
        yield "\n".join(lines), now, "\n".join(after)
        lines = []


def row_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, pos, before, role_now, after) for every row of (conv, audit), as ``edits_of`` gives them."""
    schema = pa.schema([("conv", pa.string()), ("pos", pa.int64()), ("before", pa.string()), ("role_now", pa.string()), ("after", pa.string())])

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for b in batches:
        out: list = []
        for conv, audit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for pos, edit in enumerate(edits_of(audit)):
                out.append((conv, pos, *edit))
                if len(out) == 10_000:
                    yield made(out)
                    out = []
        yield made(out)


def repaired_lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, pos, lines) of the repaired conversations, ``role:text`` joined by line breaks; rows that leave nothing are left out."""
    steps = edits.select("conv", "audit").mapInArrow(row_edits, "conv string, pos long, before string, role_now string, after string")
    own = F.concat(F.when(F.col("role_now") == "", F.col("role")).otherwise(F.col("role_now")), F.lit(":"), F.col("text"))
    lines = F.concat_ws("\n", F.nullif("before", F.lit("")), own, F.nullif("after", F.lit("")))
    joined = rows.select("conv", "pos", "role", "text").join(steps, ["conv", "pos"])
    return joined.select("conv", "pos", lines.alias("lines")).where("lines <> ''")


def repair(rows: DataFrame, conversations: DataFrame, portion: int = PORTION) -> DataFrame:
    """One row per conv_id of ``conversations``: conv_id, gaps, faults, illegal steps, cost, audit, repaired_sha256, from rows (conv_id, turn, role, text).

    A conversation without rows gets zeros, an empty audit and the hash of nothing; an empty table gives no rows.
    """
    rows = stored(ordered_rows(rows))
    edits = stored(cheapest_edits(rows, portion))
    hashed = streamed_sha256(repaired_lines(rows, edits), "conv", "pos", "lines", "repaired_sha256", "\n")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = ids.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    joined = ids.join(structure(rows), "conv", "left").join(edits, "conv", "left").join(hashed, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def repair_text(rows: DataFrame, portion: int = PORTION) -> DataFrame:
    """The repaired turns themselves: conv_id, pos (of the row they stand at), lines."""
    rows = stored(ordered_rows(rows))
    lines = repaired_lines(rows, cheapest_edits(rows, portion))
    return lines.join(rows.select("conv", "conv_id").distinct(), "conv").select("conv_id", "pos", "lines")


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls are one space."""
    blank = F.lit(" ")
    ids = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(ids[0], F.lit(":"), ids[1]).cast("binary")) % 20
    said = F.coalesce(F.col("text").cast("string"), blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    made = turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return made.select("conv_id", "turn", "role", "text")
