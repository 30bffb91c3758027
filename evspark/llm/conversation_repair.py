"""Repair of damaged conversations by the cheapest edits, with a checkpointed dynamic program (operator 12).

Rows of a conversation stand in order of (turn with nulls first, role, text). A row has one fault at most: blank (no character but ASCII
white space), duplicate (role and text stand in an earlier row), truncated (its last other character is none of ``.!?``).
Edits: K keep (cost 0), R set the role to user or assistant (2), D delete (3; blank and duplicate rows must go), I insert a user or
assistant row with empty text anywhere (2). A truncated row that stays adds 1. The initials of the roles that remain must match
``(s?(ua)+)?``; of the cheapest ways the one with the ASCII-least initials of edits is taken.

An automaton of four states reads the roles: nothing yet, system read, user read, assistant read. Costs to the end are a vector
of four numbers, and a run of rows is a 4 x 4 matrix of costs under (min, +).

1. Equal rows become one with a count. Rows are sorted over all tasks by conversation and turn, and cut into blocks of bounded size,
   so a conversation of any length lies in many blocks. Each block stores its matrix.
2. Per conversation the block matrices are applied to the vector at the end, last block first: the vector at each block's end is kept.
3. Each block is walked forward alone, for each state in which it may be entered. The walk holds backward vectors only at every
   square root of its rows, computes those between anew piece by piece, and takes the least edit whose cost is tight.
4. Per conversation the states at block starts follow one another; each block replays the edits of its state on its texts.

Steps 2 and 4 read one narrow row per block, in order, and hold one of them at a time.

Definitions: null roles and texts count as one space, null ids are one conversation, null turns come first and have no part in ``gaps``
(last turn - first + 1 - distinct turns; 0 without turns). ``illegal`` counts neighbours whose initials are not su, ua or au. Repeated rows
are duplicates, texts of any length stay whole, other columns are not read, and an empty table gives no rows.

Scale: a text is shuffled four times (equal rows, duplicates, order, replay). A digest of a conversation (:func:`digests`) reads its
blocks one after the other in one task, as the hash and the audit of one conversation are sequential by their nature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared

BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 20
SORT_CHARS = 256
"""Text that takes part in the choice of partitions; rows that agree so far are sorted in one task."""

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEXT = (USER, USER, ASSISTANT, USER)
"""State after a user or assistant row, whichever the state allows."""
END = (0.0, inf, inf, 0.0)

BLANK, REPEATED, CUT = 1, 2, 4
LEGAL = {"su", "ua", "au"}


def after_keep(state: int, initial: str) -> int | None:
    """State after a row that keeps its role; None where that role may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def with_inserts(costs: list[float]) -> list[float]:
    """Costs from each state when rows may be inserted before the next one."""
    out = list(costs)
    for _ in range(2):
        out = [min(out[s], INSERT + out[NEXT[s]]) for s in range(4)]
    return out


def before(costs: list[float], initial: str, fault: int) -> list[float]:
    """Costs before a row, from those behind it."""
    out = [DELETE + c for c in costs]
    if not fault & (BLANK | REPEATED):
        extra = TRUNCATED if fault & CUT else 0
        for s in range(4):
            kept = after_keep(s, initial)
            out[s] = min(out[s], REROLE + extra + costs[NEXT[s]], inf if kept is None else KEEP + extra + costs[kept])
    return with_inserts(out)


def tight_edit(state: int, here: list[float], behind: list[float], initial: str, fault: int) -> tuple[str, int]:
    """The ASCII-least edit that is on a cheapest way, and the state behind it."""
    cost = here[state]
    if DELETE + behind[state] == cost:
        return "D", state
    if INSERT + here[NEXT[state]] == cost:
        return "I", NEXT[state]
    extra = TRUNCATED if fault & CUT else 0
    kept = after_keep(state, initial)
    if kept is not None and KEEP + extra + behind[kept] == cost:
        return "K", kept
    return "R", NEXT[state]


Code = tuple[str, int, int]
"""Initial of the role, fault of the first of equal rows, and their number."""


def _row_back(costs: list[float], code: Code) -> list[float]:
    initial, fault, n = code
    # equal rows behind the first must all go, which leaves the state as it is
    return before([c + DELETE * (n - 1) for c in costs], initial, fault)


def matrix(codes: list[Code]) -> list[float]:
    """Least costs through the rows, from each state (row) to each state behind them (column); inserts only before rows."""
    columns = []
    for end in range(4):
        costs = [0.0 if s == end else inf for s in range(4)]
        for code in reversed(codes):
            costs = _row_back(costs, code)
        columns.append(costs)
    return [columns[end][s] for s in range(4) for end in range(4)]


def applied(m: list[float], costs: list[float]) -> list[float]:
    return [min(m[4 * s + e] + costs[e] for e in range(4)) for s in range(4)]


def walk(codes: list[Code], behind: list[float], state: int) -> tuple[str, int]:
    """Edits of the rows from a state, and the state behind them, given the costs behind the last row.

    Backward costs are kept at every ``step``-th row only, those between are made anew for one piece at a time.
    """
    step = max(1, isqrt(len(codes)))
    starts = range(0, len(codes), step)
    checkpoints = {len(codes): behind}
    costs = behind
    for at in range(len(codes) - 1, -1, -1):
        costs = _row_back(costs, codes[at])
        if at % step == 0:
            checkpoints[at] = costs
    edits: list[str] = []
    for start in starts:
        end = min(start + step, len(codes))
        piece = [checkpoints[end]]
        for at in range(end - 1, start - 1, -1):
            piece.append(_row_back(piece[-1], codes[at]))
        piece.reverse()
        for k in range(end - start):
            initial, fault, n = codes[start + k]
            later = [c + DELETE * (n - 1) for c in piece[k + 1]]
            here = before(later, initial, fault)
            edit = "I"
            while edit == "I":
                edit, state = tight_edit(state, here, later, initial, fault)
                edits.append(edit)
            edits.append("D" * (n - 1))
    return "".join(edits), state


def closing(state: int) -> str:
    """Inserts behind the last row that lead to an end; a user row waits for an answer, a system row for both."""
    return {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]


def replay(edits: str, rows: list[tuple[str, str, int]], state: int) -> list[dict]:
    """Rows (role, text) that remain, from edits and rows (role, text, number of equal rows)."""
    out, left = [], ((role, text) for role, text, n in rows for _ in range(n))
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": ""})
            continue
        role, text = next(left)
        if edit == "D":
            continue
        state = after_keep(state, role[:1]) if edit == "K" else NEXT[state]
        out.append({"role": role if edit == "K" else ROLE[state], "text": text})
    return out


@dataclass
class _Block:
    """Rows of one conversation, one behind the other, in one task."""

    rows: list[dict] = field(default_factory=list)
    chars: int = 0

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.chars += len(row["text"])

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def record(self, part: int, number: int) -> dict:
        rows = self.rows
        codes = [(r["role"][:1], r["fault"], r["n"]) for r in rows]
        blank = sum(r["n"] for r in rows if r["fault"] & BLANK)
        repeated = sum(r["n"] - 1 + bool(r["fault"] & REPEATED) for r in rows if not r["fault"] & BLANK)
        firsts = [c[0] for c in codes]
        illegal = sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:], strict=False)) + sum((n - 1) * (i + i not in LEGAL) for i, _, n in codes)
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        return {
            "conv_id": rows[0]["conv_id"], "part": part, "block": number, "matrix": matrix(codes), "blank": blank, "duplicate": repeated,
            "truncated": sum(bool(r["fault"] & CUT) for r in rows), "illegal": illegal, "first_initial": firsts[0], "last_initial": firsts[-1],
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
            "initials": firsts, "faults": [c[1] for c in codes], "counts": [c[2] for c in codes], "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows],
        }


BLOCK_FIELDS = [
    ("conv_id", "long", pa.int64()), ("part", "int", pa.int32()), ("block", "long", pa.int64()), ("matrix", "array<double>", pa.list_(pa.float64())),
    ("blank", "long", pa.int64()), ("duplicate", "long", pa.int64()), ("truncated", "long", pa.int64()), ("illegal", "long", pa.int64()),
    ("first_initial", "string", pa.string()), ("last_initial", "string", pa.string()), ("first_turn", "long", pa.int64()), ("last_turn", "long", pa.int64()), ("turns", "long", pa.int64()),
    ("initials", "array<string>", pa.list_(pa.string())), ("faults", "array<int>", pa.list_(pa.int32())), ("counts", "array<long>", pa.list_(pa.int64())),
    ("roles", "array<string>", pa.list_(pa.string())), ("texts", "array<string>", pa.list_(pa.string())),
]
BLOCK_DDL = ", ".join(f"{n} {t}" for n, t, _ in BLOCK_FIELDS)
BLOCK_ARROW = pa.schema([(n, a) for n, _, a in BLOCK_FIELDS])
ORDER = ["conv_id", "part", "block"]


def _records(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


def _batches(records: Iterator[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for record in records:
        some.append(record)
        if len(some) >= most:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks() -> Iterator[dict]:
        number, now = 0, _Block()
        for row in _records(batches):
            if now.rows and (now.rows[0]["conv_id"] != row["conv_id"] or now.full()):
                yield now.record(now.rows[0]["part"], number)
                number, now = number + 1, _Block()
            now.add(row)
        if now.rows:
            yield now.record(now.rows[0]["part"], number)

    return _batches(blocks(), BLOCK_ARROW)


def _fault() -> Column:
    space = r"[\x20\x09-\x0D]"
    return (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(~(F.col("turn").eqNullSafe(F.col("first"))), REPEATED)
        .when(~F.col("text").rlike(rf"[.!?]{space}*\z"), CUT)
        .otherwise(0)
    )


def blocks_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One stored row per block of a conversation, in order of (part, block)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = shared.stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")), "turns")
    place = ["conv_id", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256).alias("said")]
    turn = F.when(F.max(F.col("turn").isNull()), F.lit(None)).otherwise(F.min("turn"))
    # stored before the join, so that Spark can split a text that one conversation repeats very often
    firsts = shared.stored(rows.select(*place, "turn").groupBy("conv_id", "said").agg(turn.alias("first")), "firsts")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    marked = rows.select("*", place[1]).join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    marked = marked.select("conv_id", "turn", "role", "text", "n", _fault().cast("int").alias("fault"))
    spread = marked.repartitionByRange("conv_id", "turn", F.substring("role", 1, SORT_CHARS), F.substring("text", 1, SORT_CHARS))
    ordered = spread.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    return shared.stored(ordered.mapInArrow(_cut, BLOCK_DDL), "blocks")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind each block; blocks of a conversation come last first."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("head", pa.bool_()), ("behind", pa.list_(pa.float64()))])

    def rows() -> Iterator[dict]:
        for _, some in groupby(_records(batches), lambda r: r["conv_id"]):
            costs, held = with_inserts(list(END)), None
            for r in some:
                if held:
                    yield held | {"head": False}
                held = {"part": r["part"], "block": r["block"], "behind": costs}
                costs = applied(r["matrix"], costs)
            yield held | {"head": True}

    return _batches(rows(), schema, 1024)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each block and the states behind it, for each state at its start; a conversation's first block has one."""
    schema = pa.schema([*(BLOCK_ARROW.field(n) for n in NARROW), ("cost", pa.list_(pa.float64())), ("exits", pa.list_(pa.int32())), ("edits", pa.list_(pa.string()))])

    def rows() -> Iterator[dict]:
        for r in _records(batches):
            codes = list(zip(r["initials"], r["faults"], r["counts"], strict=True))
            start = [START] if r["head"] else range(4)
            ways = [walk(codes, r["behind"], s) for s in start]
            yield {k: r[k] for k in NARROW} | {"cost": applied(r["matrix"], r["behind"]), "exits": [w[1] for w in ways], "edits": [w[0] for w in ways]}

    return _batches(rows(), schema, 256)


NARROW = ["conv_id", "part", "block", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "turns"]
PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), ("close", pa.string()), ("cost", pa.int64()),
    *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
])
PIECE_DDL = "conv_id long, part int, block long, state int, edits string, close string, cost long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way of each block that its conversation takes; what two blocks share is counted in the later one."""

    def rows() -> Iterator[dict]:
        for _, some in groupby(_records(batches), lambda r: r["conv_id"]):
            state, last, held = START, None, None
            for r in some:
                if held:
                    yield held
                at = state if len(r["exits"]) > 1 else 0
                turns = r["turns"]
                if last:
                    r["illegal"] += last["last_initial"] + r["first_initial"] not in LEGAL
                    if last["last_turn"] is not None and last["last_turn"] == r["first_turn"]:
                        turns -= 1
                held = {k: r[k] for k in ("conv_id", "part", "block", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn")}
                held |= {"state": state, "edits": r["edits"][at], "close": "", "turns": turns, "cost": 0 if last else int(r["cost"][START])}
                state, last = r["exits"][at], r
            yield held | {"close": closing(state)}

    return _batches(rows(), PIECE, 256)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Blocks of all conversations with their edits and repaired rows.

    conv_id, part and block (their order), edits (initials, for the last block with the inserts behind its rows), turns_left (the
    repaired rows: role, text), cost (of the whole conversation, in its first block), counts of faults, first and last turn, turns.
    """
    blocks = blocks_of(rows, conv_col, turn_col, role_col, text_col)
    backward = blocks.select(*ORDER, "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    ends = backward.mapInArrow(_ends, "part int, block long, head boolean, behind array<double>")
    codes = blocks.select(*NARROW, "matrix", "initials", "faults", "counts").join(ends, ["part", "block"])
    narrow = ", ".join(f"{n} {t}" for n, t, _ in BLOCK_FIELDS if n in NARROW)
    walked = shared.stored(codes.mapInArrow(_walked, f"{narrow}, cost array<double>, exits array<int>, edits array<string>"), "walked")
    chosen = walked.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_chosen, PIECE_DDL)
    texts = blocks.select(F.col("part").alias("p"), F.col("block").alias("b"), "roles", "texts", "counts")
    return shared.stored(_replayed(shared.stored(chosen, "chosen").join(texts, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))), "repaired")


def _replayed(pieces: DataFrame) -> DataFrame:
    schema = pa.schema([*(PIECE.field(n) for n in PIECE.names if n not in ("state", "close")), ("turns_left", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for r in _records(batches, 16):
                edits = r["edits"] + r["close"]
                left = replay(edits, list(zip(r["roles"], r["texts"], r["counts"], strict=True)), r["state"])
                yield {k: r[k] for k in schema.names if k != "turns_left"} | {"edits": edits, "turns_left": left}

        return _batches(rows(), schema)

    ddl = ", ".join(x for x in PIECE_DDL.split(", ") if x.split(" ")[0] not in ("state", "close"))
    return pieces.drop("p", "b").mapInArrow(run, f"{ddl}, turns_left array<struct<role: string, text: string>>")


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """conv_id, part, block, place (their order), role, text of every row that remains."""
    return repaired.select(*ORDER, F.posexplode("turns_left").alias("place", "x")).select(*ORDER, "place", "x.role", "x.text")


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for conv, some in groupby(_records(batches, 16), lambda r: r["conv_id"]):
                sums, audit, digest, lead = dict.fromkeys(names, 0), [], hashlib.sha256(), ""
                first, last, turns = None, None, 0
                for r in some:
                    for n in names:
                        sums[n] += r[n]
                    audit.append(r["edits"])
                    first = r["first_turn"] if first is None else first
                    last = last if r["last_turn"] is None else r["last_turn"]
                    turns += r["turns"]
                    for t in r["turns_left"]:
                        digest.update(f"{lead}{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                        lead = "\n"
                yield {"conv_id": conv, "gaps": 0 if first is None else last - first + 1 - turns, **sums, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        return _batches(rows(), schema, 256)

    ordered = repaired.repartition("conv_id").sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
