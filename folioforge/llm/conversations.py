"""Repair of conversations at the least cost, by depth-first branch-and-bound over segments.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Rows are kept,
given another role, deleted or inserted; the cheapest edits win, ties go to the ASCII
order of their initials. A node of the search is (row, last role); its stack is
explicit, a suffix bound (the cheapest completion from each node, audits left out)
prunes against the incumbent (cost, audit), and a table per node drops prefixes that
are no better than one seen there.

Only codes of a byte or two are sorted for the search; texts are shuffled once, when
the edits are known. A long conversation is cut into segments wherever the sorted
partitions cut it: each is solved from every role it may begin after to every role it
may end with, and these tables compose, as (min, least) over (cost, audit) does. So no
task holds a conversation, and one that has a third of all rows is searched by many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioforge.session import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\f\r"
#: Rows of a segment at most.
SEGMENT = 256
#: What has been said last: nothing, or a role; and what may follow, with the state after it.
START, S, U, A = range(4)
FOLLOWS = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: The role that an edit may give after each state.
GIVEN = {START: "u", S: "u", U: "a", A: "u"}
NAMES = {"u": "user", "a": "assistant"}
DONE = frozenset((START, A))
NEVER = 1 << 60
FINE, BLANK, TWICE, CUT = range(4)
ROLES = "sua-"


# --- search ---------------------------------------------------------------------------------


def _allowed(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a row, in ASCII order: initial, cost, state after it."""
    role, fault = ROLES[code >> 2], code & 3
    yield "D", DELETE, state
    if fault not in (BLANK, TWICE):
        extra = TRUNCATED if fault == CUT else 0
        if role in FOLLOWS[state]:
            yield "K", KEEP + extra, FOLLOWS[state][role]
        yield "R", REROLE + extra, FOLLOWS[state][GIVEN[state]]


#: The edits of each code (four times the role, and the fault) in each state.
EDITS = [[list(_allowed(code, state)) for state in range(4)] for code in range(16)]


def bounds(codes: bytes, exits: frozenset) -> list[list[int]]:
    """For each place and state, the cost of the cheapest way to an exit."""
    row = [0 if s in exits else NEVER for s in range(4)]
    found = []
    for code in (None, *reversed(codes)):
        if code is not None:
            row = [min([cost + row[after] for _, cost, after in edits]) for edits in EDITS[code]]
        # An insert leads from the user's turn to the assistant's, and from all others to the user's.
        row[U] = min(row[U], INSERT + row[A])
        row[A], row[START], row[S] = (min(row[s], INSERT + row[U]) for s in (A, START, S))
        found.append(row)
    return found[::-1]


@lru_cache(maxsize=50_000)
def solve(codes: bytes, entry: int, exits: frozenset) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``entry`` over all rows to one of ``exits``; null if none does."""
    left, n = bounds(codes, exits), len(codes)
    best, seen = (NEVER, ""), {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        whole = cost + left[at][state]
        if whole > best[0] or whole == best[0] and audit > best[1] or whole >= NEVER:
            continue
        if seen.get((at, state), (NEVER, "")) <= (cost, audit):
            continue
        seen[at, state] = cost, audit
        if at == n and state in exits:
            best = min(best, (cost, audit))
            continue
        more = [("I", at, INSERT, FOLLOWS[state][GIVEN[state]])]
        if at < n:
            more += [(e, at + 1, c, s) for e, c, s in EDITS[codes[at]][state]]
        stack.extend((i, s, cost + c, audit + e) for e, i, c, s in sorted(more, reverse=True))
    return best if best[0] < NEVER else None


def _less(a: tuple, b: tuple) -> bool:
    """Whether the audit that a chain of pieces spells comes first in ASCII order."""

    def letters(pieces: tuple) -> Iterator[str]:
        while pieces:
            yield from pieces[0]
            pieces = pieces[1]

    if a is b:
        return False
    for x, y in zip(chain(letters(a), "\0"), chain(letters(b), "\0"), strict=False):
        if x != y:
            return x < y
    return False


def compose(table: list[tuple[int, str] | None], after: list[tuple[int, tuple] | None]) -> list[tuple[int, tuple] | None]:
    """The best from each state through a segment's ``table`` and then on as ``after`` says."""
    found: list[tuple[int, tuple] | None] = []
    for entry in range(4):
        best = None
        for end in range(4):
            step, rest = table[4 * entry + end], after[end]
            if step is None or rest is None:
                continue
            new = (step[0] + rest[0], (step[1], rest[1]) if step[1] else rest[1])
            if best is None or new[0] < best[0] or new[0] == best[0] and _less(new[1], best[1]):
                best = new
        found.append(best)
    return found


def spelt(pieces: tuple) -> str:
    out = []
    while pieces:
        out.append(pieces[0])
        pieces = pieces[1]
    return "".join(out)


# --- segments -------------------------------------------------------------------------------


class Segment:
    """A run of a conversation's rows: its codes, counts, turns and borders."""

    def __init__(self, conv: object, key: tuple, first: bool) -> None:
        self.conv, self.key, self.first = conv, key, first
        self.codes, self.counts, self.illegal, self.last = bytearray(), [0, 0, 0, 0], 0, None
        self.turns: list = [None, None, 0]  # first, last, how many

    def add(self, turn: int | None, role: int, faults: tuple[int, ...]) -> None:
        for fault in faults:
            self.codes.append(4 * role + fault)
            self.counts[fault] += 1
            if self.last is not None:
                self.illegal += illegal(self.last, role)
            self.last = role
        if faults and turn is not None:
            if self.turns[0] is None:
                self.turns[0] = turn
            self.turns[2] += turn != self.turns[1]
            self.turns[1] = turn

    def row(self, seq: int, last: bool) -> dict:
        codes = bytes(self.codes)
        whole = self.first and last
        if whole:
            table = [solve(codes, START, DONE)]
        else:
            entries = (START,) if self.first else range(4)
            table = [solve(codes, e, frozenset((x,))) if e in entries else None for e in range(4) for x in range(4)]
        turn, role, digest = self.key
        return {
            "conv_id": self.conv, "turn": turn, "role": role, "digest": digest, "seq": seq, "whole": whole, "blank": self.counts[BLANK], "duplicate": self.counts[TWICE],
            "truncated": self.counts[CUT], "illegal": self.illegal, "first_role": codes[0] >> 2 if codes else None, "last_role": self.last, "first_turn": self.turns[0], "last_turn": self.turns[1], "turns": self.turns[2],
            "costs": [None if t is None else t[0] for t in table], "audits": [None if t is None else t[1] for t in table],
        }


def illegal(before: int, after: int) -> bool:
    return ROLES[before] + ROLES[after] not in ("su", "ua", "au")


def _fields(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])


def _some(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _segments(coded: DataFrame) -> DataFrame:
    """The rows' codes, sorted over all partitions, as segments: whole conversations where a partition shows both ends."""
    numbers = "seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, first_role int, last_role int, first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"
    schema = T.StructType(_fields(coded, "conv_id", "turn", "role", "digest").fields + T.StructType.fromDDL(numbers).fields)
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, seq, began = None, 0, False
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "initial", "fault", "copies")]
                for conv, turn, role, digest, initial, fault, copies in zip(*columns, strict=True):
                    if now is None or conv != now.conv:
                        if now is not None:
                            yield now.row(seq, last=True)
                            seq += 1
                        now, began = Segment(conv, (turn, role, digest), first=began), True
                    elif len(now.codes) >= SEGMENT:
                        yield now.row(seq, last=False)
                        seq += 1
                        now = Segment(conv, (turn, role, digest), first=False)
                    again = BLANK if fault == BLANK else TWICE
                    now.add(turn, initial, (fault,)[:copies] + (again,) * (copies - 1))
            if now is not None:
                yield now.row(seq, last=False)

        return _some(rows(), arrow)

    order = ["conv_id", "turn", "role", "digest"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, schema)


DECIDED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _folded(segments: DataFrame) -> DataFrame:
    """Segments of conversations that partitions cut, put together from the last to the first."""
    schema = T.StructType(_fields(segments, "conv_id").fields + T.StructType.fromDDL(DECIDED).fields)
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            conv, open_, after, state = None, False, [], {}

            def done() -> dict:
                cost, audit = after[START]
                turns = state["turns"]
                gaps = turns[1] - turns[0] + 1 - turns[2] if turns[0] is not None else 0
                return {"conv_id": conv, "gaps": gaps, **{k: state[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": spelt(audit)}

            for batch in batches:
                for r in batch.to_pylist():
                    if not open_ or r["conv_id"] != conv:
                        if open_:
                            yield done()
                        conv, open_ = r["conv_id"], True
                        after = [(0, ()) if s in DONE else None for s in range(4)]
                        state = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None, "turns": [None, None, 0]}
                    for k in ("blank", "duplicate", "truncated", "illegal"):
                        state[k] += r[k]
                    if r["last_role"] is not None:
                        state["illegal"] += state["role"] is not None and illegal(r["last_role"], state["role"])
                        state["role"] = r["first_role"]
                    first, last, n = state["turns"]
                    if r["first_turn"] is not None:
                        state["turns"] = [r["first_turn"], r["last_turn"] if last is None else last, n + r["turns"] - (first == r["last_turn"])]
                    table = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
                    after = compose(table, after)
            if open_:
                yield done()

        return _some(rows(), arrow)

    back = [F.col("conv_id"), *[F.col(c).desc() for c in ("turn", "role", "digest", "seq")]]
    return segments.repartition("conv_id").sortWithinPartitions(*back).mapInArrow(fold, schema)


# --- conversations --------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the rows of ``turns`` with faults by the checksum of ``conv_id:turn``.

    Of twenty kinds, 0 drops a row (no copies: the row only names its conversation), 1
    empties its text, 2 removes the marks that end sentences, 3 repeats it, 4 makes it
    the user's. A null role or text is one space, and so is a null id or turn in the key.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _prepared(rows: DataFrame, copies: str | None) -> DataFrame:
    """Rows in plain names, with the digest of role and text that orders rows of one turn and tells equal ones."""
    space = F.lit(" ")
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))
    both = F.concat(F.length("role"), F.lit(":"), "role", "text")
    gone = F.concat(F.lit("-"), F.coalesce(F.col("turn").cast("string"), space))
    return plain.withColumn("digest", F.unhex(F.substring(F.sha2(F.when(F.col("copies") > 0, both).otherwise(gone), 256), 1, 32)))


def decide(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation of ``rows(conv_id, turn, role, text)``.

    Rows go by turn, nulls first, then by role and a digest of role and text. ``copies``
    names a column that says how often a row stands there; one with 0 copies only names
    its conversation, which without any row has zeros and an empty audit. A null role or
    text is one space. Rows with a null ``conv_id`` are one conversation. Turns are
    integers. Other columns are ignored; without rows there are no conversations.
    """
    plain = _prepared(rows, copies)
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    at = F.array_position(F.array(*map(F.lit, ROLES[:3])), F.left("role", F.lit(1))).cast("int")
    seen = "row_number() over (partition by conv_id, digest order by turn, role) > 1"
    codes = plain.select("conv_id", "turn", "role", "digest", "copies", F.when(at > 0, at - 1).otherwise(3).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), BLANK).when(F.expr(seen), TWICE).when(F.col("cut"), CUT).otherwise(FINE)
    coded = materialise(codes.select("conv_id", "turn", "role", "digest", "copies", "initial", fault.alias("fault")), "conversation-codes")
    segments = materialise(_segments(coded), "conversation-segments")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    whole = segments.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    return whole.unionByName(_folded(segments.where("not whole")))


def _with_rows(rows: DataFrame, decided: DataFrame, copies: str | None) -> DataFrame:
    """Each conversation's decision and after it its rows in order, in one partition."""
    plain = _prepared(rows, copies).where("copies > 0").withColumn("kind", F.lit(1))
    both = decided.withColumn("kind", F.lit(0)).unionByName(plain, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict | None]]:
    """``(decision, turn)`` for each repaired turn, and ``(decision, None)`` where a conversation ends."""
    decision, audit, at, state = None, "", 0, START

    def inserts() -> Iterator[tuple[dict, dict]]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            role = GIVEN[state]
            yield decision, {"turn": None, "role": NAMES[role], "text": "", "edit": "I"}
            at, state = at + 1, FOLLOWS[state][role]

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                if decision is not None:
                    yield from inserts()
                    yield decision, None
                decision, audit, at, state = r, r["audit"], 0, START
                continue
            for _ in range(r["copies"]):
                yield from inserts()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                initial = GIVEN[state] if edit == "R" else r["role"][:1]
                yield decision, {"turn": r["turn"], "role": NAMES[initial] if edit == "R" else r["role"], "text": r["text"], "edit": edit}
                state = FOLLOWS[state][initial]
    if decision is not None:
        yield from inserts()
        yield decision, None


def repaired_turns(rows: DataFrame, decided: DataFrame, copies: str | None = None) -> DataFrame:
    """``conv_id, place, turn, role, text, edit``: the repaired conversations' rows, inserted ones without a turn."""
    schema = T.StructType(_fields(rows, "conv_id").fields + T.StructType.fromDDL("place long, turn long, role string, text string, edit string").fields)
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            place = 0
            for decision, turn in _edited(batches):
                if turn is None:
                    place = 0
                else:
                    yield {"conv_id": decision["conv_id"], "place": place, **turn}
                    place += 1

        return _some(out(), arrow)

    return _with_rows(rows, decided, copies).mapInArrow(write, schema)


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """:func:`decide`, with ``repaired_sha256`` of the repaired ``role:text`` lines, which are read one by one."""
    decided = decide(rows, copies)
    names = decided.columns
    schema = T.StructType(decided.schema.fields + T.StructType.fromDDL("repaired_sha256 string").fields)
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            sha, lead = hashlib.sha256(), ""
            for decision, turn in _edited(batches):
                if turn is None:
                    yield {**{n: decision[n] for n in names}, "repaired_sha256": sha.hexdigest()}
                    sha, lead = hashlib.sha256(), ""
                else:
                    sha.update(f"{lead}{turn['role']}:{turn['text']}".encode())
                    lead = "\n"

        return _some(out(), arrow)

    return _with_rows(rows, decided, copies).mapInArrow(write, schema)
