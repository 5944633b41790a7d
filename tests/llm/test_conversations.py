"""Repair of conversations against a plain recursion over (cost, audit)."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from folioforge.llm import conversations as C
from folioforge.llm import queries
from folioforge.session import table

SCHEMA = "conv_id long, turn long, role string, text string, digest string, kind int, copies2 int"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def order(row):
    """The order within a turn is by role and the digest that the operator documents."""
    _, turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def expect(rows):
    """One conversation, its rows damaged already, in order."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    # From the last row to the first: the least (cost, audit) after each role.
    best = {last: (0, "") if last in ("", "a") else None for last in NEXT}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            later, best = best, {}
            for last in NEXT:
                give = "a" if last == "u" else "u"
                ways = [(2, "D", last)]
                if faults[i] not in ("b", "d"):
                    more = 5 if faults[i] == "t" else 0
                    initial = rows[i][2][:1]
                    if initial and initial in NEXT[last]:
                        ways.append((more, "K", initial))
                    ways.append((1 + more, "R", give))
                best[last] = min(((c + later[x][0], e + later[x][1]) for c, e, x in ways if later[x]), default=None)
        for _ in range(3):  # more than two inserts at one place add whole exchanges for nothing
            for last in NEXT:
                then = best["a" if last == "u" else "u"]
                if then:
                    best[last] = min(filter(None, (best[last], (5 + then[0], "I" + then[1]))))
    cost, audit = best[""]
    out, i, last = [], 0, ""
    for e in audit:
        if e == "I":
            last = "a" if last == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[last])
            continue
        _, _, role, text = rows[i]
        i += 1
        if e == "D":
            continue
        if e == "R":
            last = "a" if last == "u" else "u"
            role = {"u": "user", "a": "assistant"}[last]
        last = role[0]
        out.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def compare(got, rows):
    convs = {r[0] for r in rows}
    hurt = damage(rows)
    assert len(got) == len(convs)
    for r in got:
        mine = sorted((h for h in hurt if h[0] == r["conv_id"]), key=order)
        want = expect(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == want, r["conv_id"]


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op11_conversation_repair(spark, sf_dir).collect(), rows)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 9) for r in rows], SCHEMA)


def talk(seed, convs, length):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "Fine", "", " \t", "A longer answer!", "cut off", "é.", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, length)):
            fine = rng.random() < 0.6
            role = ("user", "assistant")[turn % 2] if fine else rng.choice(roles)
            text = f"Turn {turn} of it." if fine else rng.choice(texts)
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn + rng.randrange(2), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", range(3))
def test_made_conversations(spark, seed):
    rows = talk(seed, 60, 14)
    compare(C.repair(C.damaged(made(spark, rows)), "copies").collect(), rows)


def test_long_conversation_over_many_partitions(spark):
    """One conversation has nearly all rows, so that partitions and segments cut it."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"Text {t}.", f"Text {t}.", f"cut {t}", ""])) for t in range(2500)]
    rows += [(c, 0, "user", "Alone.") for c in (0, 2)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        compare(C.repair(C.damaged(made(spark, rows)), "copies").collect(), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_composed_segments_equal_the_whole():
    rng = random.Random(9)
    for _ in range(60):
        codes = bytes(4 * rng.choice((0, 1, 1, 2, 2, 3)) + rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(rng.randrange(0, 24)))
        after = [(0, ()) if s in C.DONE else None for s in range(4)]
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(3))})
        for a, b in reversed(list(zip(cuts, cuts[1:], strict=False))):
            after = C.compose([C.solve(codes[a:b], e, frozenset((x,))) for e in range(4) for x in range(4)], after)
        assert (after[C.START][0], C.spelt(after[C.START][1])) == C.solve(codes, C.START, C.DONE)


def test_edges(spark):
    empty = C.repair(C.damaged(made(spark, [])), "copies")
    assert empty.collect() == [] and empty.columns[0] == "conv_id"
    rows = [(None, None, None, None), (5, 3, "system", "Only a rule."), (5, 3, "system", "Only a rule.")]
    got = {r["conv_id"]: r for r in C.repair(made(spark, rows)).collect()}
    assert got[None]["audit"] == "D" and got[None]["blank"] == 1 and got[None]["gaps"] == 0
    assert got[5]["audit"] == "DD" and got[5]["duplicate"] == 1 and got[5]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (2, 0, "system", "Rule."), (2, 1, "user", "Ask?"), (2, 2, "tool", "Answer.")]
    data = made(spark, rows)
    out = C.repaired_turns(data, C.decide(data)).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["place"], r["role"], r["text"], r["edit"]) for r in out] == [
        (1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Hello.", "R"),
        (2, 0, "system", "Rule.", "K"), (2, 1, "user", "Ask?", "K"), (2, 2, "assistant", "Answer.", "R"),
    ]
