"""Repair of conversations against trying all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tarnwell.llm import conversations as C

SPACES = " \t\n\x0b\x0c\r"


def all_edits(signature, most=4):
    """Best (cost, audit) over every way to keep, rerole, delete and insert, with up to ``most`` inserts."""
    best = None
    choices = []
    for c in signature:
        own = [("D", 4, "")]
        if c != "-":
            more = 3 * c.isupper()
            own += [("K", more, c.lower())] + [("R", 3 + more, r) for r in "ua"]
        choices.append(own)
    gaps = range(len(signature) + 1)
    inserts = [x for n in range(most + 1) for x in itertools.combinations_with_replacement(gaps, n)]
    for picked in itertools.product(*choices):
        for where in inserts:
            for roles in itertools.product("ua", repeat=len(where)):
                audit, out, cost = "", "", 0
                for g in gaps:
                    for w, r in zip(where, roles):
                        if w == g:
                            audit, out, cost = audit + "I", out + r, cost + 3
                    if g < len(signature):
                        audit, out, cost = audit + picked[g][0], out + picked[g][2], cost + picked[g][1]
                if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def solved(signature):
    return C.best_end(list(C.product(C.INSERTS, C.solve(signature))[: C.STATES]))


def test_signatures_against_all_edits():
    rng = random.Random(9)
    for n in range(4):
        every = ["".join(x) for x in itertools.product("suaxSUAX-", repeat=n)]
        for s in every if n < 3 else rng.sample(every, 60):
            assert solved(s) == all_edits(s), s


def test_solutions_of_parts_combine():
    rng = random.Random(10)
    for _ in range(200):
        s = "".join(rng.choice("suaxSUAX-ua") for _ in range(rng.randint(1, 40)))
        cut = rng.randint(0, len(s))
        assert C.product(C.solve(s[:cut]), C.solve(s[cut:])) == C.solve(s)


def forward(signature):
    """An independent pass from left to right over sets of (state, cost, audit)."""
    here = {"": (0, "")}
    grow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def add(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    def inserted(ways):
        for _ in range(2):
            for state, (cost, audit) in list(ways.items()):
                add(ways, grow[state], (cost + 3, audit + "I"))
        return ways

    for c in signature:
        here, there = inserted(here), {}
        for state, (cost, audit) in here.items():
            add(there, state, (cost + 4, audit + "D"))
            if c != "-":
                more, role = 3 * c.isupper(), c.lower()
                if role == grow[state] or role == "s" and state == "":
                    add(there, role, (cost + more, audit + "K"))
                add(there, grow[state], (cost + more + 3, audit + "R"))
        here = there
    here = inserted(here)
    return min(here[x] for x in ("", "a") if x in here)


def brute(rows, ids, with_damage=True):
    """What the contract says, conversation by conversation."""
    per = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        if with_damage:
            op = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if op == 0:
                continue
            text = "" if op == 1 else re.sub("[.!?]", "", text) if op == 2 else text
            role = "user" if op == 4 else role
            per[conv] += [(turn, role, text)] * (2 if op == 3 else 1)
        else:
            per[conv].append((turn, role, text))
    out = []
    for conv in ids:
        own = sorted(per[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, signature, count = set(), "", dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in own:
            shown = text.rstrip(SPACES)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            i = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "-" if fault in ("blank", "duplicate") else i.upper() if fault else i
        illegal = sum((a[1][:1] or "x") + (b[1][:1] or "x") not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = forward(signature)
        said, k, j = [], 0, 0
        for letter in audit:
            role, text = (own[j][1], own[j][2]) if letter != "I" else ("", "")
            j += letter != "I"
            if letter == "D":
                continue
            system = letter == "K" and role[:1] == "s"
            said.append(f"{role if letter == 'K' else ('user', 'assistant')[k % 2]}:{text}")
            k += not system
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, audit int, kind string, head int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)


def table(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what?", "cut off", "", " \n", None, "é…", "a. \t", "x ", "end. ", "0" * 3000 + "."]
    rows = [(conv, rng.choice([None, t, t, t, t + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for conv in [*range(n), None] for t in range(rng.randint(1, 9))]
    return [*rows, *rows[:7]]


@pytest.mark.parametrize("bits", [12, 2])
def test_digests_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "SEGMENT_BITS", bits)
    rows = table(bits)
    got = C.digests(C.damage(frame(spark, rows)), frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, {r[0] for r in rows})


def test_one_long_conversation_spans_segments_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_BITS", 4)
    rng = random.Random(6)
    rows = [(7, i // 2 * 3, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {i}.", f"text {i}", "same.", ""])) for i in range(700)]
    rows += [(i, 0, "user", "hi.") for i in range(300) if i != 7]
    parts = C.segments(C.coded(C._rows(frame(spark, rows))))
    assert parts.where("conv_id = 7").count() >= 40 and max(len(r.signature) for r in parts.collect()) <= 16
    got = C.digests(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, {r[0] for r in rows}, False)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "tool", "cut"), (2, 0, "user", " ")]
    got = sorted(tuple(r) for r in C.repair(frame(spark, rows)).collect())
    assert got == [(1, 0, "K", 0, "system", "Be brief."), (1, 1, "I", None, "user", ""), (1, 2, "K", 1, "assistant", "Hello.")]
    assert [(r.conv_id, r.cost, r.audit) for r in C.audits(frame(spark, rows)).orderBy("conv_id").collect()] == [(1, 11, "KIKDD"), (2, 4, "D")]


def test_repaired_rows_are_legal(spark):
    rows = table(5)
    repaired = defaultdict(list)
    for r in C.repair(frame(spark, rows)).collect():
        repaired[r.conv_id].append(r)
    for own in repaired.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[:1] for r in own))


def test_empty_and_lost_conversations(spark):
    none = frame(spark, [])
    assert C.digests(C.damage(none), none).collect() == [] and C.repair(none).collect() == [] and C.audits(none).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "hi."), (gone, 0, "user", "hi.")]
    assert [tuple(r) for r in C.digests(C.damage(frame(spark, rows)), frame(spark, rows)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", " " * 1_000_000 + "a."), (1, 2, "user", " " * 1_000_000)]
    got = C.digests(frame(spark, rows)).collect()
    assert [tuple(r) for r in got] == brute(rows, {1}, False)
