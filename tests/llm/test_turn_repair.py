"""Conversation repair against plain search over edits, with short stretches, and on the cases that its docstring defines."""

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import turn_repair as T

LEGAL = re.compile(r"(s?(ua)+)?\Z")
KINDS = "suaoSUAOx"
ROWS = "conv_id long, turn long, role string, text string"


def plain_best(kinds):
    """Cheapest (cost, audit) by trying edits turn by turn over (roles so far in short, cost, audit) without matrices."""
    short = lambda r: r if len(r) < 2 else ("s" if r[0] == "s" else "") + ("ua" if r[-1] == "a" else "uau")
    live = {"": {(0, "")}}

    def grown(live):
        out = {k: set(v) for k, v in live.items()}
        for _ in range(3):
            for r, ways in list(out.items()):
                for c, a in list(ways):
                    if a.endswith("III"):
                        continue
                    for x in "ua":
                        if legal_start(r + x):
                            out.setdefault(short(r + x), set()).add((c + 2, a + "I"))
        return out

    def legal_start(r):
        return any(LEGAL.match(r + end) for end in ("", "ua", "a"))

    for kind in kinds:
        after = {}
        for r, ways in grown(live).items():
            for c, a in ways:
                more = [(r, 3, "D")]
                if kind != "x":
                    t = int(kind.isupper())
                    more += [(r + x, 2 + t, "R") for x in "ua"]
                    if kind.lower() != "o":
                        more.append((r + kind.lower(), t, "K"))
                for roles, cost, letter in more:
                    if legal_start(roles):
                        after.setdefault(short(roles), set()).add((c + cost, a + letter))
        live = {r: set(sorted(ways)[:40]) for r, ways in after.items()}
    return min(w for r, ways in grown(live).items() if LEGAL.match(r) for w in ways)


def best(kinds):
    end = T.product(T.segment_matrix(kinds), T.insertions())
    return min(x for x in (end[T.START], end[T.ASSISTANT]) if x)


def test_every_short_conversation():
    for n in (1, 2, 3):
        for kinds in itertools.product(KINDS, repeat=n):
            assert best("".join(kinds)) == plain_best(kinds)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=KINDS, min_size=4, max_size=9))
def test_longer_conversations(kinds):
    assert best(kinds) == plain_best(kinds)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=KINDS, min_size=3, max_size=30), st.integers(1, 29), st.integers(1, 29))
def test_product_is_associative(kinds, i, j):
    a, b, c = (T.whole([T.turn_matrix(k) for k in part] or [[(0, "") if x % 5 == 0 else None for x in range(16)]]) for part in (kinds[: min(i, j)], kinds[min(i, j) : max(i, j)], kinds[max(i, j) :]))
    assert T.product(T.product(a, b), c) == T.product(a, T.product(b, c))


def plain_repair(rows):
    """The whole contract in plain Python, one conversation's rows in order."""
    seen, kinds, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        initial = role[:1] if role[:1] in tuple("sua") else "o"
        kinds.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = best("".join(kinds))
    state, out, left = T.START, [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = T.NEXT[state]
            out.append(f"{T.ROLES[state]}:")
            continue
        _, role, text = next(left)
        if edit == "R":
            state = T.NEXT[state]
            out.append(f"{T.ROLES[state]}:{text}")
        elif edit == "K":
            state = {"s": T.SYSTEM, "u": T.USER, "a": T.ASSISTANT}[role[0]]
            out.append(f"{role}:{text}")
    return counts | {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def check(spark, rows):
    got = {r["conv_id"]: r.asDict() for r in T.repair(spark.createDataFrame(rows, ROWS), spark.createDataFrame([*rows, (77, 0, "user", "gone.")], ROWS)).collect()}
    plain = {}
    for conv, turn, role, text in rows:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    want = {c: {"conv_id": c} | plain_repair(sorted(x, key=key)) for c, x in plain.items()}
    empty = hashlib.sha256(b"").hexdigest()
    want[77] = {"conv_id": 77, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    assert got == want


def invented(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two! ", "three", "", " \t", None, f"own {t}?", "dots... and more"])
            rows.append((rng.choice([c, c, c, None]), rng.choice([t, t, t, t // 2, None]), role, text))
    return rows


def test_cases_and_long_conversations_in_short_stretches(spark, monkeypatch):
    check(spark, invented(1, 12, 9))
    monkeypatch.setattr(T, "SEGMENT", 3)
    monkeypatch.setattr(T, "FAN", 2)
    rows = invented(2, 3, 60) + [(50, k, "user", "Again and again.") for k in range(40)] + [(51, None, "assistant", "Same.")] * 30
    check(spark, rows)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Q?"), (1, 1, "user", "Q2?"), (1, 2, "assistant", "A"), (2, 0, "assistant", "A."), (3, 0, "tool", " ")], ROWS + "")
    judged = T.judge(rows)
    turns = T.repaired_turns(rows, judged)
    got = [(r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in turns.orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "user", "Q?"), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Q2?"), (1, 3, "K", "assistant", "A"), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "A.")]
    one, other = ({r["conv_id"]: r[1] for r in T.digests(t, o).collect()} for t, o in ((turns, True), (turns, False)))
    assert one == other and set(one) == {1, 2}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], ROWS)
    assert T.repair(empty, empty).collect() == []
    extra = spark.createDataFrame([(1, 0, "user", "long " * 50_000 + "end.", 9, "x"), (1, 1, "assistant", "Yes.", 8, "y")], ROWS + ", body long, audit string")
    assert T.repair(T.damaged(extra), extra).count() == 1


@pytest.mark.parametrize("how", range(20))
def test_damage(spark, how):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == how)
    got = [(r["role"], r["text"]) for r in T.damaged(spark.createDataFrame([(5, turn, "assistant", "Well. So! x")], ROWS)).collect()]
    plain = ("assistant", "Well. So! x")
    assert got == {0: [], 1: [("assistant", "")], 2: [("assistant", "Well So x")], 3: [plain] * 2, 4: [("user", "Well. So! x")]}.get(how, [plain])
