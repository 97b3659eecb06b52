"""Conversation repair: plans against a search over all edits, and the operator against a slow version."""

import hashlib
import random
import re
from heapq import heappop, heappush

import pytest

from auditlake.llm import repair
from auditlake.llm.queries import REPAIR_SQL, op13_repair
from tests.compare import rows as compared

SCHEMA = "conv_id long, turn long, role string, text string"


def search(symbols):
    """Cheapest edits, ASCII-least among these, by uniform-cost search over (cost, audit)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heappop(heap)
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        state = (i, roles[-1:], bool(roles))
        if (*state, audit) in done:
            continue
        done.add((*state, audit))
        fits = lambda r: re.fullmatch("s?(ua)*u?", roles + r) is not None
        for r in "ua":
            if fits(r) and len(audit) < 3 * len(symbols) + 3:
                heappush(heap, (cost + 5, audit + "I", i, roles + r))
        if i < len(symbols):
            s = symbols[i]
            heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if s != "x":
                more = 5 if s.isupper() else 0
                if s.lower() in "sua" and fits(s.lower()):
                    heappush(heap, (cost + more, audit + "K", i + 1, roles + s.lower()))
                for r in "ua":
                    if fits(r):
                        heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + r))


def runs_of(symbols):
    out = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1] = (s, out[-1][1] + 1)
        else:
            out.append((s, 1))
    return out


@pytest.mark.parametrize("alphabet", ["suax", "ua", "uUaAx", "soOSuA"])
def test_plans_are_the_least(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(60):
        symbols = "".join(r.choice(alphabet) * r.choice([1, 1, 1, 2, 3]) for _ in range(r.randrange(0, 4)))
        assert repair.plan(runs_of(symbols)) == search(symbols), symbols


def stepwise(symbols):
    """The same programme row by row, without runs."""
    cost, letters, state, behind = 0, "", 0, [repair.END]
    for s in reversed(symbols):
        behind.append(repair._times(repair.power(s, 0), behind[-1]))
    cost = behind[-1][0]
    for s, after in zip(symbols, behind[-2::-1]):
        made, state = repair._step(s, state, after)
        letters += made
    while state not in repair.ENDING:
        letters, state = letters + "I", repair.READ[repair.DUE[state], state]
    return cost, letters


def test_long_runs():
    for runs in ([("u", 1000), ("a", 777)], [("x", 5000), ("u", 1), ("a", 1)], [("s", 33), ("U", 64), ("x", 3), ("A", 100), ("o", 17)], [("u", 9000)]):
        assert repair.plan(runs) == stepwise("".join(s * n for s, n in runs)), runs
    cost, audit = repair.plan([("x", 3_000_000), ("u", 1), ("a", 1)])
    assert cost == 6_000_000 and audit == "D" * 3_000_000 + "KK"


def slow(rows):
    """Results and repaired turns by conversation, with the row-by-row programme."""
    out = {}
    chats = {}
    for r in rows:
        chats.setdefault(r[0], []).append(r)
    for conv, chat in chats.items():
        key = lambda r: hashlib.sha256(((r[2] or "") + "\0" + (r[3] or "")).encode()).digest()
        chat.sort(key=lambda r: (r[1] is not None, r[1] or 0, key(r)))
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in chat:
            bare, initial = (text or "").strip(" \t\n\x0b\x0c\r"), (role or "")[:1]
            fault = "blank" if not bare else "duplicate" if (role or "", text or "") in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role or "", text or ""))
            if fault:
                counts[fault] += 1
            symbol = initial if initial and initial in "sua" else "o"
            symbols += "x" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
        initials = [(r[2] or "")[:1] for r in chat]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in chat if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = stepwise(symbols)
        left, at, due = [], 0, "u"
        for letter in audit:
            role, text = ("", "") if letter == "I" else (chat[at][2], chat[at][3])
            at += letter != "I"
            if letter == "D":
                continue
            role = role if letter == "K" else repair.ROLE[due]
            left.append((role, text or ""))
            due = "u" if role[0] in "sa" else "a"
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, left)
    return out


def test_equals_slow_version(spark):
    r = random.Random(8)
    texts = ["Hello there.", "Fine!", "cut off", "", " \n", None, "ok?\n", "ünïcode 文.", "x" * 5000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randrange(1, 12)):
            rows.append((conv, r.choice([turn, turn, None, turn + 3]), r.choice(["user", "assistant", "assistant", "system", "tool", "", None]), r.choice(texts)))
    rows += rows[:20]
    given = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as key", "2 as blank", "3 as n", "'a' as audit", "4 as planned", "5 as first", "6 as _conv", "7 as pos")
    planned = repair.plans(given)
    want = slow(rows)
    got = {x.conv_id: tuple(x)[1:] for x in planned.collect()}
    assert got == {c: v[:-1] for c, v in want.items()}
    left = {}
    for x in repair.repaired(given, planned).collect():
        left.setdefault(x.conv_id, []).append((x.pos, x.role, x.text))
    assert {c: [(i, *t) for i, t in enumerate(v[-1])] for c, v in want.items() if v[-1]} == {c: sorted(v) for c, v in left.items()}
    hashed = {x.conv_id: x.sha256 for x in repair.digests(repair.repaired(given, planned)).collect()}
    assert hashed == {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in v[-1]).encode()).hexdigest() for c, v in want.items() if v[-1]}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in v[-1])) for v in want.values())


def test_one_long_conversation_and_none(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(20_001)] + [(2, 5, "user", "same.")] * 3000
    given = spark.createDataFrame(rows, SCHEMA)
    got = {x.conv_id: x for x in repair.plans(given).collect()}
    assert got[1].cost == 2 and got[1].audit.count("D") == 1 and len(got[1].audit) == 20_001
    assert (got[2].duplicate, got[2].illegal, got[2].cost) == (2999, 2999, 6000) and got[2].audit == "D" * 3000
    assert repair.plans(given.limit(0)).count() == 0 and repair.repaired(given.limit(0), repair.plans(given.limit(0))).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    r = random.Random(4)
    texts = ["Hello there.", "Fine!", "cut off", "", " \n", None, "ok?\n", "Yes. No!"]
    rows = [(conv, r.choice([t, t, t, t, None]), r.choice(["user", "assistant", "system", "tool", None]), r.choice(texts)) for conv in [*range(120), None] for t in range(r.randrange(1, 8))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = op13_repair(spark, str(tmp_path)).toPandas()
    assert len(got) == 121 and compared(got) == compared(con.execute(REPAIR_SQL).df())
