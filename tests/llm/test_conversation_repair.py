import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from titleflow.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"


def least(rows, start=0, goals=(0, 3)):
    """The cheapest edits by taking up all partial ones, cheapest and ASCII-least first."""
    todo, seen = [(0, "", 0, start)], set()
    while todo:
        cost, audit, at, state = heapq.heappop(todo)
        if at == len(rows) and state in goals:
            return cost, audit
        if (at, state) in seen or cost > 3 * len(rows) + 30:
            continue
        seen.add((at, state))
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(todo, (cost + 5, audit + "I", at, after))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, state))
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                heapq.heappush(todo, (cost + 1 + more, audit + "R", at + 1, after))
                if initial == "xsua"[after] or (state == 0 and initial == "s"):
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, 1 if initial == "s" else after))
    return None


def harmed(rows):
    """Rows (id, turn, role, text) after damage, by conversation; ids of conversations without rows too."""
    out = {}
    for i, turn, role, text in rows:
        own = out.setdefault(i, [])
        role, text = (" " if v is None else v for v in (role, text))
        harm = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        own += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def plain(conversations):
    out = {}
    for i, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, count = set(), [], [0, 0, 0, 0]
        for _, role, text in rows:
            own = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not own else 2 if (role, text) in seen else 3 if own[-1] not in ".!?" else 0
            seen.add((role, text))
            count[fault] += 1
            symbols.append((role[:1], fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit = least(symbols)
        left, lines, state = iter(rows), [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit == "D":
                continue
            state = 1 if edit == "K" and role[:1] == "s" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
            lines.append(f"{role if edit == 'K' else ('user', 'assistant')[state - 2]}:{text}")
        out[i] = (gaps, *count[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines
    return out


def some_rows(n=300, seed=1, roles=("user", "assistant", "system", "tool", "", None, "ux")):
    draw = random.Random(seed)
    rows = []
    for i in [*range(n), None]:
        for turn in range(draw.randrange(0, 9)):
            text = draw.choice(["Fine.", "Yes!", "cut", " ", "", None, " ", "What? \n", f"No {draw.randrange(3)}."])
            rows.append((i, draw.choice([turn, turn, turn, None, turn + 3]), draw.choice(roles), text))
    return rows


@pytest.mark.parametrize("segment", [48, 3, 1])
def test_queries_operator_equals_brute_force(spark, monkeypatch, segment):
    """Nulls, ties, repeated rows, and conversations of which nothing is left."""
    rows = some_rows() + [(500, 0, "user", "One. " * 20_000 + "日本"), (500, 1, "assistant", "x" * 100_000 + ".")]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("other") for c in ("fault", "seen", "harm", "copy", "audit", "cost", "position", "row")})
    monkeypatch.setattr(repair, "SEGMENT", segment)
    harm, there = repair.damaged(df)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(harm, present=there).collect()}
    assert got == {i: r for i, (r, _) in plain(harmed(rows)).items()}
    left = harm.where(there)
    lines = {}
    for r in repair.rewritten(left, repair.repair(left)).orderBy("conv_id", "position").collect():
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {i: own for i, (_, own) in plain(harmed(rows)).items() if own}


def test_nothing_to_repair(spark):
    df = spark.createDataFrame([(1, 0, "system", "A."), (1, 1, "user", "B?"), (1, 2, "assistant", "C!")], SCHEMA)
    assert repair.repair(df).first()[1:8] == (0, 0, 0, 0, 0, 0, "KKK")
    assert repair.repair(df.where("false")).count() == 0
    rows, there = repair.damaged(df.where("false"))
    assert repair.repair(rows, present=there).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_search_between_all_states(seed):
    draw = random.Random(seed)
    for _ in range(150):
        rows = [(draw.choice("suaax"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randrange(0, 12))]
        for start in range(4):
            for goals in ({0}, {1}, {2}, {3}, {0, 3}):
                assert repair.cheapest(rows, start, frozenset(goals)) == least(rows, start, goals), (rows, start, goals)


def test_a_very_long_conversation():
    """Segments combine to what the whole would give, in bounded memory."""
    draw = random.Random(3)
    rows = [(k, draw.choice(["user", "assistant", "assistant", "system"]), f"t{k}" + draw.choice([".", ".", ".", ""])) for k in range(3000)]
    one = repair.Conversation()
    for turn, role, text in rows:
        one.add(turn, role, text, 0 if text.endswith(".") else 3)
        assert len(one.rows) <= repair.SEGMENT and all(len(w.edits) < 500 for w in one.ways.values())
    assert one.result() == plain({1: rows})[1][0]


def test_query_equals_brute_force(spark):
    from titleflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_conversation_repair"](spark, sf).collect()}
    assert got == {i: r for i, (r, _) in plain(harmed(rows)).items()}
