"""Conversation repair against the cheapest edits by Dijkstra over whole audits, on random and on given conversations."""

import hashlib
import heapq
import random
import zlib

import pytest

from imgspark.llm import conversation_repair as C

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, must_go, truncated): whole audits leave a heap by cost, then ASCII order."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        due = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, due[0], (*out, f"{due}:")))
        if i == len(rows):
            continue
        role, text, must_go, truncated = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
        if not must_go:
            heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, due[0], (*out, f"{due}:{text}")))
            if role[:1] == due[0] or (role[:1] == "s" and last == ""):
                heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))


def by_hand(table, damage=True):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20 if damage else 19
        if d == 0:
            continue
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        role = "user" if d == 4 else role
        rows += [(turn, role, text)] * (2 if d == 3 else 1)
    result = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:40].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in rows if t is not None]
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.strip(BLANK)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, out = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(result, key=str)


def random_table(seed, convs=60, longest=14):
    r, table = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = r.choice(["One.", "Two!", "Three?", "cut off", "", " \n", None, "é ü.", "\x1f", "x" * 3000 + "."])
            table.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    return table


def frame(spark, table):
    return spark.createDataFrame(table, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("long_rows", [256, 3])
@pytest.mark.parametrize("block", [16, 2])
def test_conversations_are_repaired_as_by_hand_at_any_size_of_block(spark, monkeypatch, long_rows, block):
    monkeypatch.setattr(C, "BLOCK", block)
    table = random_table(block + long_rows)
    got = C.repair_conversations(frame(spark, table), long_rows=long_rows).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(table)


def test_rows_in_a_third_of_the_table_stand_in_one_conversation(spark):
    r = random.Random(5)
    table = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), f"{r.randrange(9)}" + r.choice([".", ""])) for t in range(300)]
    table += [(i, 0, "user", "Alone.") for i in range(100, 700)]
    got = C.repair_conversations(frame(spark, table), long_rows=50, damage=False).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(table, damage=False)


def test_short_and_long_ways_agree_on_the_given_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    a, b = (sorted(map(tuple, C.repair_conversations(given, long_rows=n).collect()), key=str) for n in (256, 2))
    assert a == b == by_hand([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])


def test_defined_cases(spark):
    assert C.repair_conversations(frame(spark, [])).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = C.repair_conversations(frame(spark, [(dropped, 0, "user", "Hello.")]).withColumn("copies", C.F.lit("mine")).withColumn("cost", C.F.lit(-1))).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_search_is_the_cheapest_and_ascii_least():
    r = random.Random(3)
    for _ in range(1500):
        rows = "".join(r.choice("suaxSUAX-uaua") for _ in range(r.randrange(12)))
        full = [({"s": "system", "u": "user", "a": "assistant", "x": "x"}.get(c.lower(), "user"), "", c == "-", c.isupper()) for c in rows]
        assert C.repair(rows) == cheapest(full)[:2], rows
