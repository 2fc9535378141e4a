"""Conversation repair against edits that are tried one by one, and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarrylens.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (1 + (k == 3))
    return out


def cheapest(rows):
    """(cost, letters, repaired rows) of rows (role, fault, text) by a search over all edits, cheapest and then least first."""
    heap, n = [(0, "", 0, "", ())], len(rows)
    seen = set()
    while heap:
        cost, letters, i, shape, out = heapq.heappop(heap)
        if i == n and SHAPE.match(shape):
            return cost, letters, out
        if (cost, letters) in seen or not any(SHAPE.match(shape + rest) for rest in ("", "a", "ua", "uaua")):
            continue
        seen.add((cost, letters))
        for role in ("user", "assistant"):
            if letters[-3:] != "III":
                heapq.heappush(heap, (cost + 2, letters + "I", i, shape + role[0], (*out, f"{role}:")))
        if i < n:
            role, fault, text = rows[i]
            late = int(fault == "truncated")
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, shape, out))
            if fault in ("", "truncated"):
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + late, letters + "K", i + 1, shape + role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 2, letters + "R", i + 1, shape + new[0], (*out, f"{new}:{text}")))


def expected(table, damaged=True):
    groups = {conv: [] for conv, *_ in table}
    for r in damage(table) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in table]:
        groups[r[0]].append(r)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        seen, told, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in rows:
            body = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, fault, text))
            if fault:
                counts[fault] += 1
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        turns = {t for _, t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest(told)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def conversations(rng, n, most=6):
    rows = []
    for conv in range(n):
        role = rng.choice(["user", "user", "system", "assistant"])
        for turn in range(rng.randint(1, most)):
            text = rng.choice(["Yes.", "No", "  ", "Why?", "Because", "Well! \n", "a.b", f"t{rng.randint(0, 9)}."])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, text))
            role = rng.choice(["user", "assistant", {"user": "assistant"}.get(role, "user"), "system", "tool"])
    once = {}
    for r in rows:
        once.setdefault(r[:2], r)
    return list(once.values())


def test_steps_equal_a_search():
    rng = random.Random(1)
    signs = ["".join(repair.symbol(rng.choice("suat"), rng.choice(repair.FAULTS)) for _ in range(rng.randint(0, 6))) for _ in range(600)]
    trie = repair.Trie()
    role = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for s in sorted(set(signs)):
        cost, audit, _ = trie.answer(s)
        assert (cost, audit) == cheapest([(role[(ord(c) - 65) // 4], repair.FAULTS[(ord(c) - 65) % 4], "x") for c in s])[:2]
    assert trie.made < sum(map(len, set(signs)))  # beginnings are shared
    long = repair.symbol("u", "") * 30_000
    assert trie.answer(long + "P")[0] == 2 * 15_000 + 3


SCHEMA = "conv_id long, turn long, role string, text string, n long, audit string, conv string, Place long"


def test_repairs_and_repaired_rows(spark):
    rng = random.Random(5)
    table = conversations(rng, 400) + [(1000 + i, t, r, x) for i in range(50) for t, r, x in ((0, "user", "Same."), (1, "assistant", "Same too."))]
    rows = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in table], SCHEMA).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.repairs(rows).collect()}
    want = expected(table)
    assert got == {k: v[:-1] for k, v in want.items()}
    lines = defaultdict(list)
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: (r["conv_id"], r["place"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert dict(lines) == {k: list(v[-1]) for k, v in expected(table, damaged=False).items() if v[-1]}


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x" * 300_000 + "."), (None, 2, "assistant", "Yes."), (7, 1, "", "a."), (7, 2, "", ""), (7, 3, "Übung", "a "), (8, None, "user", "q?"), (8, None, "user", "q?"), (8, 4, "user", "q?"), (9, 0, "system", "  ")]
    odd = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in repair.repairs(odd).collect()}
    assert got == {k: v[:-1] for k, v in expected(rows).items()}
    assert repair.repairs(odd.limit(0)).collect() == [] and repair.repaired(odd.limit(0)).collect() == []
    gone = next(c for c in range(1000) if not damage([(c, 0, "user", "a.")]))
    only = spark.createDataFrame([(gone, 0, "user", "a.", None, None, None, None)], SCHEMA)
    assert tuple(repair.repairs(only).first())[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_read_by_many_tasks(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.random()}.") for t in range(6000)] + [(2, 0, "user", "a.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    signed = repair._signed(repair.damaged(table), 8)
    plan = signed._jdf.queryExecution().toString()
    assert "rangepartitioning(conv" in plan
    kept = damage(rows)
    signs = {r["conv"]: r for r in signed.collect()}
    assert len(signs["=1"]["signature"]) == sum(r[0] == 1 for r in kept)
    turns = {r[1] for r in kept if r[0] == 1}
    assert signs["=1"]["gaps"] == max(turns) - min(turns) + 1 - len(turns)
    row = repair.repairs(table).where("conv_id = 1").first()
    assert len(row["audit"]) - row["audit"].count("I") == len(signs["=1"]["signature"])


@pytest.mark.parametrize("text,blank,ended", [("", True, False), (" \t\n\x0b\x0c\r", True, False), ("\u0085", False, False), ("a.", False, True), ("a. \n", False, True), ("a. ", False, False), ("a\n.b", False, False)])
def test_faults_of_texts(spark, text, blank, ended):
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"rlike(t, r'{repair.BLANK}') AS b", f"rlike(t, r'{repair.ENDED}') AS e").first()
    assert (row["b"], row["e"]) == (blank, ended)
