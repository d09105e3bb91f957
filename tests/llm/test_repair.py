import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import catalog, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(initials, faults):
    """Cheapest and then ASCII-least edits by a plain best-first search over (cost, edits)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit
        if (i, made[-1:]) in seen:
            continue
        seen.add((i, made[-1:]))
        new = "a" if made[-1:] == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, made + new))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made))
            if faults[i] != "x":
                cut = faults[i] == "t"
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, made + new))
                if made + initials[i] in ("s", "u") or made[-1:] + initials[i] in ("su", "ua", "au"):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, made + initials[i]))


def brute(rows):
    """The contract, row by row, over (conv_id, turn, role, text)."""
    blank = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            role, text = blank(role), blank(text)
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in left:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("x" if not core or (role, text) in seen else "t" if core[-1] not in ".!?" else "-")
            seen.add((role, text))
        n_blank = sum(not r[2].strip(" \t\n\x0b\x0c\r") for r in left)
        initials = [r[1][:1] or " " for r in left]  # an empty role is never kept
        cost, audit = cheapest(initials, faults)
        made, at = [], 0
        for e in audit:
            last = made[-1][0][:1] if made else ""
            if e == "I":
                made.append(("assistant" if last == "u" else "user", ""))
                continue
            if e == "K":
                made.append(left[at][1:])
            elif e == "R":
                made.append(("assistant" if last == "u" else "user", left[at][2]))
            at += 1
        turns = [r[0] for r in left if r[0] is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n_blank, faults.count("x") - n_blank,
                     faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest())
    return out


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(catalog.op12_conversation_repair(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_odd_conversations(spark):
    r = random.Random(6)
    texts = ["Yes.", "No", "", " \n", None, "Why?", "a. b", "ends. \t", "é!"]
    rows = [(conv, r.choice([None, k, k, k + r.randint(0, 9)]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
             r.choice(texts) if r.random() < 0.5 else f"turn {k}.") for conv in [*range(120), None] for k in range(r.randint(1, 9))]
    rows += [(1000 + k, 0, "user", "Alone.") for k in range(100)]
    rows += [(500, k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for k in range(150)] + [(501, 1, "user", "Same.")] * 9
    frame = spark.createDataFrame([(*x, 7, "z") for x in rows], SCHEMA + ", present int, again string")
    result = got(repair.repair_conversations(repair.damaged(frame)))
    assert result == brute(rows)
    lost = [x for x in result.values() if x == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert lost  # conversations that lost every row are still returned
    assert repair.repair_conversations(repair.damaged(frame.limit(0))).count() == 0


def test_search_equals_best_first():
    r = random.Random(2)
    for _ in range(4000):
        n = r.randint(0, 10)
        initials, faults = [r.choice("suuaa ") for _ in range(n)], "".join(r.choice("--t-x") for _ in range(n))
        assert repair.cheapest_edits(initials, faults, 0, frozenset({0, 3}))[:2] == cheapest(initials, faults)


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_join_to_the_whole(monkeypatch, piece):
    r = random.Random(piece)
    for _ in range(200):
        rows = [(k, r.choice(["system", "user", "assistant", " "]), f"t{k}.", r.choice(["none"] * 3 + ["blank", "truncated"])) for k in range(r.randint(0, 12))]
        out = []
        for size in (piece, 100):
            monkeypatch.setattr(repair, "PIECE", size)
            one = repair._Repair(1)
            for row in rows:
                one.add(*row)
            out.append(one.result())
        assert out[0] == out[1]


def test_long_and_broken(spark):
    text = "word " * 200_000
    rows = [(1, k, "user", f"{text}{k}.") for k in range(3)] + [(2, k, "user", f"{k}.") for k in range(3000)]
    result = got(repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, SCHEMA))))
    assert set(result) == {1, 2} and result[2][5] > 2500 and set(result[2][6]) <= set("DIKR")
