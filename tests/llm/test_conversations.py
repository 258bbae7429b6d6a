"""Conversation repair against a plain one-sided search, short and in blocks."""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.brute import sha
from tideline.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(symbols):
    """Cost and audit by one search that orders paths by cost and audit."""
    pattern = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best, heap = {}, [(0, "", 0, "")]
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in best:
            continue
        best[i, last] = (cost, audit)
        after = {r: p for r, p in pattern[last].items()}
        for r in "ua":
            if r in after:
                heapq.heappush(heap, (cost + 2, audit + "I", i, after[r]))
        if i < len(symbols):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            s = symbols[i]
            if s != "x":
                cut = s.isupper()
                if s.lower() in after:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, after[s.lower()]))
                for r in "ua":
                    if r in after:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, after[r]))
    return min(best[len(symbols), q] for q in ("", "a") if (len(symbols), q) in best)


def plain_report(rows):
    """The contract of one conversation, from its present rows as (turn, role, text, copy)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))
    faults, seen = [], set()
    for _, role, text, _ in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not chars else "duplicate" if (role, text) in seen else "" if chars[-1] in ".!?" else "truncated"
        faults.append(fault)
        seen.add((role, text))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in rows]
    symbols = ""
    for initial, fault in zip(initials, faults):
        s = initial if initial in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else s.upper() if fault else s
    cost, audit = cheapest(symbols)
    out, i = [], 0
    for letter in audit:
        if letter != "D":
            out.append([rows[i][1] if letter == "K" else None, "" if letter == "I" else rows[i][2]])
        i += letter != "I"
    odd = len(out) % 2
    for k, message in enumerate(out):
        if message[0] is None:
            message[0] = ("user", "assistant")[(k - odd) % 2]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out))), [tuple(m) for m in out]


def plain_damage(rows):
    """Present rows per conversation; all conversations are keys."""
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        if kind:
            mine += [(turn, role, text, c) for c in ((0, 1) if kind == 3 else (0,))]
    return held


def odd_conversations():
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(40)]
    rows += [(2, None, "user", "no turn?"), (2, None, None, "x."), (2, 3, "tool", None), (2, 3, "tool", None)]
    rows += [(None, 0, "user", "null id."), (None, 7, "assistant", "y")]
    rows += [(3, t, "system", "again.") for t in range(12)] + [(4, t, "", "") for t in range(5)]
    rows += [(5, 2, "user", "a" * 50_000), (5, 2, "user", "a" * 50_000), (5, 9, "Assistant", "é漢.　")]
    rows += [(6, t, random.Random(t).choice(["user", "assistant", "system", "tool"]), f"t{t % 5}" + ".?"[t % 3 : t % 3 + 1]) for t in range(90)]
    # All rows of this one are lost: the checksum of its id and turn is divisible by 20.
    lost = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "gone.")] * 30


def test_both_heaps_find_what_one_finds():
    draw = random.Random(3)
    for _ in range(3_000):
        symbols = "".join(draw.choice("suaoSUAOx") for _ in range(draw.randint(0, 12)))
        assert C.search(symbols, C.START, C.ENDS) == cheapest(symbols), symbols


def test_tables_of_blocks_join_to_the_whole():
    draw = random.Random(4)
    for _ in range(200):
        symbols = "".join(draw.choice("uauauaUAsxo") for _ in range(draw.randint(2, 30)))
        cut = draw.randint(0, len(symbols))
        table = C.joined_tables(C.block_table(symbols[:cut]), C.block_table(symbols[cut:]))
        assert min(x for x in (table[C.START][e] for e in C.ENDS) if x) == cheapest(symbols)


@pytest.mark.parametrize("block", [2_000, 7, 1])
def test_reports_and_messages_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    monkeypatch.setattr(C, "JOINED", 3)
    rows = odd_conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "pos", "block", "copy_", "a.b"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    expected = {conv: plain_report(held) for conv, held in plain_damage(rows).items()}
    broken = C.damaged(df)
    found = {r.conv_id: tuple(r)[1:] for r in C.repair_report(broken).collect()}
    assert found == {conv: report for conv, (report, _) in expected.items()}
    messages = Counter((r.conv_id, r.place, r.role, r.text) for r in C.repaired_messages(broken).collect())
    assert messages == Counter((c, k, *m) for c, (_, out) in expected.items() for k, m in enumerate(out))


def test_rows_without_damage_and_empty_tables(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 5, "assistant", "c")]
    found = {r.conv_id: (r.cost, r.audit) for r in C.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: (0, "KK"), 2: (3, "D")}
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(C.damaged(empty)).collect() == [] and C.repaired_messages(empty).collect() == []
