"""Structure repair against a plain search over all edits, and on conversations of every kind."""

import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import pytest

from ratewell.llm import structure

SCHEMA = "conv_id long, turn int, role string, text string, pos string, symbol string, gone boolean"


def cheapest(rows):
    """(cost, edits, repaired rows) of rows (role, text, fault): every edit sequence is tried, by state."""
    onward = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @lru_cache(None)
    def best(k, state, inserted):
        found = []
        if k == len(rows) and state in "a":  # also the start
            found.append((0, "", ()))
        if inserted < 2:
            role = onward[state]
            cost, edits, lines = best(k, role[0], inserted + 1)
            found.append((cost + 3, "I" + edits, (role + ":", *lines)))
        if k < len(rows):
            role, text, fault = rows[k]
            cost, edits, lines = best(k + 1, state, 0)
            found.append((cost + 4, "D" + edits, lines))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                cost, edits, lines = best(k + 1, onward[state][0], 0)
                found.append((cost + 3 + late, "R" + edits, (f"{onward[state]}:{text}", *lines)))
                if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                    cost, edits, lines = best(k + 1, role[0], 0)
                    found.append((cost + late, "K" + edits, (f"{role}:{text}", *lines)))
        return min(found, default=(10 ** 9, "~", ()))

    return best(0, "", 0)


def plain(rows):
    """Reports by the rules as they stand; rows are (conv_id, turn, role, text)."""
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        own = conversations[conv_id]
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv_id, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faulty = [t for t, *_ in own if t is not None], set(), []
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faulty.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
            seen.add((role, text))
        faults = [f for *_, f in faulty]
        cost, edits, lines = cheapest(tuple(faulty))
        out.append((conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, structure.FAULTS),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:])), cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines))
    return sorted(out, key=str)


def corpus(seed, n):
    chance, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(chance.choice([1, 2, 3, 5, 8, 13, 40])):
            role = chance.choices(["user", "assistant", "system", "tool", "", None, "Assistant", "ua"], [40, 40, 8, 3, 1, 1, 1, 1])[0]
            text = chance.choice(["Well.", "ja\n", "", " \x0b", "Why? ", None, f"Text {turn}.", f"Text {turn}", "ü!\x00", "same.", "日本。"])
            rows.append((conv, chance.choice([turn, turn, turn, turn + 5, None]), role, text))
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (7_000_000_000, 1, "user", "x" * 300_000 + ".")]
    return rows + [(n + 5, None, "system", "only"), (n + 6, 2 ** 31 - 1, "user", "a."), (n + 6, -(2 ** 31), "user", "a.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "s", None) for r in rows], SCHEMA).repartition(5)


def test_like_the_plain_search(spark):
    rows = corpus(1, 160)
    got = structure.repair_report(structure.damaged(frame(spark, rows)))
    assert got.columns == ["conv_id", *structure.COUNTS, "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [r[:-1] for r in plain(rows)]


def test_repaired_rows_are_sound_and_streamed_in_order(spark):
    rows = corpus(2, 40)
    placed = structure.marked(structure.damaged(frame(spark, rows)))
    repaired = defaultdict(list)
    for r in sorted(structure.repaired_rows(placed, structure.plans(placed)).collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(repaired[r.conv_id]) + 1
        repaired[r.conv_id].append((r.role, r.text))
    for conv_id, *_, lines in plain(rows):
        assert tuple(f"{a}:{b}" for a, b in repaired[conv_id]) == lines
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in repaired[conv_id]))


def test_a_long_conversation_and_none(spark):
    rows = [(1, i, ("user", "assistant")[i % 2] if i % 97 else "user", f"Line {i}.") for i in range(30_000)] + [(2, 0, "user", "Hi.")]
    got = {r.conv_id: r for r in structure.repair_report(structure.damaged(frame(spark, rows))).collect()}
    assert got[1].cost > 1000 and 28_000 < len(got[1].audit) < 33_000 and len(got) == 2
    assert structure.repair_report(structure.damaged(frame(spark, rows).limit(0))).count() == 0


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if crc32(f"5:{t}".encode()) % 20 == 0)
    row = structure.repair_report(structure.damaged(frame(spark, [(5, turn, "user", "a")]))).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_of_any_length(block):
    """The plan from block tables equals the plain search, ties included."""
    chance, tables = random.Random(block), structure.Tables(block)
    assert len(tables.vectors) < 100 and len(tables.to[0]) == structure.SYMBOLS ** block
    for _ in range(400):
        symbols = [chance.randrange(1, 10) for _ in range(chance.randrange(9))]
        rows = tuple(("x", "", "blank") if s == 1 else (("system", "user", "assistant", "tool")[(s - 2) // 2], "t", "truncated" if s % 2 else "") for s in symbols)
        assert tables.plan(np.array(symbols, np.uint8)) == cheapest(rows)[:2]
