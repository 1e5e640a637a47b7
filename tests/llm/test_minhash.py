"""MinHash near-dedup against all pairs of full sets."""

import random

import numpy as np
import pytest

from ratewell.llm import minhash


def brute(rows, width=2, percent=80):
    """Links of all pairs, components by repeated relabelling; rows of one doc_id are one document with several texts."""
    def shingles(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and a != b
             and x and y and 100 * len(x & y) >= percent * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    out = []
    for i, s in sets:
        equal = [label[j] for j, t in sets if j is not None and s and t == s]
        component = label[i] if i is not None else min(equal, default=None)
        out.append((i, len(s), component, i == component))
    return sorted(out, key=str)


def ran(frame, rows, **options):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame(rows), **options).collect()), key=str)


def corpus(seed, n=90):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n // 3):
        own = chance.choices(words, k=chance.choice([1, 2, 3, 5, 6, 12, 40, 150]))
        rows.append(own)
        for _ in range(2):
            copy = list(own)
            for _ in range(chance.randrange(0, 1 + len(own) // 15)):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            rows.append(copy)
    ids = chance.sample(range(10_000), len(rows))
    return [(i, chance.choice([" ", "\n", "\t "]).join(r).replace("w1", chance.choice(["W1", "w1"]))) for i, r in zip(ids, rows)]


def drifting(n=60, size=60, keep=4):
    """One text after another, each with a few words changed: long chains and one key with many components."""
    chance, words, rows = random.Random(3), [f"k{i}" for i in range(size)], []
    for i in range(n):
        if i % keep == 0:
            words = [f"k{j}" if chance.random() < 0.8 else f"x{i}{j}" for j in range(size)]
        else:
            words = [x if chance.random() > 0.04 else f"y{i}" for x in words]
        rows.append((1000 - i, " ".join(words)))
    return rows


@pytest.mark.parametrize("rows,options", [
    (corpus(1), {}), (corpus(2), {"width": 5}), (corpus(3), {"percent": 95}), (drifting(), {}),
    ([(1, "a b c"), (5, "a b c"), (5, "p q r s t u v w x y z"), (9, "p q r s t u v w x y z z")], {"percent": 80}),
    ([(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (6, "Ä"), (7, "ä"), (8, "a  b"), (8, "a  b"), (3, " ")], {})],
    ids=["mixed", "five words", "95 percent", "drifting", "several texts", "edges"])
def test_like_all_pairs(frame, rows, options):
    got = ran(frame, rows, **options)
    assert got == brute(rows, options.get("width", 2), options.get("percent", 80))


def test_search_in_steps_and_blocks(frame, monkeypatch):
    """Blocks of few nodes and one partner at a time find the same links."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "FAN", 1)
    monkeypatch.setattr(minhash, "WIDER", 2)
    rows = drifting(40, 50, 3)
    assert ran(frame, rows) == brute(rows)


def test_no_rows_and_long_text(frame):
    assert minhash.near_duplicates(frame([(1, "a")]).limit(0)).count() == 0
    long = " ".join(f"u{i}" for i in range(300_000))
    assert ran(frame, [(3, long), (2, long + " end"), (9, "u1 u2 u3")]) == [(2, 300_000, 2, True), (3, 299_999, 2, False), (9, 2, 9, True)]


@pytest.mark.parametrize("n", [3, 40, 400, 1024, 1500, 6000])
@pytest.mark.parametrize("share", [0.8, 0.9])
@pytest.mark.parametrize("subset", [True, False])
def test_sketch_tells_similarity_and_never_loses_an_alike_pair(n, share, subset):
    chance = np.random.default_rng(4)
    for _ in range(60):
        pool = minhash.mixed(chance.integers(1, 1 << 63, 2 * n, np.uint64))
        a = pool[:n]
        if subset:
            b = pool[:-int(-n * share // 1)]
        else:
            common = -int(-2 * n * share / (1 + share) // 1)
            b = np.r_[pool[:common], pool[n:2 * n - common]]
        left, right = (minhash.odd_sketch(np.sort(x))[None] for x in (a, b))
        sizes = np.array([float(len(a))]), np.array([float(len(b))])
        bits, may = minhash.alike(*sizes, left, right, 80)
        assert may[0] and bits[0] <= minhash.apart_limit(*sizes, 80)[0]
        if n in (400, 1024) and not subset:
            c = pool[:n], np.r_[pool[:int(2 * n * 0.66 / 1.66)], pool[n:2 * n - int(2 * n * 0.66 / 1.66)]]
            assert not minhash.alike(sizes[0], sizes[0], *(minhash.odd_sketch(x)[None] for x in c), 80)[1][0]  # 66 of 100 is told apart


def test_nearest_by_definition():
    chance = np.random.default_rng(8)
    m = 120
    keys, node, label = np.sort(chance.integers(0, 6, m)), np.arange(m), chance.integers(0, 4, m)
    low = high = block = np.zeros(m, np.int64)
    main = np.array([np.bincount(label[keys == k]).argmax() for k in keys])
    n, base = chance.integers(80, 120, m), chance.integers(0, 1 << 63, 16, np.uint64)
    sketch = np.array([base ^ (np.uint64(1) << np.uint64(chance.integers(0, 60))) * np.uint64(chance.integers(0, 4)) for _ in range(m)])
    for fan in (1, 3, 200):
        got = list(zip(*(x.tolist() for x in minhash._nearest(keys, low, high, block, node, n, label, main, sketch, 80, fan))))
        want = []
        for i in range(m):
            found = []
            for j in range(m):
                own = label[i] != main[i] and (label[j] == main[j] or i > j)
                bits, may = minhash.alike(n[[i]].astype(float), n[[j]].astype(float), sketch[[i]], sketch[[j]], 80)
                if keys[i] == keys[j] and label[i] != label[j] and own and may[0]:
                    found.append((int(bits[0]), j))
            want += [(i, j, b) for b, j in sorted(found)[:fan]]
        assert sorted(got) == sorted(want) and want


def test_large_component_is_sent_once(spark, monkeypatch):
    """Nodes of a key's largest component are copied for blocks of others only; no pair of different components is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 10)
    for loners in (6, 35):
        # 200 nodes in component 0, each loner its own; sketches all equal, so every pair may be alike
        nodes = spark.createDataFrame([(k, 100, [0] * 16) for k in range(200 + loners)], "node long, n int, sketch array<long>")
        lists = nodes.selectExpr("7L as key", "node")
        labels = spark.createDataFrame([(k, 0) for k in range(200)], "node long, label long")
        monkeypatch.setattr(minhash, "PAIRS", 500)
        found = [frozenset((r.a, r.b)) for r in minhash.nearest_of_others(lists, nodes, labels, 80, 10_000).collect()]
        assert set(found) == {frozenset((a, b)) for a in range(200, 200 + loners) for b in range(200 + loners) if b != a}
        assert len(set(found)) == len(found)
        few = minhash.nearest_of_others(lists, nodes, labels, 80, 3).groupBy("a").count().collect()
        assert {(r.a, r["count"]) for r in few} == {(a, 4) for a in range(200, 200 + loners)}
        others = -(-loners // 10)
        assert minhash.cells(lists, nodes, labels).count() == 200 * others + loners * (minhash.CELLS + others - 1)
