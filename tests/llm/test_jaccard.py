"""Jaccard components against all pairs of sets."""

import random

import pytest

from ratewell.llm import jaccard
from ratewell.llm.components import connected


def brute(rows, width=4, percent=85):
    def sets(text):
        w = tuple(x.decode() for x in (text or "").encode().lower().split())
        return {w} if 0 < len(w) < width else {w[i:i + width] for i in range(len(w) - width + 1)}

    own = [(i, sets(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in own if i is not None)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 10, 12, 20, 40, 90, 200, 420]))]
        if g % 4 == 0:
            base = base[:20] + passage + base[20:]
        text = list(base)
        for _ in range(rng.randint(1, 7)):
            rows.append((len(rows), " ".join(text)))
            text = list(text if rng.random() < .7 else base)
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = "new%d" % rng.randint(0, 999)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_against_all_pairs(frame, seed):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in jaccard.linked_components(frame(rows)).select("doc_id", "n_shingles", "component_id").collect())
    want = brute(rows)
    assert got == want
    assert len({w[2] for w in want}) < len(want) * .8


@pytest.mark.parametrize("heavy_from", [1, 10_000])
def test_any_boundary_is_whole(frame, monkeypatch, heavy_from):
    monkeypatch.setattr(jaccard, "boundary", lambda *a: heavy_from)
    rows = corpus(3)[:50]
    got = sorted(tuple(r) for r in jaccard.linked_components(frame(rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [5])
def test_long_lists_go_by_deviations(frame, monkeypatch, seed):
    """One group of near copies in which many pairs are just below or above the limit, and the mixed corpus."""
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "STARS", 1)
    rng = random.Random(seed)
    base, rows = ["b%d" % k for k in range(80)], []
    for k in range(70):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.choice([3, 17, 40, 41, 60, 79, rng.randrange(80)])] = "n%d" % rng.randint(0, 3)
        rows.append((k, " ".join(text[rng.randint(0, 3):])))
    rows += [(100 + i, text) for i, text in corpus(seed)[:60]]
    got = sorted(tuple(r) for r in jaccard.linked_components(frame(rows)).collect())
    want = brute(rows)
    assert got == want
    assert 3 < len({c for i, _, c in want if i < 70}) < 60


def test_boundary_counts_both_keys_near_it():
    """Long sets never get 2-subsets, also not as the neighbours of the boundary."""
    for lengths in ({1: 5, 5: 1, 28_672: 3}, {40: 10_000, 28_672: 1}, {28_672: 1}):
        assert not jaccard.is_light(28_672, 85, jaccard.boundary(0.5, lengths, 85))
    assert jaccard.is_light(8, 85, jaccard.boundary(50.0, {8: 1000, 28_672: 3}, 85))


def test_odd_rows(frame):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE "), (6, "a b c"), (7, "a b"), (8, "A\x0bB c"), (9, long), (10, long + " y"),
            (11, long.upper()), (12, "é É"), (13, "É É"), (4, "one"), (None, "a b c"), (20, "a b"), (21, "p q r s t u v w")]
    got = sorted(tuple(r) for r in jaccard.linked_components(frame(rows)).where("doc_id is not null").collect())
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 6), (9, 29997, 9),
                          (10, 29998, 9), (11, 29997, 9), (12, 1, 12), (13, 1, 13), (20, 1, 7), (21, 5, 21)])
    assert jaccard.linked_components(frame(rows).limit(0)).count() == 0
    kept = jaccard.one_of_each(frame(rows))
    assert kept.dtypes == frame(rows).dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 2 3 4 4 6 7 9 12 13 21 None".split())


def test_a_document_of_several_texts(frame):
    """A document that is a copy by one of its texts keeps the links of the others, and is one component."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (12, c), (13, c), (13, "b"), (14, "b"), (20, c + " more")]
    got = sorted(tuple(r) for r in jaccard.linked_components(frame(rows)).collect())
    assert got == brute(rows) and {(i, c) for i, _, c in got} == {(1, 1), (5, 1), (9, 1), (12, 12), (13, 12), (14, 12), (20, 12)}


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in connected(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
