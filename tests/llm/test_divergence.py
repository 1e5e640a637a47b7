"""Source divergence against a plain version: every group, every kept term, every rank."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratewell.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, uses string, term int, rank string"


def plain(rows, least_docs, top):
    """Rows of (text, lang, source), by the rules as they stand."""
    groups, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(found)
        holders[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holders[lang].items() if n >= least_docs]

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = Counter()
        own = {s: c for (x, s), c in groups.items() if x == lang}
        for c in own.values():
            whole.update(c)
        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, t.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, t) in enumerate(found)]
    return out


def corpus(seed=5, n=240):
    chance = random.Random(seed)
    words = ["the", "The", "ÄPFEL", "äpfel", "ﬁn", "日本", "𝔘", "x1y", "don't", "zz", "a\x00b", "é"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(None, "de", None), ("", None, None), ("12 34 \x7f", "xx", "only"), ("a " * 40, "yy", "s0"), ("the﻿end", "en", "")]
    for _ in range(n):
        lang, source = chance.choice(["en", "de", None]), chance.choice(["s0"] * 5 + [f"s{i}" for i in range(9)])
        own = words[hash(source) % 7:] if source == "s3" else words
        rows.append((" ".join(chance.choices(own, weights=[1 / (i + 1) for i in range(len(own))], k=chance.randrange(30))), lang, source))
    return rows + rows[-20:]


def ran(spark, rows, **limits):
    docs = spark.createDataFrame([(i % 7, *r, "u", 3, "r") for i, r in enumerate(rows)], SCHEMA).repartition(4)
    out = divergence.audit(docs, **limits)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("least_docs,top", [(1, 50), (4, 5), (30, 3), (10_000, 50)])
def test_like_the_plain_version(spark, least_docs, top):
    rows = corpus()
    assert ran(spark, rows, least_docs=least_docs, top=top) == sorted(plain(rows, least_docs, top))


def test_cut_into_blocks_buckets_and_pieces(spark, monkeypatch):
    """The same result where a group is merged in pieces, sources fill several blocks and terms many buckets."""
    monkeypatch.setattr(divergence, "BAND_ROWS", 8)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 20)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
    rows = corpus(9)
    assert ran(spark, rows, least_docs=2, top=4) == sorted(plain(rows, 2, 4))


def test_long_text_and_no_rows(spark):
    rows = [("long TEXT ä " * 900_000, "en", "a"), ("text", "en", "b")]
    assert ran(spark, rows, least_docs=1) == sorted(plain(rows, 1, 50))
    assert ran(spark, [("x", "en", "a")])[:1] == []
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband_by_definition(k):
    chance = np.random.default_rng(k)
    count, total = chance.integers(1, 9, 700), chance.integers(5, 40, 700)
    names = np.array([f"{x:03d}" for x in chance.permutation(700)], object)
    above = (count[:, None] >= count) & (total[:, None] <= total) & (names[:, None] < names)
    assert set(divergence.in_band(count, total, names, k)) == set(np.flatnonzero(above.sum(axis=0) < k))
