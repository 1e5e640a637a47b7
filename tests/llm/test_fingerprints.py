"""Peeling against sets of paragraphs, and the whole operator against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ratewell.llm import fingerprints as fp
from ratewell.llm.common import Scratch


def paragraphs(text):
    raw, out, start = text.encode(), Counter(), 0
    for k, b in enumerate(raw):
        if b == 10 or k == len(raw) - 1 or b == 32 and k >= start + 0 and k >= 3 and (raw[k - 1] * 31 + raw[k - 2] * 17 + raw[k - 3]) % 8 == 0:
            out[raw[start:k + 1]] += 1
            start = k + 1
    return out


def likeness(a, b):
    x, y = paragraphs(a), paragraphs(b)
    shared, both = sum((x & y).values()), sum(x.values()) + sum(y.values())
    return shared / (both - shared) if both else 1.0


def prose(rng, n):
    return "".join(rng.choice(["alpha ", "beta ", "gamma\n", "delta, ", "épsilon. ", "%d " % rng.randint(0, 50)]) for _ in range(n))


def test_block():
    rng = random.Random(4)
    found = ["    " + prose(rng, rng.choice([0, 1, 3, 20, 200, 3000])) for _ in range(60)]
    following = found[1:] + found[:1]
    for (n, sha, a, b, near_edited, near_next), t, f in zip(fp.compare_block(found, following), found, following):
        edited = t[:len(t) - len(t) // 2] + f[:len(t) // 2]
        assert n == len(t) and sha == hashlib.sha256(edited.encode()).hexdigest()
        assert near_edited == pytest.approx(likeness(t, edited)) and near_next == pytest.approx(likeness(t, f))
        assert (a == b) == (paragraphs(t) == paragraphs(edited))


def test_peeling_finds_all():
    rng = np.random.default_rng(2)
    digest = rng.integers(1, 2**63, 5000).astype(np.uint64)
    owner = np.repeat([0, 1], 2500)
    assert fp.differences(owner, digest, np.array([0, 0]), np.array([1, 0]), 2).tolist() == [5000, 0]


def test_documents(spark, frame):
    rng = random.Random(9)
    rows = [(i * 3, "line one\n" + prose(rng, i)) for i in range(40)] + [(500, None), (501, ""), (None, "    first of all"), (502, "x" * 200_000)]
    for parts in (1, 6):
        scratch = Scratch(spark, "test")
        got = {r.doc_id: r for r in fp.fingerprints(frame(rows), scratch, parts).collect()}
        order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
        assert len(got) == len(rows)
        for (i, t), (_, f) in zip(order, order[1:] + order[:1]):
            t, f = t or "", f or ""
            edited = t[:len(t) - len(t) // 2] + f[:len(t) // 2]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[500].fingerprint == got[501].fingerprint and got[500].near_next == 1.0
        assert fp.fingerprints(frame(rows).limit(0), scratch).count() == 0
        assert fp.fingerprints(frame([(1, "a b c")]), scratch).first().near_next == 1.0
        scratch.close()


def test_unbroken_and_repetitive_texts():
    """Texts without blanks or of the same words: half a text stays half alike, an edit moves few cuts, others share nothing."""
    rng = random.Random(12)
    cjk = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000))
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
    other = "".join(chr(rng.randint(0xAC00, 0xD7A3)) for _ in range(3000))
    found = [cjk, base64, "x" * 9000, "alpha " * 1500, other]  # no blank of these is a cut
    rows = fp.compare_block(found, [other, other, other, other, cjk])
    for row, text in zip(rows, found):
        assert 0.1 < row[4] < 0.7 and row[5] == 0, text[:10]
        owner, _ = fp.paragraph_digests([text])
        assert len(text.encode()) / fp.LARGEST <= len(owner) <= len(text.encode()) / fp.SMALLEST + 1
    for text in (cjk, base64):
        owner, digest = fp.paragraph_digests([text, text[:40] + "!" + text[40:]])
        assert fp.differences(owner, digest, np.array([0]), np.array([1]), 2)[0] <= 6


def test_differing_digests_and_their_side(spark):
    left, right = "one\ntwo\nthree\ntwo\n", "one\nfour\ntwo\n"
    want = {}
    for k, text in ((1, left), (-1, right)):
        want[k] = set(fp.paragraph_digests([text])[1].view(np.int64).tolist())
    pairs = spark.createDataFrame([(7, left, right), (8, left, left), (9, None, right)], "pair_id long, left string, right string")
    got = {(r.pair_id, r.side, r.digest) for r in fp.differing_paragraphs(pairs).collect()}
    assert got == {(7, 1, d) for d in want[1] - want[-1]} | {(7, -1, d) for d in want[-1] - want[1]} | {(9, -1, d) for d in want[-1]}
    assert len([g for g in got if g[0] == 7]) == 3
