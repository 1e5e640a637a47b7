"""Byte-level BPE against the public library: every id of every text, and the exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ratewell.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.Encoder(open(PATH, "rb").read(), P.PATTERN)
ODD = ["", " ", "\n", " a", "a ", "a\n", "\na", "a  b", "a\n\nb", "a \nb", "a\tb c", "a\r\nb", "a  b", "a 　b", "a\x1cb c",
       "don't we'll I'M 12 345", "日本語 テスト 123", "😀😀 👩‍👩‍👧", "ababababab aaaa aaaaaaaaaaaaaaaaa", "x" * 5000, " " * 3000,
       "<|endoftext|>", "Ünïcödé ça señor", "a b", "é́ x", "\u0085a b"]


def ids(text):
    return np.frombuffer(CODER.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODER.decode(CODER.encode([text])[0]) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdeétn's12.,!"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_block_of_many_words():
    rng = random.Random(5)
    found = [" ".join("".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 14))) for _ in range(80)) for _ in range(60)]
    for text, packed in zip(found, CODER.encode(found)):
        assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_documents(spark, frame):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (3, "same id"), (3, "same id")]
    got = sorted(map(str, bpe.encoding_digests(frame(rows), PATH, P.PATTERN).collect()))
    want = []
    for i, t in rows:
        own = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a}, n_tokens={b}, ids_sha256='{c}', decoded_sha256='{d}')" for a, b, c, d in want)
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(frame(rows[:len(ODD)]), PATH, P.PATTERN), PATH).collect()}
    assert back == dict(enumerate(ODD))
    assert bpe.encoding_digests(frame(rows).limit(0), PATH, P.PATTERN).count() == 0


def test_replay_takes_little_memory():
    """Words of a block lie in memory all at once: 46 bytes for each of theirs at the most, 85 with 64-bit positions in lists."""
    import tracemalloc

    rng = random.Random(3)
    words = [bytes(rng.choices(b"etaoinshrdlu", k=8)) for _ in range(40_000)]
    tracemalloc.start()
    CODER.vocabulary.replay(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 8 * len(words)


def test_words_are_forgotten():
    coder = bpe.Encoder(open(PATH, "rb").read(), P.PATTERN)
    ids = coder.encode(["some words, again words", "x  y"])
    assert coder.piece and coder.later
    coder.forget()
    assert not any((coder.piece, coder.first, coder.later, *coder.older)) and coder.held == 0
    assert coder.encode(["some words, again words", "x  y"]) == ids
