"""Packed files against the public library and plain arrays."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratewell.llm import tokenfiles
from ratewell.llm.common import Scratch

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = tokenfiles.WordTokenizer(open(PATH, "rb").read())
ODD = ["", " ", "It's THE end.", "don't we'll 12,5 a-b_c", "Été ÑANDÚ straße", "日本語 тест Σίσυφος", "é́ é", "<|endoftext|> x <|startoftext|>", "a\x00b\x1cc\xa0d",
       "İstanbul İ", "x" * 3000, "a\n\tb  c", "''s 'S", "½ ² ª º"]


def test_is_by_words():
    assert CODER.by_words


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert CODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n'stdÉßñaAbc.,12<|>"), st.characters(blacklist_categories=("Cs",))), max_size=40), max_size=3))
def test_any_text(found):
    assert [x.tolist() for x in CODER.encode(found)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in found]


@settings(deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=3000), st.randoms())
def test_random_access(ids, rng):
    segment = tokenfiles.Segment(tokenfiles.pack(np.array(ids, np.uint32)))
    assert segment.at(np.arange(len(ids))).tolist() == ids
    some = [rng.randrange(len(ids)) for _ in range(3)]
    assert segment.at(np.array(some)).tolist() == [ids[k] for k in some]


def test_files(spark, frame, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 50)
    rows = [(i * 7 % 97, f"document {i} " * (i % 5)) for i in range(60)] + [(200, None), (None, "none"), (201, "y " * 9000)]
    scratch = Scratch(spark, "test")
    got = [tuple(r) for r in tokenfiles.read_documents(tokenfiles.write_token_files(frame(rows), PATH, 2, scratch)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokenfiles.read_documents(tokenfiles.write_token_files(frame(rows).limit(0), PATH, 2, scratch)).count() == 0
    scratch.close()
