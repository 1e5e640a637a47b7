"""Rank-order profiles: hand-made distances, folds, odd rows and accuracy on documents that taught nothing."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ratewell.llm import langid

FOLDER = "/root/testdata/sf0.01"


def test_grams_and_distance():
    def named(text):
        return sorted("".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s & 0x1FFFFF) for g in langid.grams(text))

    assert named("Ab") == sorted(["a", "b", "_a", "ab", "b_", "_ab", "ab_"])
    assert named("a 1 b") == sorted(["a", "b", "_a", "a_", "_b", "b_", "_a_", "_b_"])
    assert len(langid.grams(" 12 !")) == len(langid.grams(None)) == 0
    order = [g for g in langid.most_frequent(langid.grams("aab"), 9).view(np.int64).tolist()]
    model = langid.Profiles({"x": order, "y": order[::-1]}, 9)
    assert model.predict("aab") == ("x", 1.0)
    assert model.predict("") == ("und", 0.0)
    assert langid.Profiles({}, 9).predict("aab") == ("und", 0.0)


def test_rows(frame):
    rows = [(k, t, l) for k in range(40) for t, l in [("the cat and the hat", "en"), ("der hund und das haus", "de")][k % 2:][:1]]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (None, "the hat", None), (103, "und das " * 20_000, None), (103, "the", "en"), (104, "日本", None)]
    got = langid.identify(frame(rows + odd)).collect()
    assert len(got) == 47
    by = {r.doc_id: r for r in got if r.doc_id != 103}
    assert all(by[k].lang_pred == ("en", "de")[k % 2] for k in range(40)) and by[None].lang_pred == "en"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (100, 101, 102))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    kept = langid.in_known_language(frame(rows + odd))
    assert kept.dtypes == frame(rows).dtypes and kept.count() == 47 - 4
    assert langid.identify(frame(rows).limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_unlearned_language_goes(spark, frame):
    """Finnish and gibberish in Latin letters go, documents of the learned languages stay."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").limit(300).collect()
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    odd = [(10**9, finnish, None), (10**9 + 1, "xqzj kwvx qqjz zxkv wqjx vkzq jxqw " * 5, None), (10**9 + 2, "xqzj", None)]
    kept = {r.doc_id for r in langid.in_known_language(frame([tuple(r) for r in docs] + odd)).collect()}
    assert not kept & {k for k, _, _ in odd}
    assert len(kept) > 0.97 * len(docs)


def test_marks_alone_are_no_language(frame):
    """Combining marks without a letter are undetermined, with one they belong to it."""
    rows = [(i, "hello words of a text", "en") for i in range(8)] + [(100, "\u0301 \u0300"), (101, "e\u0301 \u0300 hello"), (102, "1\u0301")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(rows)).collect()}
    assert (got[100], got[101], got[102]) == ("und", "en", "und")
