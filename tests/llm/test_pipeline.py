"""The pipeline over planted documents: what goes, what stays, and what the rest says after encoding and decoding."""

import hashlib
import random

import tiktoken
import public_tokenizers
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline


def planted():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line, item = say(14), say(40)
    rows = {k: f"{say(60)}\n{say(30)}" for k in range(40)}
    for k in range(2, 9):
        rows[k] = f"{say(50)}\n  {line.upper()} \n{say(20)}"      # a line that seven documents share
    rows[50] = rows[20]                                           # exact copy
    rows[51] = rows[21] + " " + say(3)                            # near copy
    rows[60] = f"{say(30)} {item} {say(30)}"                      # holds a benchmark item
    rows |= {70: None, 71: "", 72: "12 + 34 = 46 !"}              # nothing that has a language
    left = {k: t for k, t in rows.items() if k not in (50, 51, 60, 70, 71, 72)}
    for k in range(2, 8):
        left[k] = "\n".join(x for x in left[k].split("\n") if x.strip().lower() != line)
    return rows, item, left


def test_planted_documents(spark, frame, tmp_path):
    rows, item, left = planted()
    frame(list(rows.items())).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    assert {k: (r.n_tokens, r.decoded_sha256) for k, r in got.items()} == {
        k: (len(plain.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for k, t in left.items()}


def test_stages_keep_the_columns(spark, frame, tmp_path):
    """On an empty table too; extra columns stay as they are."""
    docs = frame([(1, "one two three")])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_copies_go_by_five_words(spark, frame, tmp_path):
    """One changed word in the middle of 50 leaves 41 of 51 shingles of 5 words (linked), but 43 of 51 of 4 words; two leave fewer."""
    words = [f"w{k}" for k in range(50)]
    one, two = words[:25] + ["other"] + words[26:], words[:15] + ["other"] + words[16:35] + ["more"] + words[36:]
    docs = frame([(1, " ".join(words)), (2, " ".join(one)), (3, " ".join(two))])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_group_of_near_copies_makes_few_pairs(spark, frame, tmp_path, monkeypatch):
    """Copies of one text that are alike in several steps leave one; pairs confirmed grow with the group, not with its square."""
    from ratewell.llm import minhash

    pairs, confirmed = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda found, *rest: pairs.append(found.count()) or confirmed(found, *rest))
    words, rng = [f"w{k}" for k in range(150)], random.Random(5)
    rows = [(k, " ".join(w if rng.random() > 0.015 else f"x{k}" for w in words)) for k in range(200)]
    kept = corpus_pipeline.near_duplicates(spark, frame(rows), str(tmp_path)).count()
    sets = [{tuple(t.split()[i:i + 5]) for i in range(146)} for _, t in rows]
    label = list(range(200))
    for a in range(200):
        for b in range(a):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    assert kept == len(set(label)) and 0 < sum(pairs) < 200 * 199 / 2 / 4
