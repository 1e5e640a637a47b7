"""Boosted trees: flat walk against a plain walk, odd rows, and accuracy on documents that taught nothing."""

import numpy as np
from pyspark.sql import functions as F

from ratewell.llm import quality

FOLDER = "/root/testdata/sf0.1"


def walk(trees, row):
    total = trees.base
    for at in trees.roots.tolist():
        while trees.feature[at] >= 0:
            at = trees.child[at] + int(row[trees.feature[at]] > trees.threshold[at])
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    trees = quality.fit(x, y)
    score = trees.score(x)
    assert ((score >= 0.5) == (y > 0)).mean() > 0.99
    assert np.allclose(score[:50], [walk(trees, r) for r in x[:50]])
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x, y * 0).score(x) < 0.01).all()


def test_odd_rows(spark, frame):
    rows = [(k, "word " * 30 if k % 2 else f"some fine text number {k} here") for k in range(80)] + [(100, None), (101, ""), (102, "\n"), (None, "x"), (3, "x"), (103, "a" * 300_000)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)] + [(61, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, text int")
    model = quality.train(frame(rows), labels)
    got = quality.scored(frame(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1
    assert quality.scored(frame(rows).limit(0), quality.train(frame(rows).limit(0), labels)).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality.scored(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id")
    right, share = got.select(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg("quality")).first()
    assert right > 0.97 and right > share
