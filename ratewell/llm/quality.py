"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of a text are a fixed row of numbers.  Trees are grown level by level from histograms of gradients over
binned statistics, on a bounded sample of the labelled training rows (``TRAIN_ROWS``, those with the smallest id hash).
All trees together are four flat arrays, and scoring walks them for a whole batch of documents at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import log2
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import texts
from ratewell.llm.langid import in_fold

#: Labelled rows a model learns from at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2, LEAF_ROWS = 60, 4, 0.15, 64, 1.0, 10
SYMBOLS = np.frombuffer(b"$%&*#@!^~|<>{}[]_=+\\/", np.uint8)
NAMES = ("chars", "words", "lines", "word_length", "longest_word", "distinct_words", "top_word", "equal_neighbours", "distinct_pairs", "repeated_lines",
         "line_length", "upper", "digits", "blanks", "stops", "symbols", "non_ascii", "short_words", "symbol_words", "byte_entropy")


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; shares of nothing are 0."""
    text = text or ""
    raw = text.encode()
    words, rows = text.split(), text.split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts = Counter(words)
    share = byte[byte > 0] / n
    return [log2(1 + len(text)), log2(1 + len(words)), log2(len(rows)), sum(map(len, words)) / w, log2(1 + max(map(len, words), default=0)), len(counts) / w,
            max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w,
            1 - len(set(rows)) / len(rows), log2(1 + len(text) / len(rows)), byte[65:91].sum() / n, byte[48:58].sum() / n, byte[32] / n,
            (byte[44] + byte[46]) / n, byte[SYMBOLS].sum() / n, byte[128:].sum() / n, sum(len(x) < 4 for x in words) / w,
            sum(c for x, c in counts.items() if x[-1] in "!$%&*#@") / w, float(-(share * np.log2(share)).sum())]


class Trees:
    """Boosted trees as flat arrays: feature (-1: leaf), threshold, first child (the second follows), value."""

    def __init__(self, base: float, feature, threshold, child, value, roots):
        self.base, self.roots = base, np.asarray(roots, np.int64)
        self.feature, self.child = np.asarray(feature, np.int64), np.asarray(child, np.int64)
        self.threshold, self.value = np.asarray(threshold, np.float64), np.asarray(value, np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            feature = self.feature[at]
            at = np.where(feature < 0, at, self.child[at] + (x[rows, np.maximum(feature, 0)] > self.threshold[at]))
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Grow the trees; without rows of both labels the score is the same for every text."""
    share = min(1 - 1e-3, max(1e-3, float(y.mean()))) if len(y) else 0.5
    feature, threshold, child, value, roots = [], [], [], [], []
    base = float(np.log(share / (1 - share)))
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])])
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p)
            roots.append(len(feature))
            nodes = [len(feature)]
            for store, item in ((feature, -1), (threshold, 0.0), (child, 0), (value, 0.0)):
                store.append(item)
            where = np.zeros(len(y), np.int64)  # place in ``nodes``, -1 in a finished leaf
            leaf_of = np.full(len(y), nodes[0])
            for depth in range(DEPTH + 1):
                live = where >= 0
                size = len(nodes)
                g_all, h_all = np.bincount(where[live], gradient[live], size), np.bincount(where[live], weight[live], size)
                best = np.full(size, 1e-6)
                choice = [None] * size
                if depth < DEPTH:
                    for f in range(len(bins)):
                        key = where[live] * BINS + bins[f][live]
                        g, h, c = (np.cumsum(np.bincount(key, w, size * BINS).reshape(size, BINS), axis=1) for w in (gradient[live], weight[live], None))
                        gain = g**2 / (h + L2) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + L2) - (g_all**2 / (h_all + L2))[:, None]
                        gain[(c < LEAF_ROWS) | (c[:, -1:] - c < LEAF_ROWS)] = 0
                        cut = gain[:, :len(edges[f])].argmax(axis=1) if len(edges[f]) else np.zeros(size, np.int64)
                        for k in range(size):
                            if len(edges[f]) and gain[k, cut[k]] > best[k]:
                                best[k], choice[k] = gain[k, cut[k]], (f, int(cut[k]))
                following, moved = [], np.full(len(y), -1)
                for k, node in enumerate(nodes):
                    if choice[k] is None:
                        value[node] = RATE * g_all[k] / (h_all[k] + L2)
                        continue
                    f, cut = choice[k]
                    feature[node], threshold[node], child[node] = f, float(edges[f][cut]), len(feature)
                    for _ in range(2):
                        for store, item in ((feature, -1), (threshold, 0.0), (child, 0), (value, 0.0)):
                            store.append(item)
                    own = where == k
                    right = own & (bins[f] > cut)
                    moved[own] = len(following)
                    moved[right] = len(following) + 1
                    leaf_of[own] = child[node]
                    leaf_of[right] = child[node] + 1
                    following += [child[node], child[node] + 1]
                nodes, where = following, moved
                if not nodes:
                    break
            margin = margin + np.asarray(value)[leaf_of]
    return Trees(base, feature or [-1], threshold or [0.0], child or [0], value or [0.0], roots or [0])


def _statistics_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``x``, the statistics of ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> Trees:
    """Trees of the labelled documents outside the held-out fold, ``rows`` of them at most.

    A document with several labels has the least of them; a null label or id teaches nothing; a document in several
    rows teaches as often as it comes, within the bound.
    """
    label = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
             .where("doc_id is not null and y is not null").where(~in_fold(F.col("doc_id"), parts, held_out))
             .groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    known = texts(docs).join(F.broadcast(label), "doc_id")  # at most ``rows`` rows
    found = _statistics_rows(known, "doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
    x = np.array([r.x for r in found], np.float64).reshape(len(found), len(NAMES))
    return fit(x, np.array([float(r.y > 0) for r in found]))


def scored(docs: DataFrame, model: Trees, parts: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` of every row; null and empty texts are scored as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                score = model.score(np.array([statistics(t.as_py()) for t in part.column("text")], np.float64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    rows = texts(docs).select("doc_id", in_fold(F.col("doc_id"), parts, held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
