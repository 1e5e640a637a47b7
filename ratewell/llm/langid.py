"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (1 to 3 characters, word ends marked), most frequent first.  The
distance of a document to a language is out-of-place: for every n-gram of the document's profile, how far its
rank is from its rank in the language's profile, or the profile's length if it isn't there.  Language profiles come
from the n-gram counts of all training documents, summed by Spark; the rows brought to the driver are the profiles
themselves, ``top`` n-grams a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
MARK = np.uint64(ord("_"))
SHIFT = np.uint64(21)
#: N-grams a task holds before it sums them.
WAITING = 1_000_000
#: Texts are in a language from this share of this quantile of the scores of its own documents.
MARGIN, LOW = 0.8, 0.01


def grams(text: str | None) -> np.ndarray:
    """Packed n-grams of the lower-cased words of a text, with repetitions; the mark stands for a word's end.

    A text without any letter has none, combining marks or not.
    """
    if not text or not LETTER.search(text):
        return np.empty(0, np.uint64)
    words = NO_LETTER.sub("_", text.lower()).strip("_")
    c = np.frombuffer(f"_{words}_".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = c[:-1] << SHIFT | c[1:]
    return np.concatenate([c[c != MARK], two, (two[:-1] << SHIFT | c[2:])[c[1:-1] != MARK]])


def most_frequent(found: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first, equals by their code."""
    codes, counts = np.unique(found, return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:top]]


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id's text, modulo ``parts``, is ``part``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def language_profiles(docs: DataFrame, top: int = 400) -> dict[str, list[int]]:
    """Profile of every language of ``docs`` (text, lang); rows without text or language teach nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size: Counter = Counter()

        def summed(lang):
            codes, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            size[lang] = 0
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64), pa.int64()),
                                               pa.array(counts, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang, found = lang.as_py(), grams(text.as_py())
                waiting.setdefault(lang, []).append(found)
                size[lang] += len(found)
                if size[lang] >= WAITING:
                    yield summed(lang)
                elif size.total() >= 4 * WAITING:
                    yield from [summed(x) for x in list(waiting)]
        yield from (summed(x) for x in list(waiting))

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = (docs.where("text is not null and lang is not null").select("lang", "text")
            .mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).collect())
    out: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.place)):
        out.setdefault(row.lang, []).append(row.gram)
    return out


class Profiles:
    """Ranks of all profiles' n-grams side by side."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.names, self.top = sorted(profiles), top
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            own = np.array(profiles[name], np.int64).view(np.uint64)
            self.ranks[k, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of least distance (equals: first by name) and 1 - distance / largest possible distance."""
        own = most_frequent(grams(text), self.top)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return self.names[best], float(1 - far[best] / (self.top * len(own)))


def identified(text: Column, profiles: dict[str, list[int]], top: int = 400) -> Column:
    """struct<lang_pred string, score double> of a text column.

    ``und`` with score 0 for a null text, a text without letters, and all texts if there are no profiles.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(profiles, top)
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predict(text.cast("string"))


def identify(docs: DataFrame, parts: int = 4, held_out: int = 2, top: int = 400) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row, learned from the rows that aren't held out.

    Only text and language of those rows teach; a prediction reads nothing but the text.  Repeated rows teach as
    often as they come and are predicted each; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = in_fold(F.col("doc_id"), parts, held_out)
    found = language_profiles(rows.where(~held), top)
    return (rows.select("doc_id", held.alias("held_out"), identified(F.col("text"), found, top).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def least_scores(rows: DataFrame, profiles: dict[str, list[int]], top: int = 400) -> dict[str, float]:
    """Score from which a text counts as of a language: ``MARGIN`` of the ``LOW`` quantile of the scores of the language's own
    documents, of ``rows`` (text, lang) that are predicted right."""
    own = rows.select("lang", identified(F.col("text"), profiles, top).alias("p")).where("lang = p.lang_pred and p.score > 0")
    return {r.lang: MARGIN * r.low for r in own.groupBy("lang").agg(F.percentile_approx("p.score", LOW, 10_000).alias("low")).collect()}


def in_known_language(docs: DataFrame, parts: int = 4, held_out: int = 2, top: int = 400) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language; texts without letters and those that score less than
    ``least_scores`` of the training folds go."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    taught = rows.where(~in_fold(docs["doc_id"], parts, held_out))
    found = language_profiles(taught, top)
    least = least_scores(taught, found, top) if found else {}
    enough = F.lit(False)
    for lang, score in least.items():
        enough = enough | (F.col("p.lang_pred") == lang) & (F.col("p.score") >= score)
    row = docs.select(F.struct("*").alias("row")).withColumn("p", identified(F.col("row.text"), found, top))
    return row.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") > 0) & enough).select("row.*")
