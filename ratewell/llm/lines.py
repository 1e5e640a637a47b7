"""Removal of repeated lines with levelled sorted runs of line hashes.

A store keeps what is known of every line key so far, as sorted runs in levels: key hash, number of documents,
largest document id.  A new batch merge-anti-joins the runs to learn which of its keys are new, adds its own
keys as a run of level 0, and when a level holds ``fanout`` runs they are merged into one run of the next level.
So a key is rewritten once a level and not once a batch.  Known keys of a batch are noted as hits on them.

Runs are tables in the folder all executors share, removed at the end; they hold keys and counts, no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import Scratch, cut, texts

#: White space of line keys.
BLANK = b" \t\n\x0b\x0c\r"
SEED = 0x51ED270B


def line_keys(text: str) -> list[bytes]:
    """Keys of the lines of a text: stripped of ASCII white space, A-Z lower-cased, in UTF-8."""
    return [line.strip(BLANK).lower() for line in text.encode().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """Has the key at least ``least`` code points?  The bytes bound the count from both sides."""
    n = len(key)
    return n >= least and (n >= 4 * least or key.isascii() or len(key.decode()) >= least)


def key_hash(key: bytes) -> bytes:
    """128 bits: by far too many for two different lines of a corpus to meet."""
    return xxhash.xxh3_128_digest(key, SEED)


def document_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """``key`` and ``doc_id``: one row for each document and distinct long line key in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = {key_hash(k) for k in set(line_keys(text.as_py() or "")) if long_enough(k, least_chars)}
                keys.extend(found)
                owners.extend([doc_id] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["key", "doc_id"])

    return texts(docs).mapInArrow(run, "key binary, doc_id long")


class LineRuns:
    """Levelled sorted runs of (key, n_docs, max_doc), each key in one run, and the later hits on known keys."""

    def __init__(self, scratch: Scratch, fanout: int = 4):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.hits: list[DataFrame] = []

    def _all(self, tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, tables)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _sorted(self, run: DataFrame) -> DataFrame:
        return self.scratch.write(run.sortWithinPartitions("key"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (key, doc_id); all rows of a document come in one batch.

        Counts are combined before the shuffle on the key, so a key that a third of the documents hold is one
        row a task.  Keys no run holds make the new run, the others are noted as hits.
        """
        batch = keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if not self.runs():
            self.levels[0].append(self._sorted(batch))
            return
        batch = self.scratch.write(batch)
        known = self._all(self.runs()).select("key")
        self.levels[0].append(self._sorted(batch.join(known, "key", "left_anti")))
        self.hits.append(self.scratch.write(batch.join(known, "key", "left_semi")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            whole = self._sorted(self._all(self.levels[level]).repartition("key"))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(whole)
            level += 1

    def repeated(self, least_docs: int) -> DataFrame:
        """(key, max_doc) of the keys that at least ``least_docs`` documents hold, over all batches."""
        return (self._all(self.runs() + self.hits).groupBy("key")
                .agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
                .where(F.col("n_docs") >= least_docs).select("key", "max_doc"))


def dropped_keys(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``doc_id`` and ``keys``: the line keys each document loses; documents that lose none are left out.

    A key of at least ``least_chars`` code points that at least ``least_docs`` documents hold stays only in the
    largest ``doc_id`` holding it.  Rows of one ``doc_id`` count as one document; rows without ``doc_id`` count
    for nothing and lose nothing.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = scratch.write(document_keys(docs, least_chars).where("doc_id is not null")
                          .withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "batch")
    runs = LineRuns(scratch, fanout)
    for batch in range(batches):
        runs.add(keyed.where(F.col("batch") == batch).select("key", "doc_id"))
    lost = cut(keyed.join(runs.repeated(least_docs), "key").where("doc_id <> max_doc")
               .groupBy("doc_id").agg(F.collect_set("key").alias("keys")))
    scratch.close()
    return lost


def _kept(text: str | None, keys: list[bytes] | None) -> tuple[str, int, int]:
    text = text or ""
    if keys is None or not len(keys):
        return text, text.count("\n") + 1, 0
    lines, lost = text.split("\n"), set(keys)
    kept = [line for line, key in zip(lines, line_keys(text)) if not key or key_hash(key) not in lost]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _with_keys(docs: DataFrame, **limits) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, the text, and the keys its document loses."""
    lost = dropped_keys(docs, **limits).select(F.col("doc_id").alias("lost_id"), "keys")
    rows = docs.select(F.struct("*").alias("row"))
    return (rows.join(lost, F.col("row.doc_id").cast("long") == F.col("lost_id"), "left")
            .select("row", F.col("row.text").cast("string").alias("text"), "keys"))


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` (and ``n_chars`` set anew, where there is such a column).

    Every row and every other column stays; a null text stays null, a text that loses all its lines is empty.
    """

    @F.pandas_udf("string")
    def kept(text: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _kept(t, k)[0] for t, k in zip(text, keys)], dtype=object)

    out = _with_keys(docs, **limits).select("row", kept("text", "keys").alias("text"))
    return out.select(*[F.col("text") if c == "text" else
                        F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else
                        F.col("row")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, **limits) -> DataFrame:
    """Per document: its lines, how many it loses, and the digest of the text that stays (null text: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, total, lost, digests = batch.column("doc_id"), [], [], []
            for text, keys in zip(batch.column("text"), batch.column("keys")):
                kept, lines, gone = _kept(text.as_py(), keys.as_py())
                total.append(lines)
                lost.append(gone)
                digests.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(lost, pa.int64()),
                                              pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = _with_keys(texts(docs), **limits).select(F.col("row.doc_id").alias("doc_id"), "text", "keys")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
