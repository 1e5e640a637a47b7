"""Pieces that several text operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.session import shared_folder

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only: no other column of the caller's can clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in batches of at most so many rows, unless the session asks for fewer."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the folder that all executors share; the session's own setting comes first."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_broadcast(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows; beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


class Scratch:
    """Tables written to the folder that all executors share, for one run; ``close`` removes them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write as Parquet and read again: later steps start from the files, whatever executors are lost."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner drop the shuffle files of finished steps now and not at the driver's next collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_blocks(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) in blocks of about ``chars`` characters; a longer text is a block of its own."""
    ids, found, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if ids and size + len(text) > chars:
                yield ids, found
                ids, found, size = [], [], 0
            ids.append(doc_id)
            found.append(text)
            size += len(text)
    if ids:
        yield ids, found


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered; ``trim`` keeps the memory bounded."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
