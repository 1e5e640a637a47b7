"""Incremental versions of the nightly steps on Structured Streaming.

Each run takes what is new (``availableNow``) and writes every micro-batch under its own batch id, replacing it when
a lost batch is run again, so results are exactly once.  State, checkpoints and results live under ``folder``, which
has to be reachable by all executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def run_new(stream: DataFrame, folder: str, mode: str = "update",
            transform: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Process everything new and return all batch results so far with their ``batch_id``."""
    take_new(stream, folder, mode, transform)
    return stream.sparkSession.read.parquet(f"{folder}/results")


def take_new(stream: DataFrame, folder: str, mode: str = "update",
             transform: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Process everything new; finished batches may have been compacted away."""
    results = f"{folder}/results"

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch, batch_id) if transform else batch
        out.write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def newest(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last update per key."""
    rest = [c for c in results.columns if c not in (*keys, "batch_id")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


# --- daily bars: mergeable parts, no state and no watermark -----------------------------------
def bar_parts(ticks: DataFrame) -> DataFrame:
    """Bars of (key, ts, value, id) ticks by key and UTC day, in a form that parts can be merged in.

    First and last tick are kept with their time and id, so parts may come in any order.
    """
    tick = F.struct("ts", "id", "value")
    return ticks.groupBy("key", F.expr("date_from_unix_date(int(unix_seconds(ts) div 86400))").alias("date")).agg(
        F.min(tick).alias("first"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(tick).alias("last"),
        F.count(F.lit(1)).alias("ticks"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """One part per key and day out of any parts of it; merging is associative and knows no order."""
    return parts.groupBy("key", "date").agg(
        F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"),
        F.sum("ticks").alias("ticks"))


def daily_bars(ticks: DataFrame, folder: str) -> DataFrame:
    """Take in new ticks and return all bars so far; ticks of any age count.

    A micro-batch is reduced to parts before it is written; nothing is held between batches.
    """
    take_new(ticks, folder, "append", lambda batch, _: bar_parts(batch))
    return bars_so_far(ticks.sparkSession, folder)


def bars_so_far(spark: SparkSession, folder: str) -> DataFrame:
    merged = merged_parts(_all_parts(spark, folder))
    return merged.select("key", "date", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "ticks")


def compact(spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame] = merged_parts) -> None:
    """Merge the parts of all finished batches into one table, which readers take in their place.

    The table is named for the last batch in it and counts only when it is complete, so a run that breaks off changes
    nothing; the merged batches are deleted afterwards.
    """
    batches = _numbered(spark, f"{folder}/results", "batch_id=")
    done = _numbered(spark, f"{folder}/compacted", "upto=", complete=True)
    if not batches or done and batches[-1] <= done[-1]:
        return
    merge(_all_parts(spark, folder)).write.mode("overwrite").parquet(f"{folder}/compacted/upto={batches[-1]}")
    for path in [f"{folder}/results/batch_id={b}" for b in batches] + [f"{folder}/compacted/upto={d}" for d in done]:
        _files(spark, path)[0].delete(_files(spark, path)[1], True)


def _all_parts(spark: SparkSession, folder: str) -> DataFrame:
    done = _numbered(spark, f"{folder}/compacted", "upto=", complete=True)
    upto = done[-1] if done else -1
    paths = [f"{folder}/compacted/upto={upto}"] * bool(done) + [
        f"{folder}/results/batch_id={b}" for b in _numbered(spark, f"{folder}/results", "batch_id=", complete=True) if b > upto]
    return spark.read.parquet(*paths)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbered(spark: SparkSession, folder: str, prefix: str, complete: bool = False) -> list[int]:
    """Numbers of the tables ``prefix<number>`` under a folder, the finished ones only if wanted."""
    system, at = _files(spark, folder)
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)
                  and (not complete or system.exists(_files(spark, f"{folder}/{n}/_SUCCESS")[1])))


# --- latest facts ----------------------------------------------------------------------------
def latest_facts(facts: DataFrame) -> DataFrame:
    """Streaming latest value per (ticker, metric) by filing time, then ingest order."""
    return facts.groupBy("ticker", "metric").agg(
        F.max_by(F.struct("value", "filed"), F.struct("filed", "ingest_id")).alias("f")).select(
        "ticker", "metric", "f.value", "f.filed")


# --- label alerts: the last tick of every day as mergeable parts --------------------------------
def label_parts(ticks: DataFrame) -> DataFrame:
    """The last (key, ts, id, label) tick of a key and UTC day, with its time and id, so parts may come in any order."""
    return ticks.groupBy("key", F.expr("date_from_unix_date(int(unix_seconds(ts) div 86400))").alias("date")).agg(
        F.max(F.struct("ts", "id", "label")).alias("last"))


def merged_labels(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key", "date").agg(F.max("last").alias("last"))


def label_alerts(ticks: DataFrame, folder: str) -> DataFrame:
    """Take in new (key, ts, id, label) ticks and return all alerts so far: key, run_date, prior_label, new_label.

    A day's label is that of its last tick; an alert is a day whose label differs from that of the day before in the
    key's series ('New' before the first).  Ticks may come late: alerts follow from the merged days, so a late day gives
    its own alert and that of the following day anew, and one that no longer holds is gone.  A micro-batch is reduced to
    a row per key and day before it is written; ``compact(spark, folder, merged_labels)`` folds finished batches.
    """
    take_new(ticks, folder, "append", lambda batch, _: label_parts(batch))
    spark = ticks.sparkSession
    days = merged_labels(_all_parts(spark, folder)).select("key", "date", F.col("last.label").alias("label"))
    prior = F.coalesce(F.lag("label").over(Window.partitionBy("key").orderBy("date")), F.lit("New"))
    return days.withColumn("prior", prior).where("prior <> label").select(
        "key", F.col("date").alias("run_date"), F.col("prior").alias("prior_label"), F.col("label").alias("new_label"))
