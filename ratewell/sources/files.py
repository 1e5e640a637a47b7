"""Scans of the file formats exports and daily files come in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import columns as H
from ratewell.functions.text import clean_symbol, delivery_pct, parse_date, parse_number, parse_stage
from ratewell.operators.bars import keep_last_bar
from ratewell.sources.dated import read_dated


def read_text_csv(spark: SparkSession, path) -> DataFrame:
    """CSV with a header, every column as text, empty cells as ''."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if not df.columns:
        raise ValueError(f"CSV is empty: {path}. It needs a header row.")
    return df.na.fill("")


def file_date(name: Column, kind: str) -> Column:
    """Date in a file name, by the patterns of the file kind; null when none fits."""
    tries = []
    for pattern, fmt in H.DATED_FILE_PATTERNS[kind]:
        token = F.regexp_extract(name, pattern, 1)
        tries.append(parse_date(F.when(token != "", token), [fmt]))
    return F.coalesce(*tries)


def read_daily_bars(spark: SparkSession, path, run_date: str | None = None, tickers: DataFrame | None = None,
                    sessions: int = 1300) -> DataFrame:
    """Bars out of the newest ``sessions`` daily archives up to ``run_date``: EQ series, last row per (ticker, date).

    Files without a ticker, date or close column are passed over.  ``tickers`` (one column ``ticker``) restricts the
    rows by a semi join.
    """
    rows = read_dated(spark, path, "bars", H.BAR_HEADERS, ("ticker", "date", "close"), ".csv", newest=sessions, until=run_date)
    series = F.upper(F.trim("series"))
    bars = rows.where(series.isNull() | (series == "EQ")).select(
        F.upper(F.trim("ticker")).alias("ticker"), parse_date(F.col("date"), ["yyyy-MM-dd"]).alias("date"),
        *[parse_number(c).alias(c) for c in ("open", "high", "low", "close", "prev_close", "volume", "traded_value")],
        F.struct("session", "row_number").alias("arrival"),
    ).where((F.col("ticker") != "") & F.col("date").isNotNull())
    if tickers is not None:
        bars = bars.join(tickers.select("ticker"), "ticker", "left_semi")
    return keep_last_bar(bars, "arrival")


def read_delivery(spark: SparkSession, path, run_date: str | None = None, sessions: int = 60) -> DataFrame:
    """(symbol, date, delivery_pct) of the newest delivery files, in any of their formats."""
    rows = read_dated(spark, path, "delivery", H.DELIVERY_HEADERS, ("symbol",), newest=sessions, until=run_date)
    series = F.upper(F.trim("series"))
    return rows.where(series.isNull() | (series == "EQ")).select(
        F.upper(F.trim("symbol")).alias("symbol"), F.col("session").alias("date"),
        delivery_pct(F.col("delivery_pct"), F.col("deliverable_qty"), F.col("traded_qty")).alias("delivery_pct")).where(
        (F.col("symbol") != "") & F.col("delivery_pct").isNotNull())


def read_index_closes(spark: SparkSession, path, run_date: str | None = None, sessions: int = 260) -> DataFrame:
    """(index_name, date, close) of the tracked indices out of the newest index files."""
    rows = read_dated(spark, path, "index", H.INDEX_HEADERS, ("index_name", "close"), newest=sessions, until=run_date)
    names = F.create_map(*[F.lit(x) for kv in H.INDEX_SHORT_NAMES.items() for x in kv])
    return rows.select(
        F.try_element_at(names, F.upper(F.trim("index_name"))).alias("index_name"), F.col("session").alias("date"),
        parse_number("close").alias("close")).where(F.col("index_name").isNotNull() & F.col("close").isNotNull())


def read_holdings(spark: SparkSession, path) -> DataFrame:
    """Dated holdings snapshots: symbol, as_of from the file name, every ``*_holding_pct`` column as a number."""
    df = read_text_csv(spark, path)
    numbers = [c for c in df.columns if c.endswith("_holding_pct")]
    return df.select(
        clean_symbol(F.col("symbol")).alias("symbol"), file_date(F.col("_metadata.file_name"), "snapshot").alias("as_of"),
        *[parse_number(F.col(c)).alias(c) for c in numbers])


def read_weight_changes(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(
        "timestamp string, reason_key string, description string, old_config_hash string, "
        "new_config_hash string, changed_by string").json(path)


def entity_documents(spark: SparkSession, path) -> DataFrame:
    """(file, text, document): one JSON document per file as a variant, null where the text can't be read.

    Files without a byte hold no document; Spark's scans pass over them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text")).withColumn(
        "document", F.try_parse_json("text"))


def read_entity_documents(spark: SparkSession, path, schema: str) -> DataFrame:
    """One row per readable document with the fields of ``schema``; fields of another type than asked for are null."""
    fields = spark.createDataFrame([], schema).schema
    return entity_documents(spark, path).where("document is not null").select(*[
        F.try_variant_get("document", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in fields])


def unreadable_documents(spark: SparkSession, path) -> DataFrame:
    """(file, n_chars) of the documents that ``read_entity_documents`` leaves out."""
    return entity_documents(spark, path).where("document is null").select("file", F.length("text").cast("long").alias("n_chars"))


def manifest(spark: SparkSession, path) -> DataFrame:
    """File name, size, content hash prefix and modification time of every input file.

    Names come from Spark's listing; contents are hashed as they stream by, a megabyte at a time, whatever their size.
    """
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with system.open_input_stream(at) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
                digests.append(digest.hexdigest()[:12])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "hash"])

    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.mapInArrow(hashed, "path string, length long, modificationTime timestamp, hash string").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "hash", F.col("modificationTime").alias("freshness_ts"))


def large_deals(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Deal rows of JSON payloads that hold BULK_DEALS_DATA and BLOCK_DEALS_DATA lists.

    A payload is parsed once, into a variant, and both lists come out of it together.  Unreadable payloads give no
    rows; ``unreadable_payloads`` has them.
    """
    item = ("array<struct<symbol:string,clientName:string,buySell:string,quantityTraded:string,"
            "tradedPrice:string,dealDate:string>>")
    body = payloads.select(F.try_parse_json(column).alias("body"))

    def listed(key: str, kind: str) -> Column:
        rows = F.coalesce(F.try_variant_get("body", f"$.{key}", item), F.array().cast(item))
        return F.transform(rows, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("d")))

    lists = listed("BULK_DEALS_DATA", "bulk"), listed("BLOCK_DEALS_DATA", "block")
    return body.select(F.explode(F.concat(*lists)).alias("x")).select("x.kind", "x.d.*").select(
        F.upper(F.trim(F.coalesce("symbol", F.lit("")))).alias("symbol"), F.col("kind").alias("deal_type"),
        F.coalesce("clientName", F.lit("")).alias("client"), F.upper(F.coalesce("buySell", F.lit(""))).alias("buy_sell"),
        F.coalesce(parse_number("quantityTraded"), F.lit(0.0)).alias("quantity"),
        F.coalesce(parse_number("tradedPrice"), F.lit(0.0)).alias("price"), F.col("dealDate").alias("date"))


def unreadable_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The rows of ``payloads`` whose JSON can't be parsed."""
    return payloads.where(F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def surveillance_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(symbol, stage) rows of JSON payloads, under whichever of the known keys they use."""
    entry = "array<map<string,string>>"
    known = F.from_json(column, "map<string,string>")  # keys are case-sensitive; null for a bare list
    listed = F.coalesce(*[F.try_element_at(known, F.lit(k)) for k in ("data", "asm", "ASM")], F.col(column))
    items = payloads.select(F.explode(F.from_json(listed, entry)).alias("i"))

    def pick(*keys: str) -> Column:
        return F.coalesce(*[F.try_element_at("i", F.lit(k)) for k in keys])

    return items.select(
        F.upper(F.trim(pick("symbol", "Symbol", "SYMBOL"))).alias("symbol"),
        parse_stage(F.coalesce(pick("stage", "Stage", "asmStage"), F.lit("1"))).alias("stage")).where(F.col("symbol") != "")


# --- web pages -------------------------------------------------------------------------------
def _plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))


def list_values(pages: DataFrame, html: str = "html") -> DataFrame:
    """List items of each page: position, label (name span or item text), number span if there is one, link."""
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)))
    body = F.col("col")
    name = F.regexp_extract(body, r'(?is)<span[^>]*class="[^"]*name[^"]*"[^>]*>(.*?)</span>', 1)
    value = F.regexp_extract(body, r'(?is)<span[^>]*class="[^"]*number[^"]*"[^>]*>(.*?)</span>', 1)
    link = F.regexp_extract(body, r'(?is)<a[^>]*href="([^"]*)"', 1)
    return items.select(
        "page_id", "pos", _plain(F.when(name != "", name).otherwise(body)).alias("label"),
        parse_number(_plain(value)).alias("value"), F.when(link != "", link).alias("link"))


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Table rows of each page: position, row label without footnote marks, and the remaining cells as text."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)))
    cells = F.transform(F.regexp_extract_all("col", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1),
                        lambda c: F.replace(_plain(F.regexp_replace(c, "&nbsp;| ", " ")), F.lit(","), F.lit("")))
    return rows.withColumn("cells", cells).where((F.size("cells") > 0) & (F.col("cells")[0] != "")).select(
        "page_id", "pos", F.regexp_replace(F.col("cells")[0], r"[ +]+$", "").alias("label"),
        F.slice("cells", F.lit(2), F.size("cells")).alias("cells"))
