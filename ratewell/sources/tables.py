"""Entities, bars, fiscal years and facts read from the star-schema test tables.

Sums are taken over whole cents, so they come out the same in whatever order tasks add them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.operators.ordered import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def geography(spark: SparkSession, folder: str) -> DataFrame:
    """Nation with region name; 25 fixed rows, small enough to broadcast anywhere."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as entities: region, nation, nation/market segment; two segments act as banks and lenders."""
    c = table(spark, folder, "customer")
    return c.join(F.broadcast(geography(spark, folder)), c.c_nationkey == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ticker"), F.col("c_name").alias("name"), F.col("r_name").alias("sector"),
        F.col("n_name").alias("industry"), F.concat_ws("/", "n_name", "c_mktsegment").alias("basic_industry"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as listed entities.

    Every fifth key is a bank and every fifth a lender, so all three templates occur; the sector is
    the region, the industry the nation (or the region's banks / lenders).
    """
    s = table(spark, folder, "supplier")
    kind = F.pmod(F.col("s_suppkey"), F.lit(5))
    return s.join(F.broadcast(geography(spark, folder)), s.s_nationkey == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"),
        F.when(kind.isin(3, 4), "Financial Services").otherwise("Commerce").alias("macro_sector"),
        F.col("r_name").alias("sector"),
        F.when(kind == 3, F.concat(F.col("r_name"), F.lit(" Banking")))
        .when(kind == 4, F.concat(F.col("r_name"), F.lit(" Housing Finance")))
        .otherwise(F.col("n_name")).alias("industry"),
        F.concat(F.col("n_name"), F.lit("/"), kind.cast("string")).alias("basic_industry"),
        F.col("s_acctbal").alias("balance"))


def supplier_ticker(key: Column) -> Column:
    digits = key.cast("string")
    return F.concat(F.lit("SUPPLIER#"), F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits))


def named(rows: DataFrame) -> DataFrame:
    """Rows by supplier key with the ticker in its place, which is another for every key."""
    return rows.withColumn("ticker", supplier_ticker(F.col("ticker")))


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per supplier and ship date: unit prices as OHLC, quantity as volume."""
    return _bars(spark, folder, supplier_ticker(F.col("l_suppkey")))


def keyed_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The daily bars with the supplier key as ``ticker``, for operators that give a row per ticker (``named`` names it).

    All tickers begin alike, so sorts compare them whole; whole numbers are told apart by their first bytes.
    """
    return _bars(spark, folder, F.col("l_suppkey"))


def _bars(spark: SparkSession, folder: str, ticker: Column) -> DataFrame:
    """Daily bars by ``ticker``, a column of lineitem.

    The lines themselves go to the task of their ticker, once: hardly two of them make one bar, so parts of bars, twice
    as wide, would be no fewer.  The windows over a ticker's bars need no further shuffle.
    """
    li = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # (order, line) as one whole number, since primitive state keeps this a hash aggregate;
    # the last digits settle repeated line numbers the same way on every run
    order = (F.col("l_orderkey") * 1000 + F.col("l_linenumber")) * 8192 + cents("l_extendedprice") % 8191
    lines = li.select(ticker.alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
                      order.alias("order"), "l_extendedprice", "l_quantity")
    return spread(lines, "ticker").groupBy("ticker", "date").agg(
        F.min_by(price, "order").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, "order").alias("close"), F.sum("l_quantity").alias("volume"),
        (F.sum(cents("l_extendedprice")) * 5.0).alias("traded_value"))


def daily_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """Highest high ``h`` and lowest low ``l`` of all bars of a day, which are those of its lines; a row per day."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        F.max(price).alias("h"), F.min(price).alias("l"))


def customer_years(spark: SparkSession, folder: str) -> DataFrame:
    """Customer x order year: revenue, share of finished orders as margin, cash balance of the year."""
    o = table(spark, folder, "orders")
    finished = F.sum(F.when(F.col("o_orderstatus") == "F", cents("o_totalprice")).otherwise(0))
    pending = F.sum(F.when(F.col("o_orderstatus") == "P", cents("o_totalprice")).otherwise(0))
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy")).agg(
        F.sum(cents("o_totalprice")).alias("revenue_cents"), finished.alias("finished"), pending.alias("pending"),
    ).select(
        "entity", "fy", (F.col("revenue_cents") / 100.0).alias("revenue"),
        (F.col("finished") * 100.0 / F.col("revenue_cents")).alias("margin"),
        ((F.col("finished") - F.col("pending")) / 100.0).alias("fcf"))


def customer_quarters(spark: SparkSession, folder: str) -> DataFrame:
    """Customer x quarter revenue with missing quarters as rows of 0, first to last active quarter.

    The gaps are filled from a map of the customer's own quarters, so the orders are read and shuffled once.
    """
    o = table(spark, folder, "orders")
    ordinal = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1
    q = o.groupBy(F.col("o_custkey").alias("entity"), ordinal.alias("quarter")).agg(
        F.sum(cents("o_totalprice")).alias("cents"))
    own = q.groupBy("entity").agg(F.min("quarter").alias("a"), F.max("quarter").alias("b"),
                                  F.map_from_entries(F.collect_list(F.struct("quarter", "cents"))).alias("cents"))
    each = F.transform(F.sequence("a", "b"), lambda x: F.struct(
        x.alias("quarter"), (F.coalesce(F.try_element_at("cents", x), F.lit(0)) / 100.0).alias("revenue")))
    return own.select("entity", F.explode(each).alias("q")).select("entity", "q.quarter", "q.revenue")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Point-in-time facts from the event stream: user = ticker, event type = metric, time = filing time."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("ticker"), F.col("event_type").alias("metric"), "value",
        F.date_sub(F.col("ts").cast("date"), k).alias("period_end_date"), F.col("ts").cast("date").alias("filing_date"),
        F.when(k % 3 == 0, "annual").when(k % 3 == 1, "quarterly").otherwise("shareholding").alias("filing_type"),
        F.concat(F.lit("feed-"), k % 4).alias("source"), (k % 10 == 0).alias("is_proxy"),
        F.col("event_id").alias("ingest_id"))


def event_ticks(events: DataFrame) -> DataFrame:
    """(key, ts, value, id) ticks of the event table; its zoneless times are read as UTC. Works on streams too."""
    return events.select(
        F.col("user_id").alias("key"), F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("ts"),
        "value", F.col("event_id").alias("id"))
