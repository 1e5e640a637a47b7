"""Queries that write session files, documents and run histories, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ratewell import columns as H
from ratewell.catalog import sql as Q
from ratewell.catalog.base import kept, query
from ratewell.catalog.metrics import bars_once
from ratewell.catalog.rating import ratings
from ratewell.catalog.sql import with_
from ratewell.operators import backtest as B
from ratewell.operators import flows
from ratewell.operators import reports as R
from ratewell.session import shared_folder
from ratewell.sources import files as L
from ratewell.sources import sinks
from ratewell.sources import tables as T
from ratewell.sources.dated import read_dated, write_dated

UNTIL = "1999-06-30"


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _filled(spark, name: str, rows, pattern: str, separator: str = ",") -> str:
    path = folder(spark, name)
    write_dated(rows, path, pattern, separator)
    return path


# --- daily files -----------------------------------------------------------------------------
def _bar_files(spark, sf) -> str:
    """A zipped end-of-day file for every session; each seventh supplier trades in another series."""
    def make():
        number = F.substring("ticker", 10, 20).cast("long")
        rows = bars_once(spark, sf).select(
            F.col("date").alias("session"), F.col("date").cast("string").alias("TradDt"), F.lower("ticker").alias("TckrSymb"),
            F.when(number % 7 == 0, "BE").otherwise("EQ").alias("SctySrs"), F.col("open").alias("OpnPric"), F.col("high").alias("HghPric"),
            F.col("low").alias("LwPric"), F.col("close").alias("ClsPric"), F.col("volume").alias("TtlTradgVol"), F.col("traded_value").alias("TtlTrfVal"))
        return _filled(spark, "eod", rows, "BhavCopy_NSE_CM_0_0_0_%Y%m%d_F_0000.csv.zip")

    return kept(spark, sf, "bar_files", make)


_NEWEST = f"newest as (select distinct date from bars where date <= date '{UNTIL}' order by date desc limit 300)"
_EQ = "cast(substr(ticker, 10) as bigint) % 7 <> 0"


@query("scan_daily_bars", with_([Q.BARS, _NEWEST], f"select ticker, date, open, high, low, close, cast(null as double) as prev_close, volume, traded_value from bars where date in (select date from newest) and {_EQ}"))
def scan_daily_bars(spark, sf):
    """Bars of the newest 300 zipped session files up to a day."""
    return L.read_daily_bars(spark, _bar_files(spark, sf), UNTIL, sessions=300)


@query("scan_watched_bars", with_([Q.BARS], f"select ticker, count(*) as n_bars, max(date) as last_date from bars where {_EQ} and cast(substr(ticker, 10) as bigint) in (select s_suppkey from supplier where s_acctbal > 0) group by ticker"))
def scan_watched_bars(spark, sf):
    """All sessions of the tickers on a watch list."""
    watched = T.table(spark, sf, "supplier").where("s_acctbal > 0").select(T.supplier_ticker(F.col("s_suppkey")).alias("ticker"))
    bars = L.read_daily_bars(spark, _bar_files(spark, sf), tickers=watched, sessions=100_000)
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.max("date").alias("last_date"))


@query("scan_sessions_between", with_([Q.BARS], "select date as session, 'BhavCopy_NSE_CM_0_0_0_' || strftime(date, '%Y%m%d') || '_F_0000.csv.zip' as file_name, count(*) as n_rows from bars where date between date '1998-01-01' and date '1998-03-31' group by date"))
def scan_sessions_between(spark, sf):
    """Rows by file of one quarter; the other files are never opened."""
    rows = read_dated(spark, _bar_files(spark, sf), "bars", H.BAR_HEADERS, since="1998-01-01", until="1998-03-31")
    return rows.groupBy("session", "file_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("scan_delivery", """select printf('SUPPLIER#%09d', l_suppkey) as symbol, cast(l_shipdate as date) as date, sum(case when l_returnflag = 'N' then l_quantity else 0 end) / sum(l_quantity) * 100.0 as delivery_pct
 from lineitem where cast(l_shipdate as date) in (select distinct cast(l_shipdate as date) as d from lineitem order by d desc limit 60) group by all""")
def scan_delivery(spark, sf):
    """Delivered share out of the newest 60 pipe-separated files."""
    rows = T.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("session"), T.supplier_ticker(F.col("l_suppkey")).alias("SYMBOL")).agg(
        F.lit("EQ").alias("SERIES"), F.sum("l_quantity").alias("TRADED_QTY"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("DELIVERABLE_QTY"))
    return L.read_delivery(spark, _filled(spark, "delivery", rows, "MTO_%d%m%Y.DAT", "|"))


@query("scan_index_closes", with_([Q.BARS], f"""select unnest(['nifty500', 'niftybank']) as index_name, date, unnest([h, l]) as close from (select date, max(high) as h, min(low) as l from bars where date <= date '{UNTIL}' group by date order by date desc limit 260)"""))
def scan_index_closes(spark, sf):
    """Closes of the tracked indices out of the newest 260 index files."""
    day = T.daily_extremes(spark, sf)
    entries = F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in (("Nifty 500", F.col("h")), ("NIFTY BANK ", F.col("l")), ("Untracked", F.lit(1.0)))])
    rows = day.select(F.col("date").alias("session"), F.explode(entries).alias("e")).select("session", F.col("e.n").alias("Index Name"), F.col("e.v").alias("Closing Index Value"))
    return L.read_index_closes(spark, _filled(spark, "indices", rows, "ind_close_all_%d%b%Y.csv"), UNTIL)


_HELD = """held as (select 'S' || l_suppkey as symbol, cast(date_trunc('quarter', l_shipdate) as date) as as_of, sum(case when l_returnflag = 'R' then l_quantity else 0 end) / sum(l_quantity) * 100 as fii_holding_pct,
 sum(case when l_returnflag = 'A' then l_quantity else 0 end) / sum(l_quantity) * 100 as mf_holding_pct from lineitem group by all)"""


def _holdings(spark, sf):
    def share(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity") * 100

    rows = T.table(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "quarter").alias("session"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("symbol")).agg(
        share("R").alias("fii_holding_pct"), share("A").alias("mf_holding_pct"))
    return L.read_holdings(spark, _filled(spark, "holdings", rows, "shareholding_%Y-%m-%d.csv"))


@query("scan_holdings", with_([_HELD], "select symbol, as_of, fii_holding_pct, mf_holding_pct from held"))
def scan_holdings(spark, sf):
    """Every quarterly holdings snapshot, dated by its file name."""
    return _holdings(spark, sf)


@query("scan_latest_holdings", with_([_HELD], "select symbol, as_of, fii_holding_pct, mf_holding_pct from held where as_of = (select max(as_of) from held)"))
def scan_latest_holdings(spark, sf):
    return flows.latest_snapshot(_holdings(spark, sf))


# --- documents -------------------------------------------------------------------------------
def _entity_files(spark, sf) -> str:
    """One document file per supplier; those of every ninth break off."""
    def make():
        s = T.table(spark, sf, "supplier")
        text = F.to_json(F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.struct(F.struct(F.col("s_acctbal").alias("score")).alias("growth")).alias("cards")))
        rows = s.select(F.concat(F.lit("s_suppkey="), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"),
                        F.when(F.col("s_suppkey") % 9 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value"))
        path = folder(spark, "entities")
        sinks.write_entity_documents(rows.repartition("name"), path, "name", "value")
        return path

    return kept(spark, sf, "entity_files", make)


@query("scan_entity_documents", "select 'S' || s_suppkey as ticker, s_acctbal as growth from supplier where s_suppkey % 9 <> 0")
def scan_entity_documents(spark, sf):
    docs = L.read_entity_documents(spark, _entity_files(spark, sf), "ticker string, cards struct<growth:struct<score:double>>")
    return docs.select("ticker", F.col("cards.growth.score").alias("growth"))


@query("scan_unreadable_documents", "select cast(s_suppkey as bigint) as entity, cast(13 as bigint) as n_chars from supplier where s_suppkey % 9 = 0")
def scan_unreadable_documents(spark, sf):
    """The documents that could not be read, by file; the 12 characters left of each and the line end."""
    broken = L.unreadable_documents(spark, _entity_files(spark, sf))
    return broken.select(F.regexp_extract("file", "s_suppkey=([0-9]+)", 1).cast("long").alias("entity"), "n_chars")


@query("unreadable_payloads", "select event_id, '{\"k\": ' as payload from events where event_id % 50 = 0")
def unreadable_payloads(spark, sf):
    """Payloads that broke off on the way, kept beside the rows of the others."""
    events = T.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 6)).otherwise(F.col("props")).alias("payload"))
    return L.unreadable_payloads(events)


@query("written_documents", with_(Q.rated(), "select ticker, cast(n_peers as bigint) as n_peers, sector_rank, date '2024-01-02' as run_date from rated"))
def written_documents(spark, sf):
    """Rating documents of a run written twice and read back: the second writing takes the place of the first."""
    path, docs = folder(spark, "documents"), R.documents(ratings(spark, sf))
    sinks.write_documents(docs.limit(3), path, "2024-01-02")
    sinks.write_documents(docs, path, "2024-01-02")
    back = spark.read.schema(f"{docs.select('document.*')._jdf.schema().toDDL()}, run_date date").json(path)
    return back.select("ticker", "peer_group.n_peers", "ranks.sector_rank", "run_date")


# --- run histories ---------------------------------------------------------------------------
_RUNS = """runs as (select 'C' || o_custkey as ticker, make_date(year(o_orderdate), 12, 31) as run_date, case when sum(cast(round(o_totalprice * 100) as bigint)) > 30000000 then 'Investable' else 'Watchlist' end as s,
 max(o_totalprice) as v from orders group by all),
 numbered as (select *, dense_rank() over (order by run_date) as run from runs)"""


def _history(spark, sf):
    """One run per order year, written to a history twice."""
    def make():
        o = T.table(spark, sf, "orders")
        runs = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("run_date")).agg(
            F.when(F.sum(T.cents("o_totalprice")) > 30000000, "Investable").otherwise("Watchlist").alias("investability_status"),
            F.max("o_totalprice").alias("opportunity_score")).withColumn("name", F.col("ticker"))
        path = folder(spark, "history")
        sinks.append_history(runs, path)
        sinks.append_history(runs.where("run_date = date '1997-12-31'").drop("run_date"), path, "1997-12-31")
        return path

    return spark.read.parquet(kept(spark, sf, "history", make))


@query("history_runs", with_([_RUNS], "select run_date, count(*) as n, count(*) filter (where s = 'Investable') as investable from runs group by run_date"))
def history_runs(spark, sf):
    return _history(spark, sf).groupBy("run_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("investability_status") == "Investable").alias("investable"))


@query("run_changes", with_([_RUNS], """select c.ticker, c.ticker as name, c.run_date, coalesce(p.s, 'New') as prior_status, c.s as new_status, p.v as prior_score, c.v as new_score
 from numbered c left join numbered p on p.ticker = c.ticker and p.run = c.run - 1 where coalesce(p.s, 'New') <> c.s"""))
def run_changes(spark, sf):
    """Label changes of every run against the one before, out of the written history."""
    return B.run_changes(_history(spark, sf))
