"""Queries over point-in-time facts, survivorship, backtests, run-over-run changes and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ratewell.catalog import sql as Q
from ratewell.catalog.base import query
from ratewell.catalog.metrics import bars_once, bars_table
from ratewell.catalog.sql import with_
from ratewell.operators import asof as P
from ratewell.operators import backtest as B
from ratewell.operators import quality as K
from ratewell.operators.merge import append_absent
from ratewell.session import shared_folder
from ratewell.sources import files as L
from ratewell.sources import tables as T
from ratewell.streaming import incremental as I

FACTS = """facts as (select user_id as ticker, event_type as metric, value, cast(cast(ts as date) - k as date) as period_end_date, cast(ts as date) as filing_date, 'feed-' || (k % 4) as source, k % 10 = 0 as is_proxy, event_id as ingest_id
 from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events))"""
AS_OF = "2024-01-15"


@query("pit_snapshot", with_([FACTS], f"""select ticker, metric, value, filing_date, is_proxy from (select *, row_number() over (partition by ticker, metric order by filing_date desc, period_end_date desc, ingest_id desc) as rn
 from facts where filing_date <= date '{AS_OF}') where rn = 1"""))
def pit_snapshot(spark, sf):
    return P.snapshot(T.facts(spark, sf), AS_OF).select("ticker", "metric", "value", "filing_date", "is_proxy")


@query("pit_as_of", with_([FACTS], """select ticker, ingest_id as request_id, filing_date as as_of, value, fid from (
 select r.ticker, r.ingest_id, r.filing_date, f.value, f.ingest_id as fid, row_number() over (partition by r.ingest_id order by f.filing_date desc, f.period_end_date desc, f.ingest_id desc) as rn
 from facts r left join facts f on f.ticker = r.ticker and f.metric = 'view' and f.filing_date <= r.filing_date where r.metric = 'purchase') where rn = 1"""))
def pit_as_of(spark, sf):
    """For every purchase, the latest view value of the same user filed by that day."""
    facts = T.facts(spark, sf)
    requests = facts.where(F.col("metric") == "purchase").select(
        "ticker", F.col("ingest_id").alias("request_id"), F.col("filing_date").alias("as_of"))
    views = facts.where(F.col("metric") == "view").withColumnRenamed("ingest_id", "fid")
    return P.as_of_join(requests, views, ["ticker"], "as_of", "filing_date", ["value", "fid"], ["period_end_date", "fid"])


@query("lookahead_audit", with_([FACTS, "asked as (select c_custkey as ticker, m as metric from customer, (values ('view'), ('signup'), ('return_1y')) t(m))"],
 f"""select a.ticker, a.metric, case when f.ticker is null then 'MISSING' when f.filing_date > date '{AS_OF}' then 'LOOK_AHEAD_VIOLATION' when f.is_proxy then 'PROXY_WARNING' else 'OK' end as status, f.filing_date,
 coalesce(f.is_proxy, false) as is_proxy, f.source from asked a left join (select * from (select *, row_number() over (partition by ticker, metric order by filing_date desc, ingest_id desc) as rn from facts) where rn = 1) f using (ticker, metric)"""))
def lookahead_audit(spark, sf):
    asked = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ticker"), F.explode(F.array(F.lit("view"), F.lit("signup"), F.lit("return_1y"))).alias("metric"))
    return P.look_ahead_audit(T.facts(spark, sf), asked, AS_OF)


# customers with an order in 2001 are active; the others were listed at the first and left after the last one
_LIFE = ["life as materialized (select o_custkey as ticker, cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as b, max(o_totalprice) as p from orders group by 1)",
         "alive as materialized (select ticker, 'later_delisted' as status, b as delist_date from life where b < date '2001-01-01' and a <= date '1997-06-30' and b > date '1997-06-30')"]


def _active_and_gone(spark, sf):
    life = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(
        F.min("o_orderdate").cast("date").alias("list_date"), F.max("o_orderdate").cast("date").alias("delist_date"),
        F.max("o_totalprice").alias("last_price"))
    still = F.col("delist_date") >= F.lit("2001-01-01").cast("date")
    return life.where(still).select("ticker"), life.where(~still).withColumn("reason", F.lit("inactive"))


@query("universe_as_of", with_(_LIFE, "select ticker, 'active' as status, cast(null as date) as delist_date from life where b >= date '2001-01-01' union all select * from alive"))
def universe_as_of(spark, sf):
    return P.universe_as_of(*_active_and_gone(spark, sf), "1997-06-30").select("ticker", "status", "delist_date")


_SURV = f"""surv as (select '1997-06-30' as as_of_date, a as n_surviving, f as n_later_failed, a + f as total_universe, {Q.r('f / (a + f) * 100.0', 1)} as pct_missing from (
 select (select count(*) from life where b >= date '2001-01-01') as a, (select count(*) from alive) as f))"""
_SEV = "case when pct_missing > 15 then 'Severe' when pct_missing > 8 then 'High' when pct_missing > 3 then 'Moderate' else 'Low' end"


@query("survivorship", with_(_LIFE + [_SURV], f"select *, {_SEV} as bias_severity from surv"))
def survivorship(spark, sf):
    return P.survivorship(*_active_and_gone(spark, sf), "1997-06-30")


def _runs(spark, sf):
    """One backtest run per event user: it ends some months after the user's last event."""
    e = T.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("date").alias("last"))
    return e.select(F.col("user_id").alias("run_id"), F.add_months("last", 6 - (F.col("user_id") % 40).cast("int")).alias("end_date"))


_RUNS = "runs as (select user_id as run_id, cast(cast(max(ts) as date) + to_months(cast(6 - user_id % 40 as integer)) as date) as end_date from events group by user_id)"
_PERIOD = "case when end_date >= date '2024-04-01' then 'holdout' when end_date >= date '2022-04-01' then 'validation' else 'development' end"


@query("period_tags", with_([_RUNS], f"""select run_id, end_date, {_PERIOD} as period, end_date < date '2024-04-01' as allowed, case {_PERIOD} when 'holdout' then 'VETO: Backtest end_date ' || end_date || ' enters the holdout period (locked from 2024-04-01).'
 when 'validation' then 'WARNING: Backtest runs into the validation period (2022-04-01 to 2024-04-01).' else 'OK: Backtest confined to development period (before 2022-04-01).' end as period_message from runs"""))
def period_tags(spark, sf):
    return P.tag_periods(_runs(spark, sf))


@query("weight_change_audit", """select count(*) as total_changes, count(*) filter (where d < '2024-04-01') as changes_in_dev_validation, count(*) filter (where d >= '2024-04-01') as changes_in_holdout,
 greatest(0, 5 - count(*) filter (where d < '2024-04-01')) as budget_remaining, count(*) filter (where d >= '2024-04-01') > 0 as holdout_contaminated
 from (select strftime(cast(ts as date) + cast(user_id as integer), '%Y-%m-%d') as d from events where event_type = 'signup')""")
def weight_change_audit(spark, sf):
    """A change log written as JSON lines and audited: one entry per signup event."""
    e = T.table(spark, sf, "events").where(F.col("event_type") == "signup")
    log = e.select(
        F.concat(F.date_add(F.col("ts").cast("date"), F.col("user_id").cast("int")).cast("string"), F.lit("T00:00:00")).alias("timestamp"),
        F.lit("annual_review").alias("reason_key"), F.col("props").alias("description"), F.lit("a").alias("old_config_hash"),
        F.lit("b").alias("new_config_hash"), F.col("user_id").cast("string").alias("changed_by"))
    path = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    log.write.json(path)
    return P.weight_change_audit(L.read_weight_changes(spark, path)).withColumn(
        "budget_remaining", F.col("budget_remaining").cast("long"))


@query("bias_report", with_(_LIFE + [_SURV, _RUNS], f"""select 'survivorship' as "check", case when {_SEV} in ('High', 'Severe') then 'blocker' when {_SEV} = 'Moderate' then 'warning' else 'ok' end as level,
 'SURVIVORSHIP [' || {_SEV} || ']: ' || n_later_failed || ' delisted names (' || printf('%.1f', pct_missing) || '% of the 1997-06-30 universe) missing.' as message from surv
 union all select 'period:' || p, case p when 'holdout' then 'blocker' when 'validation' then 'warning' else 'ok' end, count(*) || ' runs end in the ' || p || ' period.' from (select {_PERIOD} as p from runs) group by p"""))
def bias_report(spark, sf):
    return P.bias_report(P.survivorship(*_active_and_gone(spark, sf), "1997-06-30"), _runs(spark, sf))


@query("append_absent", """select c_custkey as k, 'customer' as origin, c_acctbal as balance from customer where c_acctbal >= 0
 union all select s_suppkey, 'supplier', null from supplier where s_suppkey not in (select c_custkey from customer where c_acctbal >= 0)""")
def append_absent_query(spark, sf):
    """Rows of a second source added only where the key is new; columns united by name."""
    c = T.table(spark, sf, "customer").where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("balance"))
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("origin"))
    return append_absent(c, s, "k")


# --- backtests -------------------------------------------------------------------------------
def _recs(spark, sf, bars=None):
    """Every supplier that traded in a quarter is recommended at the quarter's start."""
    return (bars_table(spark, sf) if bars is None else bars).groupBy("ticker", F.trunc("date", "quarter").alias("run_date")).agg(
        F.max("close").alias("score")).select("run_date", "ticker", "score")


_RECS = "recs as materialized (select cast(date_trunc('quarter', date) as date) as run_date, ticker, max(close) as score from bars group by all)"


def _nearest(targets: str, name: str) -> str:
    return f"""{name} as materialized (select * from (select t.*, b.close as price, b.date as price_date, row_number() over (partition by t.ticker, t.target_date order by abs(b.date - t.target_date), b.date desc) as p
 from ({targets}) t left join bars b on b.ticker = t.ticker and b.date between t.target_date - 5 and t.target_date + 5) where p = 1)"""


@query("nearest_price_join", with_([Q.BARS, _RECS, _nearest("select distinct ticker, run_date as target_date from recs", "near")], "select ticker, target_date, price, price_date from near"))
def nearest_price_join(spark, sf):
    bars = bars_once(spark, sf)
    return B.nearest_price(_recs(spark, sf, bars).withColumnRenamed("run_date", "target_date"), bars)


_H = {"1M": 33, "3M": 94, "6M": 195, "1Y": 378}
_LEGS = " union all ".join([f"select ticker, run_date + {d} as target_date from recs" for d in (0, *_H.values())])
_FWD = [Q.BARS, _RECS, _nearest(f"select distinct ticker, cast(target_date as date) as target_date from ({_LEGS})", "near"),
        "fr as materialized (select r.run_date, r.ticker, r.score, e.price as entry_price, " + ", ".join(
            Q.r(f"case when x{h}.price > 0 then (x{h}.price / e.price - 1.0) * 100 end") + f" as return_{h}" for h in _H)
        + " from recs r join near e on e.ticker = r.ticker and e.target_date = r.run_date and e.price > 0 " + " ".join(
            f"left join near x{h} on x{h}.ticker = r.ticker and x{h}.target_date = r.run_date + {d}" for h, d in _H.items()) + ")"]
_LONG = "rl as materialized (" + " union all ".join(f"select run_date, ticker, '{h}' as period, return_{h} as ret from fr where return_{h} is not null" for h in _H) + ")"


@query("forward_returns", with_(_FWD, "select run_date, ticker, score, entry_price, " + ", ".join(f"return_{h}" for h in _H) + " from fr"))
def forward_returns(spark, sf):
    return B.forward_returns(_recs(spark, sf), bars_table(spark, sf))


@query("backtest_stats", with_(_FWD + [_LONG], f"""select run_date, period, count(*) as n_stocks, {Q.r('cast(sum(cast(round(ret * 100) as bigint)) as double) / count(*) / 100')} as mean_return, {Q.r('median(ret)')} as median_return,
 {Q.r('max(ret)')} as best_return, {Q.r('min(ret)')} as worst_return, {Q.r('stddev_pop(ret)')} as std_dev, {Q.r('count(*) filter (where ret > 0) / count(*) * 100.0', 1)} as hit_rate, count(*) filter (where ret > 0) as winners,
 count(*) filter (where ret <= 0) as losers, case when max(ret) > min(ret) then {Q.r('avg(ret) / nullif(stddev_pop(ret), 0)')} else 0e0 end as sharpe_like,
 case when sum(ret) filter (where ret < 0) < 0 then {Q.r('coalesce(sum(cast(round(ret * 100) as bigint)) filter (where ret > 0), 0) / -sum(cast(round(ret * 100) as bigint)) filter (where ret < 0)')} end as profit_factor from rl group by run_date, period"""))
def backtest_stats(spark, sf):
    return B.backtest_stats(B.returns_long(B.forward_returns(_recs(spark, sf), bars_table(spark, sf))))


@query("extreme_picks", with_(_FWD, """select run_date, 'top' as side, cast(p as integer) as position, ticker, return_3M as ret from (select *, row_number() over (partition by run_date order by return_3M desc, ticker) as p from fr where return_3M is not null) where p <= 5
 union all select run_date, 'bottom', cast(p as integer), ticker, return_3M from (select *, row_number() over (partition by run_date order by return_3M, ticker desc) as p from fr where return_3M is not null) where p <= 5"""))
def extreme_picks(spark, sf):
    return B.extreme_picks(B.forward_returns(_recs(spark, sf), bars_table(spark, sf)))


@query("recommendation_outcomes", with_([Q.BARS, _RECS, "lastp as (select ticker, arg_max(close, date) as e from bars group by ticker)",
 "m as (select case when score > 6000 then 'Buy Candidate' else 'Watchlist' end as rec, (e / score - 1.0) * 100 as ret from recs join lastp using (ticker) where date '2000-12-31' - run_date >= 30)"],
 f"""select 'ok' as status, count(*) as n_calls, count(*) filter (where rec = 'Buy Candidate') as buy_calls, {Q.r('avg(ret)')} as avg_return_pct_all_calls,
 {Q.r("count(*) filter (where rec = 'Buy Candidate' and ret > 0) / nullif(count(*) filter (where rec = 'Buy Candidate'), 0)", 3)} as buy_hit_rate,
 count(*) filter (where rec = 'Buy Candidate' and ret > 0) / nullif(count(*) filter (where rec = 'Buy Candidate'), 0) < 0.5 as recalibration_alert from m"""))
def recommendation_outcomes(spark, sf):
    history = _recs(spark, sf).select(
        "run_date", "ticker", F.when(F.col("score") > 6000, "Buy Candidate").otherwise("Watchlist").alias("recommendation"),
        F.col("score").alias("close_price"))
    prices = bars_table(spark, sf).groupBy("ticker").agg(F.max_by("close", "date").alias("close_price"))
    return B.recommendation_outcomes(history, prices, "2000-12-31")


def _board(year: int) -> str:
    return (f"select 'C' || o_custkey as ticker, 'C' || o_custkey as name, case when sum(cast(round(o_totalprice * 100) as bigint)) > 30000000 then 'Investable' else 'Watchlist' end as s, max(o_totalprice) as v "
            f"from orders where year(o_orderdate) = {year} group by o_custkey")


@query("label_changes", f"""select c.ticker, c.name, '2000-12-31' as run_date, coalesce(p.s, 'New') as prior_status, c.s as new_status, p.v as prior_score, c.v as new_score
 from ({_board(2000)}) c left join ({_board(1999)}) p using (ticker) where coalesce(p.s, 'New') <> c.s""")
def label_changes(spark, sf):
    """Yearly status per customer, 2000 against 1999."""
    o = T.table(spark, sf, "orders")

    def run(year):
        name = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
        return o.where(F.year("o_orderdate") == year).groupBy(name.alias("ticker")).agg(
            F.when(F.sum(T.cents("o_totalprice")) > 30000000, "Investable").otherwise("Watchlist").alias("investability_status"),
            F.max("o_totalprice").alias("opportunity_score")).withColumn("name", F.col("ticker"))

    return B.label_changes(run(2000), run(1999), "2000-12-31")


@query("freshness", """select source, n as n_rows, d as latest_date, cast(date '2024-01-31' - d as integer) as age_days, case when n = 0 then 'empty' when date '2024-01-31' - d <= lim then 'ok' else 'stale' end as status from (
 select 'events' as source, count(*) as n, cast(max(ts) as date) as d, 3 as lim from events union all select 'orders', count(*), cast(max(o_orderdate) as date), 7 from orders
 union all select 'lineitem', count(*), cast(max(l_shipdate) as date), 9999 from lineitem)""")
def freshness(spark, sf):
    def latest(name, column):
        return T.table(spark, sf, name).agg(F.count(F.lit(1)).alias("n_rows"), F.max(column).cast("date").alias("latest_date")).select(
            F.lit(name).alias("source"), "n_rows", "latest_date")

    rows = latest("events", "ts").unionByName(latest("orders", "o_orderdate")).unionByName(latest("lineitem", "l_shipdate"))
    return K.freshness(rows, "2024-01-31", {"events": 3, "lineitem": 9999})


# --- streams ---------------------------------------------------------------------------------
def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _drop_in(spark, sf, feed, which):
    """Events as files that arrive one by one: a file for each remainder of the event id."""
    events = T.table(spark, sf, "events").where(which).withColumn("part", F.col("event_id") % 5)
    events.repartition(5, "part").write.mode("append").partitionBy("part").parquet(feed)


def _feed(spark, sf, feed):
    schema = T.table(spark, sf, "events").schema
    return T.event_ticks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{feed}/part=*"))


@query("stream_daily_bars", """select user_id as key, cast(ts as date) as date, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, count(*) as ticks from events group by all""")
def stream_daily_bars(spark, sf):
    """Ticks in five micro-batches, days in no order; the first three are compacted before the others come."""
    folder, feed = _folder(spark, "bars-stream"), _folder(spark, "ticks")
    _drop_in(spark, sf, feed, "event_id % 5 < 3")
    I.daily_bars(_feed(spark, sf, feed), folder)
    I.compact(spark, folder)
    _drop_in(spark, sf, feed, "event_id % 5 >= 3")
    return I.daily_bars(_feed(spark, sf, feed), folder)


@query("stream_latest_facts", """select user_id as ticker, event_type as metric, last(value order by ts, event_id) as value from events group by all""")
def stream_latest_facts(spark, sf):
    schema = T.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    facts = raw.select(F.col("user_id").alias("ticker"), F.col("event_type").alias("metric"), "value",
                       F.col("ts").alias("filed"), F.col("event_id").alias("ingest_id"))
    return I.newest(I.run_new(I.latest_facts(facts), _folder(spark, "facts-stream")), ["ticker", "metric"]).drop("filed")


@query("stream_label_alerts", """select key, run_date, prior_label, label as new_label from (select *, coalesce(lag(label) over (partition by key order by run_date), 'New') as prior_label from (
 select user_id as key, cast(ts as date) as run_date, last(case when value > 30 then 'High' else 'Low' end order by ts, event_id) as label from events group by all)) where prior_label <> label""")
def stream_label_alerts(spark, sf):
    """Alerts over five micro-batches whose days come in no order, late days among them."""
    feed = _folder(spark, "labels")
    _drop_in(spark, sf, feed, "true")
    ticks = _feed(spark, sf, feed).withColumn("label", F.when(F.col("value") > 30, "High").otherwise("Low"))
    return I.label_alerts(ticks, _folder(spark, "label-stream"))
