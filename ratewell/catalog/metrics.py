"""Queries over bars, fiscal years, holdings, deliveries and earnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewell.catalog import sql as Q
from ratewell.catalog.base import query, stored, stored_or
from ratewell.catalog.ingest import _YEAR, _deal_payloads
from ratewell.catalog.rating import prices, universe
from ratewell.catalog.sql import with_
from ratewell.functions.text import delivery_pct
from ratewell.operators import annual as A
from ratewell.operators import bars as B
from ratewell.operators import flows as W
from ratewell.operators.merge import merge_overwrite
from ratewell.operators.ordered import spread
from ratewell.sources import files as L
from ratewell.sources import tables as T


def bars_table(spark, sf):
    """The run's bar table, for queries whose branches read bars more than once."""
    return stored(spark, sf, "bars", lambda: T.daily_bars(spark, sf))


def keyed_bars_table(spark, sf):
    """The same by supplier key, for indicators with a row per ticker, which is named last."""
    return stored(spark, sf, "keyed_bars", lambda: T.keyed_bars(spark, sf))


def bars_once(spark, sf):
    """Bars for a query that reads them once, or in the same way each time: not written for it."""
    return stored_or(spark, sf, "bars", lambda: T.daily_bars(spark, sf))


def _two_indices(bars):
    """The index the queries compare with, and another that they have to leave alone."""
    return B.index_series(bars).unionByName(B.index_series(bars.withColumn("close", F.col("low") * 2), "LOW"))


@query("daily_bars", with_([Q.BARS], "select ticker, date, open, high, low, close, volume, traded_value from bars"))
def daily_bars(spark, sf):
    return T.daily_bars(spark, sf)


@query("keep_last_bar", """select printf('SUPPLIER#%09d', l_suppkey) as ticker, cast(l_shipdate as date) as date, max(struct_pack(o := l_orderkey, n := l_linenumber, c := l_extendedprice)).c as close from lineitem group by all""")
def keep_last_bar(spark, sf):
    """Several rows per supplier and day; the one that arrived last stays."""
    li = T.table(spark, sf, "lineitem").select(
        T.supplier_ticker(F.col("l_suppkey")).alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("close"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("arrival"))
    return B.keep_last_bar(li, "arrival")


@query("last_sessions", with_([Q.BARS], """select ticker, count(*) as n, min(date) as first_date, max(date) as last_date from bars
 where date in (select distinct date from bars where date <= date '2000-06-30' order by date desc limit 260) group by ticker"""))
def last_sessions(spark, sf):
    return B.last_sessions(bars_table(spark, sf), "2000-06-30", 260).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_PRICE_CTES = [Q.BARS, Q.SEQ, Q.RSI, Q.PRICE]


def _price(names: str):
    return with_(_PRICE_CTES, f"select ticker, {names} from price")


@query("price_metrics", _price("close_price, return_1y, return_6m, cagr_5y, drawdown_recovery, drawdown_normalization, rsi_state, price_vs_200dma, price_vs_50dma, volatility_compression, volume, avg_daily_turnover_cr"))
def price_metrics(spark, sf):
    return prices(spark, sf).drop("rsi_14")


@query("price_returns", _price("return_1y, return_6m, cagr_5y"))
def price_returns(spark, sf):
    return prices(spark, sf).select("ticker", "return_1y", "return_6m", "cagr_5y")


@query("sma_distance", _price("price_vs_50dma, price_vs_200dma"))
def sma_distance(spark, sf):
    return prices(spark, sf).select("ticker", "price_vs_50dma", "price_vs_200dma")


@query("rsi14", with_(_PRICE_CTES, f"select ticker, {Q.r('rsi_14', 6)} as rsi_14, rsi_state from price"))
def rsi14(spark, sf):
    from ratewell.functions.numeric import rounded

    return prices(spark, sf).select("ticker", rounded(F.col("rsi_14"), 6).alias("rsi_14"), "rsi_state")


@query("atr_compression", _price("volatility_compression"))
def atr_compression(spark, sf):
    return prices(spark, sf).select("ticker", "volatility_compression")


@query("drawdown_recovery", _price("drawdown_recovery"))
def drawdown_recovery(spark, sf):
    return prices(spark, sf).select("ticker", "drawdown_recovery")


@query("volume_turnover", _price("volume, avg_daily_turnover_cr"))
def volume_turnover(spark, sf):
    return prices(spark, sf).select("ticker", "volume", "avg_daily_turnover_cr")


_IDX = ("iseq as (select date, close, row_number() over (order by date desc) - 1 as b from index_bars)")


def _ib(k: int) -> str:
    return f"(select close from iseq where b = {k})"


@query("index_returns", with_([Q.BARS, Q.INDEX, _IDX], f"""select 'ALL' as index_name, (select count(*) from iseq) as sessions, {Q.r(_ib(0))} as latest_close,
 {Q.r(f'({_ib(0)} / {_ib(21)} - 1.0) * 100')} as return_1m, {Q.r(f'({_ib(0)} / {_ib(65)} - 1.0) * 100')} as return_3m,
 {Q.r(f'({_ib(0)} / {_ib(129)} - 1.0) * 100')} as return_6m, {Q.r(f'({_ib(0)} / {_ib(251)} - 1.0) * 100')} as return_1y"""))
def index_returns(spark, sf):
    out = B.index_returns(B.index_series(bars_once(spark, sf)))
    return out.withColumn("sessions", F.col("sessions").cast("long"))


# ADX by its recursions: three Wilder averages, then the average of the directional index
_ADX = ["""moves as materialized (select ticker, i - 1 as j, n, greatest(high - low, abs(high - pc), abs(low - pc)) as tr,
 case when high - ph > pl - low and high - ph > 0 then high - ph else 0 end as u, case when pl - low > high - ph and pl - low > 0 then pl - low else 0 end as d from seq where i > 1)""",
 """adx0 as (select ticker, 14 as j, avg(tr) as a, avg(u) as u, avg(d) as d from moves where j <= 14 group by ticker),
 adx1 as (select * from adx0 union all select m.ticker, m.j, (x.a * 13 + m.tr) / 14, (x.u * 13 + m.u) / 14, (x.d * 13 + m.d) / 14 from adx1 x join moves m on m.ticker = x.ticker and m.j = x.j + 1)""",
 """dx as materialized (select ticker, j - 13 as k, u > d as up, abs(u - d) / case when u + d = 0 then 1e-10 else u + d end * 100 as v from adx1)""",
 """adx2 as (select ticker, 14 as k, avg(v) as v from dx where k <= 14 group by ticker),
 adx3 as (select * from adx2 union all select d.ticker, d.k, (x.v * 13 + d.v) / 14 from adx3 x join dx d on d.ticker = x.ticker and d.k = x.k + 1)""",
 f"""trend as (select ticker, {Q.r(Q.clip('50 + v * case when up then 0.5 else -0.5 end', 0, 100))} as trend_strength from (
 select x.ticker, x.v, d.up, row_number() over (partition by x.ticker order by x.k desc) as p from adx3 x join dx d using (ticker, k)) where p = 1)"""]


@query("adx_trend", with_([Q.BARS, Q.SEQ] + _ADX, "select ticker, trend_strength from trend"))
def adx_trend(spark, sf):
    bars = keyed_bars_table(spark, sf)
    return T.named(B.momentum_metrics(spread(bars, "ticker"), B.index_series(bars))).select("ticker", "trend_strength")


_YEARBARS = """yearbars as materialized (select *, least(n, 252) as m, least(n, 252) - 1 - (n - i) as pos, max(close) over (partition by ticker order by date) as peak from seq where n - i < 252)"""
_MOM = [Q.BARS, Q.INDEX, _IDX, Q.SEQ, _YEARBARS] + _ADX + [f"""fit as (select ticker, max(m) as m, regr_slope(ln(close), pos) as s, regr_intercept(ln(close), pos) as c from yearbars group by ticker)""",
 f"""resid as (select y.ticker, stddev_pop(ln(close) - (s * pos + c)) as sd, max(case when n = i then ln(close) - (s * pos + c) end) as last from yearbars y join fit using (ticker) group by y.ticker)""",
 f"""mom as (select ticker, max(n) as n, {Q.r(Q.clip('sum(case when pos >= 20 and close / c20 - 1 > 0 then pos * 1.0 / m else 0 end) / sum(case when pos >= 20 then pos * 1.0 / m end) * greatest(0, 1 - max((peak - close) / peak) * 2) * 100', 0, 100))} as momentum_quality,
 max(close) as hi, min(close) as lo, max(case when n = i then close end) as last from yearbars group by ticker)""",
 f"""vols as (select ticker, max(n) as n, {Q._mean('volume', 20)} as v20, {Q._mean('volume', 60, 60)} as v60, {Q._back('close', 0)} as c0, {Q._back('close', 129)} as c129, {Q._back('close', 251)} as c251 from seq group by ticker)"""]
_DUAL = (Q.clip('((c0 / c251 - 1.0) * 100 - 6.5) / 40 * 50 + 25', 0, 50) + " + "
         + Q.clip(f"(((c0 / c251 - 1.0) * 100 - ({_ib(0)} / {_ib(251)} - 1.0) * 100) * 0.6e0 + (coalesce((c0 / c129 - 1.0) * 100, 0) - ({_ib(0)} / {_ib(129)} - 1.0) * 100) * 0.4e0) / 30 * 50 + 25", 0, 50))
_VF = f"case when v60 > 0 then {Q.clip('v20 / v60', 0.5, 2.0)} else 1e0 end"


@query("momentum_metrics", with_(_MOM, f"""select v.ticker, {Q.r(_DUAL)} as dual_momentum, case when v.n >= 60 then momentum_quality end as momentum_quality, trend_strength,
 case when v.n >= 60 then case when sd = 0 then 50.0 else {Q.r(Q.clip('50 - r.last / sd * 25', 0, 100))} end end as mean_reversion_risk,
 case when v.n >= 60 then case when hi = lo then 50.0 else {Q.r(Q.clip(f'(m.last - lo) / (hi - lo) * 80 + case when m.last >= hi * 0.95e0 then 10 * {_VF} else 0 end', 0, 100))} end end as breakout_score
 from vols v join mom m using (ticker) join resid r using (ticker) left join trend t using (ticker)"""))
def momentum_metrics(spark, sf):
    bars = keyed_bars_table(spark, sf)
    return T.named(B.momentum_metrics(spread(bars, "ticker"), _two_indices(bars)))


@query("momentum_merge", with_([Q.GEO, Q.SUPPLIERS] + _MOM, f"""select s.ticker, case when v.ticker is null then null else {Q.r(_DUAL)} end as "Dual Momentum", v.ticker is not null as updated
 from suppliers s left join vols v using (ticker)"""))
def momentum_merge(spark, sf):
    """Momentum scores merged into the supplier export by ticker."""
    bars = keyed_bars_table(spark, sf)
    base = T.suppliers(spark, sf).select(T.supplier_ticker(F.col("suppkey")).alias("ticker"))
    return merge_overwrite(base, T.named(B.momentum_metrics(spread(bars, "ticker"), B.index_series(bars))), "ticker", {"dual_momentum": "Dual Momentum"})


@query("rs_turn", with_([Q.BARS, Q.INDEX, """rsq as (select ticker, b.close / x.close as s, row_number() over (partition by ticker order by b.date desc) - 1 as back,
 count(*) over (partition by ticker) as n from bars b join index_bars x using (date))"""],
 f"""select ticker, case when max(n) >= 17 then {Q.r('regr_slope(case when back < 5 then s end, -back) - regr_slope(case when back >= 5 and back < 15 then s end, -back)', 6)} end as rs_turn from rsq group by ticker"""))
def rs_turn(spark, sf):
    from ratewell.functions.numeric import rounded

    bars = bars_table(spark, sf)
    return B.relative_strength_turn(bars, _two_indices(bars)).select("ticker", rounded(F.col("rs_turn"), 6).alias("rs_turn"))


@query("delivery_metrics", f"""with d as (select printf('SUPPLIER#%09d', l_suppkey) as symbol, cast(l_shipdate as date) as date, sum(case when l_returnflag <> 'R' then l_quantity else 0 end) / sum(l_quantity) * 100 as p from lineitem group by all),
 s as (select *, row_number() over (partition by symbol order by date desc) as b, count(*) over (partition by symbol) as n from d),
 m as (select symbol, max(n) as n, case when max(n) >= 5 then avg(case when b <= 20 then p end) end as a20, case when max(n) >= 10 then avg(case when b <= 60 then p end) end as a60 from s group by symbol)
 select symbol, {Q.r('a20')} as delivery_pct_20d_avg, {Q.r('a60')} as delivery_pct_60d_avg, case when a60 > 0 then {Q.r(Q.clip('a20 / a60 * 50.0', 0, 100))} end as volume_delivery, n as sessions_available from m""")
def delivery_metrics(spark, sf):
    li = T.table(spark, sf, "lineitem")
    rows = li.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)).alias("delivered"),
        F.sum("l_quantity").alias("traded")).withColumn("symbol", T.supplier_ticker(F.col("l_suppkey")))
    return B.delivery_metrics(rows.select("symbol", "date", delivery_pct(
        F.lit("-"), F.col("delivered").cast("string"), F.col("traded").cast("string")).alias("delivery_pct")))


# --- fiscal years ----------------------------------------------------------------------------
_GROWTH = [_YEAR, """gy as (select *, row_number() over (partition by entity order by fy desc) - 1 as b, lag(c) over (partition by entity order by fy) as before from yr)""",
 """rates as (select entity, count(*) as n_rates, avg(c * 1.0 / before - 1.0) as m, stddev_samp(c * 1.0 / before - 1.0) as sd from gy where before > 0 and b < 4 group by entity)""",
 """ends as (select entity, count(*) as nv, max(case when b = 0 then c end) / 1e2 as v0, max(case when b = 1 then c end) / 1e2 as v1, max(case when b = 3 then c end) / 1e2 as v3 from gy group by entity)"""]


@query("growth_metrics", with_(_GROWTH, f"""select entity, v0 as latest, {Q.r('(v0 / v1 - 1.0) * 100')} as growth_yoy, {Q.r('(power(v0 / v3, 1e0 / 3e0) - 1.0) * 100')} as cagr_3y,
 case when nv >= 4 and n_rates >= 3 then case when abs(m) < 1e-9 then 50.0 else {Q.r(Q.clip('1.0 - least(sd / abs(m), 2.0)', 0, 1) + ' * 100.0')} end end as growth_stability
 from ends left join rates using (entity)"""))
def growth_metrics(spark, sf):
    return A.growth_metrics(T.customer_years(spark, sf), "revenue")


@query("margin_trend", with_([_YEAR, "mt as (select entity, fy - max(fy) over (partition by entity) + 2 as x, f * 100.0 / c as y from yr)"],
 f"select entity, {Q.r('case when count(*) >= 2 then case when stddev_pop(y) < 1e-9 then 0.0 else regr_slope(y, x) end end', 6)} as margin_trend from mt where x >= 0 group by entity"))
def margin_trend(spark, sf):
    from ratewell.functions.numeric import rounded

    return A.margin_trend(T.customer_years(spark, sf), "margin").select("entity", rounded(F.col("margin_trend"), 6).alias("margin_trend"))


@query("fcf_consistency", with_([_YEAR, "fy5 as (select *, row_number() over (partition by entity order by fy desc) as b from yr)"],
 f"select entity, case when count(*) >= 3 then {Q.r('count(*) filter (where f - p > 0) / count(*) * 100.0', 1)} end as fcf_consistency from fy5 where b <= 5 group by entity"))
def fcf_consistency(spark, sf):
    return A.positive_share(T.customer_years(spark, sf), "fcf")


@query("quarterly_growth", f"""with q as (select o_custkey as entity, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as q, sum(cast(round(o_totalprice * 100) as bigint)) as c from orders group by all),
 s as (select entity, max(q) as b, min(q) as a from q group by entity),
 v as (select s.entity, s.a, s.b, b - k as q, coalesce(c, 0) / 1e2 as c, k from s cross join range(8) r(k) left join q on q.entity = s.entity and q.q = s.b - k where b - k >= a)
 select entity, cast(b as integer) as quarter, ttm, case when p > 0 then {Q.r('(ttm / p - 1.0) * 100')} end as ttm_growth, case when y > 0 then {Q.r('(c0 / y - 1.0) * 100', 1)} end as quarter_growth from (
 select entity, b, case when count(*) filter (where k < 4) = 4 then sum(c) filter (where k < 4) end as ttm, case when count(*) filter (where k >= 4) = 4 then sum(c) filter (where k >= 4) end as p,
 max(case when k = 0 then c end) as c0, max(case when k = 4 then c end) as y from v group by entity, b)""")
def quarterly_growth(spark, sf):
    return A.quarterly_growth(T.customer_quarters(spark, sf), "revenue")


@query("annual_without_ttm", with_([_YEAR], "select entity, array_to_string(list(cast(fy as varchar) order by fy), ',') as years from yr group by entity"))
def annual_without_ttm(spark, sf):
    """Year columns of a row label, values and a TTM column, with the TTM value dropped again."""
    y = T.customer_years(spark, sf).groupBy("entity").agg(F.array_sort(F.collect_list("fy")).alias("y"))
    values = F.concat(F.transform("y", lambda v: v.cast("string")), F.array(F.lit("sum")))
    headers = F.concat(F.array(F.lit("")), F.transform("y", lambda v: F.concat(F.lit("Mar "), v.cast("string"))), F.array(F.lit("ttm")))
    return y.select("entity", F.array_join(A.annual_values(values, headers), ",").alias("years"))


_BAL = [_YEAR, """bal as materialized (select *, c / 1e2 as sales, f / 1e2 as pat, p / 1e2 as borrow, (c - p) / 1e2 as eq, (f + n * 100) / 1e2 as ca, (p + n * 100) / 1e2 as cl, n * 1e3 as fa, (c + f) / 1e2 as ta,
 row_number() over (partition by entity order by fy desc) - 1 as b from yr)""",
 f"""br as materialized (select *, case when eq > 0 then {Q.r('borrow / eq')} end as de, case when cl > 0 then {Q.r('ca / cl')} end as cr, case when ta > 0 then {Q.r('sales / ta')} end as at, case when ta > 0 then {Q.r('pat / ta * 100.0')} end as roa from bal)"""]


@query("balance_ratios", with_(_BAL, f"""select x.entity, x.fy, x.de as debt_to_equity, y.de as de_fy1, x.cr as current_ratio, y.cr as current_ratio_fy1, x.at as asset_turnover, y.at as asset_turnover_fy1, x.roa, y.roa as roa_fy1,
 x.fa as gross_block_fy0, z.fa as gross_block_fy3, (x.sales - x.borrow) + -x.borrow as fcf, case when x.sales > 0 then {Q.r('((x.sales - x.borrow) + -x.borrow) / x.sales * 100.0')} end as fcf_yield,
 case when x.pat <> 0 then {Q.r('(x.sales - x.borrow) / x.pat')} end as cfo_pat_ratio from br x left join br y on y.entity = x.entity and y.b = 1 left join br z on z.entity = x.entity and z.b = 3 where x.b = 0"""))
def balance_ratios(spark, sf):
    o = T.table(spark, sf, "orders")
    y = o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy")).agg(
        F.sum(T.cents("o_totalprice")).alias("c"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("o_orderstatus") == "F", T.cents("o_totalprice")).otherwise(0)).alias("f"),
        F.sum(F.when(F.col("o_orderstatus") == "P", T.cents("o_totalprice")).otherwise(0)).alias("p"))
    c, f, p, n = (F.col(x) for x in "cfpn")
    return A.balance_ratios(y.select(
        "entity", "fy", (c / 100.0).alias("sales"), (f / 100.0).alias("pat"), (p / 100.0).alias("borrowings"),
        ((c - p) / 100.0).alias("equity"), ((f + n * 100) / 100.0).alias("current_assets"),
        ((p + n * 100) / 100.0).alias("current_liabilities"), (n * 1000.0).alias("fixed_assets"),
        ((c + f) / 100.0).alias("total_assets"), (c / 100.0 - p / 100.0).alias("cfo"), (-p / 100.0).alias("cfi"),
        (c / 100.0).alias("market_cap")))


# --- holdings, deals, earnings -----------------------------------------------------------------
_PCT = "cast(floor(sum(case when {c} then cents else 0 end) * 1e4 / sum(cents)) / 1e2 as double)"
_HOLD = [f"""h as materialized (select 'C' || o_custkey as symbol, o_custkey as k, cast(make_date(cast(year(o_orderdate) as integer), 12, 31) as date) as as_of, {', '.join(_PCT.format(c=f"substr(o_orderpriority, 1, 1) = '{i}'") + f' as p{i}' for i in range(1, 5))}
 from (select *, cast(round(o_totalprice * 100) as bigint) as cents from orders) group by o_custkey, year(o_orderdate))"""]


def _holdings(spark, sf):
    o = T.table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("as_of"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("i"), T.cents("o_totalprice").alias("cents"))
    sums = o.groupBy("symbol", "as_of").agg(F.sum("cents").alias("all"), *[
        F.sum(F.when(F.col("i") == i, F.col("cents")).otherwise(0)).alias(f"s{i}") for i in range(1, 5)])
    names = ["Promoter & Promoter Group", "Mutual Funds", "Foreign Institutional Investors", "Insurance companies"]
    rows = F.array(*[F.struct(F.lit(n).alias("category"), (F.floor(F.col(f"s{i}") * 10000.0 / F.col("all")) / 100.0).alias("pct"),
                              F.lit(i).alias("arrival")) for i, n in enumerate(names, start=1)])
    return W.holdings_wide(sums.select("symbol", "as_of", F.explode(rows).alias("r")).select("symbol", "as_of", "r.*"), "arrival")


@query("holdings_pivot", with_(_HOLD, "select symbol, as_of, p1 as promoter_holding_pct, p2 as mf_holding_pct, p3 as fii_holding_pct, p4 as insurance_holding_pct from h"))
def holdings_pivot(spark, sf):
    return _holdings(spark, sf)


@query("latest_holdings", with_(_HOLD, "select symbol, p1 as promoter_holding_pct, p3 as fii_holding_pct from h where as_of = (select max(as_of) from h)"))
def latest_holdings(spark, sf):
    return W.latest_snapshot(_holdings(spark, sf)).select("symbol", "promoter_holding_pct", "fii_holding_pct")


@query("net_deal_flows", """select 'S' || l_suppkey as symbol, cast(sum(cast(l_quantity * 1000 as bigint) * case when l_returnflag = 'R' then -1 else 1 end) as bigint) as net_quantity,
 case when sum(l_quantity * case when l_returnflag = 'R' then -1 else 1 end) > 0 then 75e0 when sum(l_quantity * case when l_returnflag = 'R' then -1 else 1 end) < 0 then 25e0 else 50e0 end as bulk_deal_signal from lineitem group by l_suppkey""")
def net_deal_flows(spark, sf):
    """Net bought quantity per symbol out of JSON deal payloads."""
    return W.net_flows(L.large_deals(_deal_payloads(spark, sf)))


@query("institutional_scores", with_(_HOLD + ["""deal as (select 'C' || l_suppkey as symbol, sum(l_quantity * case when l_returnflag = 'R' then -1 else 1 end) as q from lineitem group by 1)""",
 "hh as (select *, lag(p3) over w as b3, lag(p2) over w as b2, row_number() over (partition by symbol order by as_of desc) as r from h window w as (partition by symbol order by as_of))"],
 f"""select symbol, {Q.r(Q.clip('(p3 + p2 + p4) * 1.3e0 + 20.0', 0, 100))} as institutional_interest, {Q.r(Q.clip('(p3 - b3) * 6.0 + 50.0', 0, 100))} as fii_holding_change,
 {Q.r(Q.clip('(p2 - b2) * 6.0 + 50.0', 0, 100))} as mf_holding_change, case when b2 < 0.1 and p2 >= 0.5 then 80e0 end as fresh_mf_entry,
 case when q > 0 then 75e0 when q < 0 then 25e0 when q = 0 then 50e0 end as bulk_deal_signal from hh left join deal using (symbol) where r = 1"""))
def institutional_scores(spark, sf):
    deals = T.table(spark, sf, "lineitem").select(
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("buy_sell"), F.col("l_quantity").alias("quantity"))
    return W.institutional_metrics(_holdings(spark, sf), deals)


_FLOW = Q.universe(True)
_EARN = f"""earn as materialized (select ticker, {Q.r(Q.clip('(rev_growth_yoy - rev_cagr_3y) * 1.5 + 50.0', 0, 100))} as revenue_surprise, {Q.r(Q.clip('(eps_growth_yoy - eps_cagr_3y) * 1.5 + 50.0', 0, 100))} as profit_surprise,
 case when opm_fy2 > 0 then {Q.r(Q.clip('(ebitda_margin - opm_fy2) * 3.0 + 50.0', 0, 100))} end as margin_surprise,
 case cast(rev_growth_yoy > rev_cagr_3y as integer) + cast(eps_growth_yoy > eps_cagr_3y as integer) when 2 then 80e0 when 1 then 60e0 when 0 then 30e0 end as earnings_momentum from universe)"""
_EARN2 = f"""earn2 as materialized (select *, {Q.r('list_avg(list_filter([revenue_surprise, profit_surprise, margin_surprise], lambda x: x is not null))')} as earnings_surprise_composite from earn)"""


def _earnings(spark, sf):
    return W.earnings_surprise(universe(spark, sf).withColumn("opm_5y", F.col("opm_fy2")))


@query("earnings_surprise", with_(_FLOW + [_EARN, _EARN2], "select ticker, revenue_surprise, profit_surprise, margin_surprise, earnings_momentum, earnings_surprise_composite from earn2"))
def earnings_surprise(spark, sf):
    return _earnings(spark, sf)


@query("earnings_stats", with_(_FLOW + [_EARN, _EARN2], f"""select count(*) as n, {Q.r('cast(sum(cast(round(earnings_surprise_composite * 100) as bigint)) as double) / 100 / count(*)')} as mean_composite,
 count(*) filter (where earnings_surprise_composite > 70) as n_beats, count(*) filter (where earnings_surprise_composite < 30) as n_misses from earn2 where earnings_surprise_composite is not null"""))
def earnings_stats(spark, sf):
    return W.earnings_stats(_earnings(spark, sf))


_FWD = ["""fwd as materialized (select ticker, pe_percentile as pe, coalesce(eps_cagr_3y * 0.6e0 + eps_growth_yoy * 0.4e0, eps_cagr_3y, eps_growth_yoy) as g, coalesce(rev_cagr_3y * 0.6e0 + rev_growth_yoy * 0.4e0, rev_cagr_3y, rev_growth_yoy) as rg from universe)""",
 """fwd2 as (select *, case when pe > 0 and g > -80 and 1 + g / 100 > 0.1 then pe / (1 + g / 100) end as fpe, case when pe > 0 and g > 1 then pe / g end as peg from fwd)""",
 f"""fwd3 as materialized (select *, case when fpe is not null then {Q.r('greatest(5.0, least(95.0, 100 - fpe * 1.5e0))')} end as ps, {Q.r('''case when peg <= 0 then 10e0 when peg < 0.5 then 90e0 when peg < 1 then 80 - (peg - 0.5e0) * 20 when peg < 1.5 then 70 - (peg - 1) * 30
 when peg < 2 then 55 - (peg - 1.5e0) * 30 when peg is not null then greatest(10e0, 40 - (peg - 2) * 10) end''')} as gs, case when g > 15 then least(g, 50) * 0.3e0 end as quality from fwd2)"""]
_K = "(case when ps is null then 0 else 1 end + case when gs is null then 0 else 1 end + case when quality is null then 0 else 1 end)"


@query("forward_value", with_(_FLOW + _FWD, f"""select ticker, {Q.r('fpe')} as forward_pe, ps as forward_pe_score, {Q.r('peg')} as peg_ratio, gs as peg_score,
 {Q.r(f'(coalesce(ps * 0.3e0, 0) + coalesce(gs * 0.4e0, 0) + coalesce(quality, 0)) / case {_K} when 1 then 0.3e0 when 2 then 0.7e0 when 3 then 1e0 end')} as garp_score,
 {Q.r('g')} as est_eps_growth, {Q.r('rg')} as est_rev_growth from fwd3"""))
def forward_value(spark, sf):
    return W.forward_value(universe(spark, sf).withColumn("pe", F.col("pe_percentile")))


@query("forward_stats", with_(_FLOW + _FWD, f"""select {Q.r('median(p) filter (where p > 0 and p < 5)')} as median_peg, count(*) filter (where p > 0 and p < 1) as n_garp, count(*) filter (where p > 2 and p < 5) as n_overvalued,
 {Q.r('median(f) filter (where f > 0 and f < 200)', 1)} as median_forward_pe from (select {Q.r('peg')} as p, {Q.r('fpe')} as f from fwd3)"""))
def forward_stats(spark, sf):
    from ratewell.functions.numeric import rounded
    from ratewell.operators.ordered import exact_quantiles

    scores = W.forward_value(universe(spark, sf).withColumn("pe", F.col("pe_percentile")))
    peg, fpe = F.col("peg_ratio"), F.col("forward_pe")
    both = scores.select(F.explode(F.array(
        F.struct(F.lit("peg").alias("kind"), F.when((peg > 0) & (peg < 5), peg).alias("v")),
        F.struct(F.lit("fpe").alias("kind"), F.when((fpe > 0) & (fpe < 200), fpe).alias("v")))).alias("x")).select("x.*")
    medians = exact_quantiles(both, ["kind"], "v", {"median": 0.5}).agg(
        rounded(F.max(F.when(F.col("kind") == "peg", F.col("median")))).alias("median_peg"),
        rounded(F.max(F.when(F.col("kind") == "fpe", F.col("median"))), 1).alias("median_forward_pe"))
    counts = scores.agg(F.count_if((peg > 0) & (peg < 1)).alias("n_garp"), F.count_if((peg > 2) & (peg < 5)).alias("n_overvalued"))
    return counts.withColumn("m", medians.select(F.struct("*").alias("s")).scalar()).select("m.*", "n_garp", "n_overvalued")
