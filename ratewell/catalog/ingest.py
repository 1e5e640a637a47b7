"""Queries over the parsing, cleaning, merging and derivation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.catalog import sql as Q
from ratewell.catalog.base import query
from ratewell.catalog.sql import with_
from ratewell.functions import formulas as M
from ratewell.functions import text as X
from ratewell.functions.numeric import rounded
from ratewell.functions.taxonomy import template_code, template_name
from ratewell.operators import merge as G
from ratewell.operators import quality as K
from ratewell.operators.bars import price_metrics
from ratewell.plans import universe as U
from ratewell.session import shared_folder
from ratewell.sources import files as L
from ratewell.sources import sinks
from ratewell.sources import tables as T
from ratewell.sources.export import supplier_export

_TYPED = [Q.GEO, Q.SUPPLIERS, Q.EXPORT, Q.MODIFIED]
_METRICS = tuple(Q._ROUND_TRIP) + ("provision_coverage",)
_INPUTS = tuple(m for m in Q.INPUTS if m != "roe_ttm")


@query("export_metrics", with_(_TYPED, f"select ticker, sector, industry, basic_industry, template, {', '.join(_METRICS)} from typed"))
def export_metrics(spark, sf):
    """Metric columns parsed out of the untyped export."""
    return U.read_export(supplier_export(spark, sf)).select(
        "ticker", "sector", "industry", "basic_industry", "template", *_METRICS)


@query("export_inputs", with_(_TYPED, f"select ticker, {', '.join(_INPUTS)}, asm_stage, gsm_stage, t2t as is_t2t, event_risk as governance_event from typed"))
def export_inputs(spark, sf):
    rows = U.read_export(supplier_export(spark, sf))
    return rows.select("ticker", *_INPUTS, "asm_stage", "gsm_stage", "is_t2t",
                       M.governance_risk(F.col("governance_events")).alias("governance_event"))


@query("export_csv_round_trip", with_(_TYPED, "select ticker, pe_percentile, intrinsic_value, book_value_per_share, pledge_pct from typed"))
def export_csv_round_trip(spark, sf):
    """The export written as CSV and scanned back as text."""
    import uuid

    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    sinks.write_csv(supplier_export(spark, sf), path, order=["NSE Symbol"])
    return U.read_export(L.read_text_csv(spark, path)).select(
        "ticker", "pe_percentile", "intrinsic_value", "book_value_per_share", "pledge_pct")


@query("derived_metrics", with_(Q.universe(False), "select ticker, " + ", ".join(f"cast({m} as double) as {m}" for m in Q.DERIVED) + " from universe"))
def derived_metrics(spark, sf):
    """The derivation cascade over export values alone (no bars, so nothing that needs a price)."""
    return U.load_universe(supplier_export(spark, sf)).select("ticker", *Q.DERIVED)


@query("derived_metrics_with_bars", with_(Q.universe(True), "select ticker, close_price, return_1y, cast(liquidity_manipulation as double) as liquidity_manipulation, iv_gap, discount_to_iv from universe"))
def derived_metrics_with_bars(spark, sf):
    return U.load_universe(supplier_export(spark, sf), price=T.named(price_metrics(T.keyed_bars(spark, sf)))).select(
        "ticker", "close_price", "return_1y", "liquidity_manipulation", "iv_gap", "discount_to_iv")


@query("lenient_numbers", """select o_orderkey, case when o_orderkey % 11 in (0, 1, 2, 3, 4) then null else o_totalprice end as price from orders""")
def lenient_numbers(spark, sf):
    """Prices written in many notations, unreadable ones included, parsed back."""
    o = T.table(spark, sf, "orders")
    k, p = F.col("o_orderkey") % 11, F.col("o_totalprice")
    text = (
        F.when(k == 0, F.lit(" nan ")).when(k == 1, F.lit("-")).when(k == 2, F.lit("")).when(k == 3, F.lit("12x4"))
        .when(k == 4, F.lit("None")).when(k == 5, F.concat(F.lit("₹ "), F.format_number(p, 2), F.lit(" Cr")))
        .when(k == 6, F.concat(F.format_string("%.2f", p), F.lit("%"))).when(k == 7, F.concat(F.lit("  "), F.format_string("%.2f", p)))
        .otherwise(F.format_number(p, 2)))
    return o.select("o_orderkey", X.parse_number(text).alias("price"))


@query("parse_tokens", """select event_id, cast(ts as date) as day, cast(case when event_id % 4 = 3 then 1 else event_id % 5 end as integer) as stage,
 event_id % 3 = 0 as flag, cast(case event_id % 3 when 0 then 2 when 1 then 3 else 1 end as bigint) as n_items from events""")
def parse_tokens(spark, sf):
    """Dates in four notations, stages, flags and event lists."""
    e = T.table(spark, sf, "events")
    i = F.col("event_id")
    stamp = (
        F.when(i % 4 == 0, F.date_format("ts", "yyyyMMdd")).when(i % 4 == 1, F.upper(F.date_format("ts", "ddMMMyyyy")))
        .when(i % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "ddMMMyyyy")))
    stage = F.when(i % 4 == 3, F.lit("Stage ?")).when(i % 4 == 0, F.concat(F.lit("Stage "), (i % 5).cast("string"))).otherwise(
        (i % 5).cast("string"))
    flag = F.when(i % 3 == 0, F.when(i % 2 == 0, " Yes").otherwise("T")).otherwise(F.when(i % 2 == 0, "no").otherwise(""))
    items = F.when(i % 3 == 0, "agm_delayed; auditor_resignation ;").when(i % 3 == 1, "a, b ,c").otherwise(F.col("event_type"))
    return e.select("event_id", X.parse_date(stamp).alias("day"), X.parse_stage(stage).alias("stage"),
                    X.parse_bool(flag).alias("flag"), F.size(X.parse_events(items)).cast("long").alias("n_items"))


_FUND = """select p_partkey, p_name || case p_partkey % 8 when 0 then ' ETF' when 1 then ' Gold Etf' when 2 then ' BeES' when 3 then ' index fund' when 4 then ' betfair'
 when 5 then ' Beesley' when 6 then ' etfs' else '' end as name from part"""


@query("fund_like_filter", f"""select p_partkey, name from ({_FUND}) where not regexp_matches(lower(name), '(^|[^a-z0-9_])(etf|etn|bees|index fund|exchange traded fund)($|[^a-z0-9_])')""")
def fund_like_filter(spark, sf):
    p = T.table(spark, sf, "part")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (" ETF", " Gold Etf", " BeES", " index fund", " betfair", " Beesley", " etfs", "")]),
                          (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", F.concat("p_name", suffix).alias("name")).where(~X.is_fund_like(F.col("name")))


@query("template_routing", with_([Q.GEO, Q.CUSTOMERS], """select ticker, t as template, case t when 'A' then 'General' when 'B' then 'Bank' else 'NBFC/HFC' end as template_name from (
 select ticker, case when ticker % 10 in (0, 4, 6) then 'C' when ticker % 10 in (1, 2, 7) then 'B' else 'A' end as t from customers)"""))
def template_routing(spark, sf):
    """Labels in uneven case and spacing routed to templates."""
    c = T.customers(spark, sf)
    k = (F.col("ticker") % 10).cast("int")

    def pick(*labels):
        return F.element_at(F.array(*[F.lit(x) for x in labels]), k + 1)

    macro = pick("x", "x", "x", "x", "x", "x", "x", "Financial  Services", "Financial Services", "x")
    sector = pick("x", "x", "x", "x", "Financial Services", "x", "x", "FINANCIAL services", "Financial Services", "x")
    industry = pick("Micro  Finance", "Other BANK", "Regional Bankers", "Software", "Other Financial Services", "Finance",
                    "Special HFC unit", "Brokers", "Brokers", "")
    basic = pick("x", "x", "x", "Bank notes", "Finance", "Finance", "x", "Small bank", "Exchange", "x")
    code = template_code(macro, sector, industry, basic)
    return c.select("ticker", code.alias("template"), template_name(code).alias("template_name"))


@query("recommendation_alias", """select o_orderpriority, case substr(o_orderpriority, 1, 1) when '1' then 'Buy Candidate' when '2' then 'Watchlist' when '3' then 'Unsupported' when '4' then 'Strong' else '' end as recommendation,
 count(*) as n from orders group by all""")
def recommendation_alias(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    raw = F.when(first == "1", " BUY ").when(first == "2", "hold").when(first == "3", "Unsupported Data").when(first == "4", " Strong ")
    return T.table(spark, sf, "orders").groupBy("o_orderpriority", X.normal_recommendation(raw).alias("recommendation")).agg(
        F.count(F.lit(1)).alias("n"))


@query("metric_names", with_([Q.GEO, Q.CUSTOMERS], f"""select metric, {"case metric " + " ".join(f"when '{k}' then {Q.q(v)}" for k, v in S.METRIC_NAMES.items()) + " else replace(metric, '_', ' ') end"} as metric_name, count(*) as n from (
 select [{', '.join(Q.q(m) for m in S.configured_metrics())}][(ticker % {len(S.configured_metrics())}) + 1] as metric from customers) group by all"""))
def metric_names(spark, sf):
    names = S.configured_metrics()
    metric = F.element_at(F.array(*[F.lit(m) for m in names]), (F.col("ticker") % len(names) + 1).cast("int"))
    return T.customers(spark, sf).groupBy(metric.alias("metric")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "metric_name", X.metric_name(F.col("metric")))


# --- universe preparation --------------------------------------------------------------------
_EOD = """eod as (select case c_custkey % 4 when 0 then 'cu' || c_custkey || '.NS' when 1 then ' CU' || c_custkey || ' ' when 2 then 'Cu' || c_custkey else case when c_acctbal < -500 then 'none' else 'cu' || c_custkey end end as sym,
 case when c_mktsegment = 'BUILDING' then 'BE' else ' eq ' end as series, c_name as name, case when c_mktsegment = 'MACHINERY' then '' else c_mktsegment end as sector, c_custkey as k from customer)"""
_UNI = """uni as materialized (select 'CU' || k as sym, name, sector, k from eod where upper(trim(series)) = 'EQ' and lower(trim(sym)) <> 'none')"""
_FUNDS = """funds as materialized (select 'CU' || o_custkey as sym, o_custkey as k, cast(floor(sum(cast(round(o_totalprice * 100) as bigint)) / 1e2) as bigint) as price from orders where o_orderstatus = 'F' group by o_custkey)"""


def _eod(spark, sf):
    c = T.table(spark, sf, "customer")
    k = F.col("c_custkey")
    text = k.cast("string")
    symbol = (
        F.when(k % 4 == 0, F.concat(F.lit("cu"), text, F.lit(".NS"))).when(k % 4 == 1, F.concat(F.lit(" CU"), text, F.lit(" ")))
        .when(k % 4 == 2, F.concat(F.lit("Cu"), text)).when(F.col("c_acctbal") < -500, F.lit("none")).otherwise(F.concat(F.lit("cu"), text)))
    rows = c.select(
        symbol.alias("SYMBOL"), F.when(F.col("c_mktsegment") == "BUILDING", "BE").otherwise(" eq ").alias("SERIES"),
        F.col("c_name").alias("NAME OF COMPANY"), F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("Sector"),
        k.alias("arrival"))
    again = rows.withColumn("arrival", F.col("arrival") + 1_000_000_000_000).withColumn("NAME OF COMPANY", F.lit("later copy"))
    return rows.unionByName(again)


def _fundamentals(spark, sf):
    o = T.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    sums = o.groupBy("o_custkey").agg(F.sum(T.cents("o_totalprice")).alias("c"))
    k = F.col("o_custkey")
    return sums.select(
        F.concat(F.lit("cu"), k.cast("string")).alias("Symbol"),
        F.when(k % 7 == 0, F.lit("nan")).otherwise(F.floor(F.col("c") / 100.0).cast("long").cast("string")).alias("Current Price"),
        F.concat(F.lit("S"), (k % 4).cast("string")).alias("fund__Sector"), F.lit("None").alias("OPM"), k.alias("arrival"))


@query("universe_symbols", with_([_EOD, _UNI], "select sym as symbol, name, sector from uni"))
def universe_symbols(spark, sf):
    """Cleaned EQ symbols, first row per symbol."""
    return U.universe_frame(_eod(spark, sf), "arrival").select(
        F.col("NSE Symbol").alias("symbol"), F.col("Name").alias("name"), F.col("Sector").alias("sector"))


@query("universe_all_series", with_([_EOD], "select count(*) as n from eod where lower(trim(sym)) <> 'none'"))
def universe_all_series(spark, sf):
    return U.universe_frame(_eod(spark, sf), "arrival", include_all_series=True).agg(F.count(F.lit(1)).alias("n"))


@query("universe_merge", with_([_EOD, _UNI, _FUNDS], f"""select u.sym as symbol, case when u.sector <> '' then u.sector when f.k is not null then 'S' || (f.k % 4) end as sector,
 case when f.k is null then null when f.k % 7 = 0 then 'nan' else cast(f.price as varchar) end as price, '' as rsi from uni u left join funds f using (sym)"""))
def universe_merge(spark, sf):
    """Universe joined to fundamentals: blanks filled from prefixed columns, template columns added."""
    return U.prepare_universe(_eod(spark, sf), _fundamentals(spark, sf), "arrival").select(
        F.col("NSE Symbol").alias("symbol"), F.col("Sector").alias("sector"), F.col("Current Price").alias("price"),
        F.col("RSI").alias("rsi"))


@query("universe_report", with_([_EOD, _UNI, _FUNDS], f"""select count(*) as n_universe_symbols, count(f.k) as n_fundamentals_matched,
 {Q.r('count(f.k) / count(*) * 100.0')} as fundamentals_match_pct from uni u left join funds f using (sym)"""))
def universe_report(spark, sf):
    return U.preparation_report(U.prepare_universe(_eod(spark, sf), _fundamentals(spark, sf), "arrival"))


@query("universe_missing", with_([_EOD, _UNI, _FUNDS], "select u.sym as symbol from uni u left join funds f using (sym) where f.k is null"))
def universe_missing(spark, sf):
    return U.missing_fundamentals(U.prepare_universe(_eod(spark, sf), _fundamentals(spark, sf), "arrival")).select(
        F.col("NSE Symbol").alias("symbol"))


@query("apply_classification", with_([_EOD, _UNI, Q.GEO], """select sym as symbol, case when sector <> '' then sector else coalesce(r_name, '') end as sector, coalesce(n_name, '') as industry
 from uni left join (select c_custkey as k, n_name, r_name from customer join geo on c_nationkey = n_nationkey where c_acctbal >= 0) using (k)"""))
def apply_classification(spark, sf):
    """Blank labels filled from a classification master that knows only customers out of debt."""
    c = T.customers(spark, sf).where(F.col("balance") >= 0)
    master = c.select(F.concat(F.lit("CU"), F.col("ticker").cast("string")).alias("Symbol"), F.col("sector").alias("Sector"),
                      F.col("industry").alias("Industry"), F.col("ticker").alias("arrival"))
    return U.apply_classification(U.universe_frame(_eod(spark, sf), "arrival"), master, "arrival").select(
        F.col("NSE Symbol").alias("symbol"), F.col("Sector").alias("sector"), F.col("Industry").alias("industry"))


_TOKENS = ("NA", "—", "None", "NaN", " - ", "nan", "x", "none")


@query("universe_merge_tokens", """select 'P' || p_partkey as symbol, case when p_partkey % 8 in (2, 4, 5, 7) then 'from funds' else ['NA', '—', 'None', 'NaN', ' - ', 'nan', 'x', 'none'][p_partkey % 8 + 1] end as sector from part""")
def universe_merge_tokens(spark, sf):
    """Which cells count as unset in a merge: blank, nan, none, - and None as written, nothing else."""
    p = T.table(spark, sf, "part")
    symbol, k = F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.col("p_partkey")
    rows = p.select(symbol.alias("NSE Symbol"), F.element_at(F.array(*map(F.lit, _TOKENS)), (k % 8 + 1).cast("int")).alias("Sector"))
    funds = p.select(symbol.alias("Symbol"), F.lit("from funds").alias("fund__Sector"), k.alias("arrival"))
    return U.merge_fundamentals(rows, funds, "arrival").select(F.col("NSE Symbol").alias("symbol"), F.col("Sector").alias("sector"))


@query("missing_classification", with_([_EOD, _UNI, Q.GEO], """select sym as symbol from uni left join (select c_custkey as k, n_name, r_name from customer join geo on c_nationkey = n_nationkey where c_acctbal >= 0) using (k) where n_name is null"""))
def missing_classification(spark, sf):
    """Symbols that the classification master leaves without industry: those of customers in debt."""
    c = T.customers(spark, sf).where(F.col("balance") >= 0)
    master = c.select(F.concat(F.lit("CU"), F.col("ticker").cast("string")).alias("Symbol"), F.col("sector").alias("Sector"), F.col("industry").alias("Industry"),
                      F.col("basic_industry").alias("Basic Industry"), F.col("ticker").alias("arrival"))
    classified = U.apply_classification(U.universe_frame(_eod(spark, sf), "arrival"), master, "arrival")
    return U.missing_classification(classified).select(F.col("NSE Symbol").alias("symbol"))


@query("taxonomy_coverage", with_([_EOD, _UNI], f"""select 'Sector' as column_name, {Q.r("count(*) filter (where sector <> '') / count(*) * 100.0")} as filled_pct from uni
 union all select 'Industry', 0e0 union all select 'Name', 100e0"""))
def taxonomy_coverage(spark, sf):
    return K.taxonomy_coverage(U.universe_frame(_eod(spark, sf), "arrival"), ["Sector", "Industry", "Name"])


# --- keyed merges ----------------------------------------------------------------------------
@query("merge_overwrite", """select c_custkey as k, case when o.p is not null then o.p else c_acctbal end as balance, coalesce(o.n, 0) as n_orders, o.k is not null as updated
 from customer left join (select o_custkey as k, case when o_custkey % 3 = 0 then null else cast(max(o_totalprice) as double) end as p, count(*) as n from orders group by 1) o on o.k = c_custkey""")
def merge_overwrite(spark, sf):
    base = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    other = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n")).withColumn("top", F.when(F.col("k") % 3 != 0, F.col("top")))
    return G.merge_overwrite(base, other, "k", {"top": "balance", "n": "n_orders"}, default=0)


@query("merge_fill", """select c_custkey as k, coalesce(case when c_acctbal >= 0 then c_acctbal end, o.p) as balance, o.n as n_orders
 from customer left join (select o_custkey as k, max(o_totalprice) as p, count(*) as n from orders group by 1) o on o.k = c_custkey""")
def merge_fill(spark, sf):
    base = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    other = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_totalprice").alias("balance"), F.count(F.lit(1)).alias("n_orders"))
    return G.merge_fill(base, other, "k", ["balance", "n_orders"])


@query("enrichment_gain", """select 'balance' as column_name, count(*) filter (where c_acctbal >= 0) as n_before, count(*) filter (where c_acctbal >= 0 or o.k is not null) as n_after,
 count(*) filter (where c_acctbal < 0 and o.k is not null) as improvement from customer left join (select distinct o_custkey as k from orders) o on o.k = c_custkey
 union all select 'n_orders', 0, count(*), count(*) from (select distinct o_custkey from orders join customer on c_custkey = o_custkey)""")
def enrichment_gain(spark, sf):
    base = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    other = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_totalprice").alias("balance"), F.count(F.lit(1)).alias("n_orders"))
    return K.enrichment_gain(base, G.merge_fill(base, other, "k", ["balance", "n_orders"]), ["balance", "n_orders"])


@query("column_completeness", "select c as column_name, n as n_filled, t as n_rows, floor(n / t * 1000 + 0.5) / 10 as filled_pct from (select count(*) as t, " + ", ".join(
    f'count("{h}") as c{i}' for i, (h, *_) in enumerate(Q.CELLS)) + " from (" + with_(_TYPED[:3], "select * from export") + ")) x, lateral (select unnest([" + ", ".join(
    Q.q(h) for h, *_ in Q.CELLS) + "]) as c, unnest([" + ", ".join(f"c{i}" for i in range(len(Q.CELLS))) + "]) as n) y")
def column_completeness(spark, sf):
    names = [h for h, *_ in Q.CELLS]
    return K.completeness(supplier_export(spark, sf), names, blank_is_missing=True)


# --- formulas outside the cascade --------------------------------------------------------------
_YEAR = """yr as materialized (select o_custkey as entity, cast(year(o_orderdate) as integer) as fy, sum(cast(round(o_totalprice * 100) as bigint)) as c, sum(case when o_orderstatus = 'F' then cast(round(o_totalprice * 100) as bigint) else 0 end) as f,
 sum(case when o_orderstatus = 'P' then cast(round(o_totalprice * 100) as bigint) else 0 end) as p, count(*) as n from orders group by all)"""


@query("capital_returns", with_([_YEAR], f"""select entity, fy, case when c - p > 0 then f * 100.0 / (c - p) end as roce,
 {Q.r('case when c - p > 0 then f / 1e2 / ((c - p) / 1e2) * 100.0 end', 4)} as roce_rounded from yr"""))
def capital_returns(spark, sf):
    o = T.table(spark, sf, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy")).agg(
        F.sum(T.cents("o_totalprice")).alias("c"),
        F.sum(F.when(F.col("o_orderstatus") == "F", T.cents("o_totalprice")).otherwise(0)).alias("f"),
        F.sum(F.when(F.col("o_orderstatus") == "P", T.cents("o_totalprice")).otherwise(0)).alias("p"))
    money = {x: F.col(x) / 100.0 for x in "cfp"}
    return rows.select("entity", "fy", M.roce(F.col("f").cast("double"), F.col("c").cast("double"), F.col("p").cast("double")).alias("roce"),
                       rounded(M.roce(money["f"], money["c"], money["p"]), 4).alias("roce_rounded"))


@query("history_bands", with_([_YEAR, "cur as (select entity, max(fy) as fy0 from yr group by entity)", "ratio as (select entity, fy, c * 1.0 / n as v from yr)"],
 f"""select c.entity, case when a.v > 0 and count(h.v) >= 3 then {Q.r('median(h.v) / a.v * 100.0', 4)} end as hist_band, count(h.v) as n_history
 from cur c join ratio a on a.entity = c.entity and a.fy = fy0 left join ratio h on h.entity = c.entity and h.fy < fy0 group by c.entity, a.v"""))
def history_bands(spark, sf):
    """Latest average order against the median of the earlier years."""
    o = T.table(spark, sf, "orders")
    years = o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy")).agg(
        (F.sum(T.cents("o_totalprice")) / F.count(F.lit(1))).alias("v"))
    rows = years.groupBy("entity").agg(F.reverse(F.array_sort(F.collect_list(F.struct("fy", "v")))).alias("y"))
    history = F.transform(F.slice("y", F.lit(2), F.size("y")), lambda s: s["v"])
    return rows.select("entity", rounded(M.history_band(F.col("y")[0]["v"], history), 4).alias("hist_band"),
                       F.greatest(F.size("y") - 1, F.lit(0)).cast("long").alias("n_history"))


_LATEST = "latest as materialized (select *, row_number() over (partition by entity order by fy desc) as back from yr)"


@query("median_roce", with_([_YEAR, _LATEST, """pv as (select entity, max(case when back = 1 then f * 1.0 / c end) as a, max(case when back = 2 then f * 1.0 / c end) as b, max(case when back = 3 then f * 1.0 / c end) as d from latest group by entity)"""],
 """select entity, (select case when count(v) >= 2 then median(v) end from (select unnest([a, b, d]) as v) where v is not null) as roce_3y_median from pv"""))
def median_roce(spark, sf):
    """Median over the three latest years of each customer."""
    o = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy")).agg(
        F.sum(T.cents("o_totalprice")).alias("c"),
        F.sum(F.when(F.col("o_orderstatus") == "F", T.cents("o_totalprice")).otherwise(0)).alias("f"))
    years = o.groupBy("entity").agg(F.reverse(F.array_sort(F.collect_list(F.struct("fy", (F.col("f") / F.col("c")).alias("v"))))).alias("y"))
    return years.select("entity", M.roce_median(*[F.get("y", F.lit(i))["v"] for i in range(3)]).alias("roce_3y_median"))


_BEN = "-4.84 + 0.92e0 * a + 0.528e0 * b + 0.404e0 * d + 0.892e0 * a + 0.115e0 * b + -0.172e0 * d + 4.679e0 * (a - b) + -0.327e0 * d"


@query("beneish_scores", with_([_YEAR, _LATEST, """pv as (select entity, max(case when back = 1 then c end) * 1e0 / max(case when back = 2 then c end) as a, max(case when back = 1 then f end) * 1e0 / max(case when back = 2 then c end) as b,
 max(case when back = 1 then n end) * 1e0 / max(case when back = 2 then n end) as d from latest group by entity)"""],
 f"select entity, {Q.r(_BEN, 6)} as m_score, case when {_BEN} > -1.78 then 100e0 when {_BEN} > -2.22 then 50e0 when {_BEN} is not null then 0e0 end as raw_risk from pv"))
def beneish_scores(spark, sf):
    """The two latest years of each customer against each other."""
    o = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy")).agg(
        F.sum(T.cents("o_totalprice")).alias("c"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("o_orderstatus") == "F", T.cents("o_totalprice")).otherwise(0)).alias("f"))

    years = o.groupBy("entity").agg(F.reverse(F.array_sort(F.collect_list(F.struct("fy", "c", "f", "n")))).alias("y"))

    def at(column, back):
        return F.get("y", F.lit(back))[column]

    wide = years.select("entity", (at("c", 0) / at("c", 1)).alias("a"), (at("f", 0) / at("c", 1)).alias("b"), (at("n", 0) / at("n", 1)).alias("d"))
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    score = M.beneish_score(dsri=a, gmi=b, aqi=d, sgi=a, depi=b, sgai=d, lvgi=d, tata=a - b)
    return wide.select("entity", rounded(score, 6).alias("m_score"), M.beneish_risk(score).alias("raw_risk"))


@query("filing_deadlines", """select event_id as ingest_id, cast(cast(ts as date) - k + case when k % 3 = 0 then 60 when k % 3 = 1 then 45 else 21 end as date) as deadline
 from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)""")
def filing_deadlines(spark, sf):
    return T.facts(spark, sf).select("ingest_id", M.filing_deadline(F.col("period_end_date"), F.col("filing_type")).alias("deadline"))


@query("valuation_basics", f"""select p_partkey, case when p_size > 5 then {Q.r('p_retailprice / (p_size - 5.0)')} end as price_to_book,
 case when p_partkey % 40 > 0 then {Q.r('p_retailprice / (p_partkey % 40)')} end as eps_ttm,
 {Q.r(Q.clip('(p_retailprice - 950.0) / (1000.0 + p_size - 950.0) * 100.0', 0, 100), 1)} as drawdown_recovery from part""")
def valuation_basics(spark, sf):
    size = F.col("p_size").cast("double")
    basics = M.valuation_basics(F.col("p_retailprice"), size - 5.0, (F.col("p_partkey") % 40).cast("double"),
                                F.lit(1000.0) + size, F.lit(950.0))
    return T.table(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in basics.items()])


# --- payloads and pages ------------------------------------------------------------------------
@query("large_deals", """select cast('S' || l_suppkey as varchar) as symbol, case when l_linenumber % 2 = 0 then 'block' else 'bulk' end as deal_type, upper(case when l_returnflag = 'R' then 'sell' else 'buy' end) as buy_sell,
 cast(l_quantity * 1000 as double) as quantity, l_extendedprice as price from lineitem""")
def large_deals(spark, sf):
    """JSON deal payloads, one per order, parsed into deal rows."""
    return L.large_deals(_deal_payloads(spark, sf)).select("symbol", "deal_type", "buy_sell", "quantity", "price")


def _deal_payloads(spark, sf):
    li = T.table(spark, sf, "lineitem")
    item = F.struct(
        F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("symbol"), F.lit("client").alias("clientName"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("buySell"),
        F.format_number(F.col("l_quantity") * 1000, 0).alias("quantityTraded"),
        F.format_number("l_extendedprice", 2).alias("tradedPrice"), F.lit("2024-01-01").alias("dealDate"))
    block = F.col("l_linenumber") % 2 == 0
    return li.groupBy("l_orderkey").agg(
        F.collect_list(F.when(~block, item)).alias("BULK_DEALS_DATA"), F.collect_list(F.when(block, item)).alias("BLOCK_DEALS_DATA"),
    ).select(F.to_json(F.struct("BULK_DEALS_DATA", "BLOCK_DEALS_DATA")).alias("payload"))


@query("surveillance_rows", """select 'U' || user_id as symbol, cast(case when event_id % 6 = 5 then 1 else event_id % 4 end as integer) as stage from events""")
def surveillance_rows(spark, sf):
    """JSON stage lists under three different keys."""
    i = F.col("event_id")
    stage = F.when(i % 6 == 5, F.lit("n/a")).otherwise(F.concat(F.lit("Stage "), (i % 4).cast("string")))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    payload = (
        F.when(i % 3 == 0, F.to_json(F.struct(F.array(F.struct(user.alias("symbol"), stage.alias("stage"))).alias("data"))))
        .when(i % 3 == 1, F.to_json(F.struct(F.array(F.struct(user.alias("SYMBOL"), stage.alias("asmStage"))).alias("ASM"))))
        .otherwise(F.to_json(F.array(F.struct(user.alias("Symbol"), stage.alias("Stage"))))))
    return L.surveillance_rows(T.table(spark, sf, "events").select(payload.alias("payload")))


@query("html_list_values", r"""select page_id, cast(p - 1 as integer) as pos, trim(regexp_replace(regexp_replace(item, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as label,
 nullif(regexp_extract(item, '(?is)<a[^>]*href="([^"]*)"', 1), '') as link from (
 select page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) as item, generate_subscripts(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), 1) as p from pages)""")
def html_list_values(spark, sf):
    return L.list_values(T.table(spark, sf, "pages")).select("page_id", "pos", "label", "link")


def _pages_with_figures(spark, sf):
    """The pages, each with a list of ratios and a table of two years put behind it."""
    k = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<ul id="top-ratios"><li class="flex"><span class="name">Stock <b>P/E</b></span><span class="nowrap number">1,'), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit('.5</span></li>'),
        F.lit('<li><span class="name">Debt</span><span class="number">-</span></li></ul><TABLE><tr><th></th><th>2023</th></tr><tr class="strong"><td class="text">Sales&nbsp;+</td><td>1,'),
        F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit("</td><td> "), k, F.lit("%</td></tr><tr><td></td><td>9</td></tr>\n<tr><td>Page "), k, F.lit("</td></tr></table>"))
    return T.table(spark, sf, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), extra))


@query("html_numbers", "select page_id, 'Stock P/E' as label, 1000 + page_id % 1000 + 0.5e0 as value from pages")
def html_numbers(spark, sf):
    """Figures of the ratio lists; cells without a number have none."""
    return L.list_values(_pages_with_figures(spark, sf)).where("value is not null").select("page_id", "label", "value")


@query("html_table_rows", """select page_id, 'Sales' as label, '1' || lpad((page_id % 1000)::varchar, 3, '0') || '|' || page_id || '%' as cells from pages
 union all select page_id, 'Page ' || page_id, '' from pages""")
def html_table_rows(spark, sf):
    """Labelled table rows; rows without a label are left out."""
    return L.table_rows(_pages_with_figures(spark, sf)).select("page_id", "label", F.array_join("cells", "|").alias("cells"))
