"""Queries over peer scores, cards, ratings and the reports made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.catalog import sql as Q
from ratewell.catalog.base import query, stored
from ratewell.catalog.sql import with_
from ratewell.functions.bands import (
    card_label, confidence_label, confidence_rank, entry_signal, investability, liquidity_risk, pledge_risk,
    red_flag_cap, red_flag_status, regime_label, rsi_score, survivorship_severity, thesis_label)
from ratewell.operators import overlays as O
from ratewell.operators import quality as K
from ratewell.operators import reports as R
from ratewell.operators.bars import price_metrics
from ratewell.operators.cards import cards_long, coverage_by_template
from ratewell.operators.ordered import is_large
from ratewell.operators.peers import first_peers, peer_percentile, with_peer_level
from ratewell.plans.rating import flat, leaderboard, metrics_long, rate_universe
from ratewell.plans.universe import load_universe
from ratewell.sources import tables as T
from ratewell.sources.export import supplier_export


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return T.named(price_metrics(T.keyed_bars(spark, sf)))


def loaded(spark: SparkSession, sf: str) -> DataFrame:
    return load_universe(supplier_export(spark, sf), price=prices(spark, sf))


def universe(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "universe", lambda: loaded(spark, sf))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "ratings", lambda: rate_universe(universe(spark, sf)))


def board(spark: SparkSession, sf: str) -> DataFrame:
    return leaderboard(ratings(spark, sf))


# --- peers -----------------------------------------------------------------------------------
def _balance_scores(spark: SparkSession, sf: str, lower: tuple[str, ...] = ()) -> DataFrame:
    c = T.customers(spark, sf)
    entities = c.select("ticker", "basic_industry", "industry", "sector")
    large = is_large(entities)
    metrics = c.select("ticker", F.lit("balance").alias("metric"), F.col("balance").alias("value"))
    return peer_percentile(with_peer_level(entities, large=large), metrics, lower, large=large)


_BALANCE = [Q.GEO, Q.CUSTOMERS] + Q.peer_scores("customers", "select ticker, 'balance' as metric, balance as value from customers")


@query("peer_percentile_acctbal", with_(
    _BALANCE, "select ticker, peer_level, peer_value, value as balance, score from scores join levels using (ticker)"))
def peer_percentile_acctbal(spark, sf):
    return _balance_scores(spark, sf).select("ticker", "peer_level", "peer_value", F.col("value").alias("balance"), "score")


@query("peer_percentile_lower_better", with_(
    [s.replace("metric in ('pe_percentile'", "metric in ('balance', 'pe_percentile'") for s in _BALANCE],
    "select ticker, score from scores"))
def peer_percentile_lower_better(spark, sf):
    return _balance_scores(spark, sf, ("balance",)).select("ticker", "score")


@query("peer_levels", with_(
    _BALANCE[:3], "select ticker, peer_level, peer_value, cast(n_peers as bigint) as n_peers from levels"))
def peer_levels(spark, sf):
    entities = T.customers(spark, sf).select("ticker", "basic_industry", "industry", "sector")
    return with_peer_level(entities).drop("peer_groups", "basic_industry", "industry", "sector")


@query("first_peers", with_(_BALANCE[:3], """select ticker, array_to_string(first10, ';') as peers from (
 select a.ticker, coalesce(list(b.ticker order by b.ticker) filter (where b.ticker is not null), [])[1:10] as first10
 from levels a left join levels b on a.ticker <> b.ticker and a.peer_value = case a.peer_level when 'Basic Industry' then b.basic_industry
  when 'Industry' then b.industry else b.sector end group by a.ticker)"""))
def first_peers_query(spark, sf):
    entities = T.customers(spark, sf).select("ticker", "basic_industry", "industry", "sector")
    return first_peers(with_peer_level(entities)).select("ticker", F.array_join("peers", ";").alias("peers"))


@query("peer_growth_rank", with_(
    [Q.GEO, Q.CUSTOMERS, """rev as (select o_custkey as ticker, year(o_orderdate) as fy, sum(cast(round(o_totalprice * 100) as bigint)) as c from orders group by all),
 latest as (select *, row_number() over (partition by ticker order by fy desc) as b from rev),
 growth as (select a.ticker, a.c / p.c - 1.0 as g from latest a join latest p on a.ticker = p.ticker and a.b = 1 and p.b = 2)"""]
    + Q.peer_scores("customers", "select ticker, 'rev_growth' as metric, g as value from growth"),
    "select ticker, score as peer_growth_rank from scores"))
def peer_growth_rank(spark, sf):
    entities = T.customers(spark, sf).select("ticker", "basic_industry", "industry", "sector")
    years = T.customer_years(spark, sf).select("entity", "fy", F.round(F.col("revenue") * 100).cast("long").alias("c"))
    last_two = years.groupBy(F.col("entity").alias("ticker")).agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("fy")).alias("k"), "c"))), 1, 2).alias("y"))
    growth = last_two.where(F.size("y") == 2).select(
        "ticker", F.lit("rev_growth").alias("metric"), (F.col("y")[0]["c"] / F.col("y")[1]["c"] - 1.0).alias("value"))
    return peer_percentile(with_peer_level(entities), growth).select("ticker", F.col("score").alias("peer_growth_rank"))


# --- bands -----------------------------------------------------------------------------------
@query("band_labels", with_([Q.GEO, Q.CUSTOMERS], f"""select ticker, s,
 {', '.join(f"{Q.bands('s', S.CARD_LABELS[c], top=True)} as {c}_label" for c in S.CARDS)},
 {Q.bands('s', S.RED_FLAG_CAPS, 3, True, "'Avoid'")} as rf_status, {Q.bands('s', S.RED_FLAG_CAPS, 2)} as rf_cap,
 case when s >= 70 then 'Investable' when s >= 50 then 'Watchlist' when s >= 0 then 'Avoid' end as investability,
 case when s >= 75 then 'Accumulation Zone' when s >= 55 then 'Constructive Pullback' when s >= 40 then 'Neutral - Wait for Setup' else 'Wait / Expensive Entry' end as entry_signal,
 {Q.bands('s', S.RSI_SCORES, otherwise='5e0')} as rsi_score, {Q.bands('s', S.PLEDGE_RISK, otherwise='100e0')} as pledge_risk,
 least({Q.bands('s / 2e0', S.LIQUIDITY_RISK, otherwise='100e0')} + case when ticker % 5 = 0 then 20.0 else 0.0 end, 100.0) as liquidity_risk,
 case when s >= 70 then 'Tailwind' when s >= 55 then 'Constructive' when s >= 40 then 'Mixed' else 'Headwind' end as regime,
 case when s >= 85 then 'High' when s >= 65 then 'Medium' else 'Low' end as confidence,
 cast(case when s >= 85 then 2 when s >= 65 then 1 else 0 end as integer) as confidence_rank,
 case when s > 15 then 'Severe' when s > 8 then 'High' when s > 3 then 'Moderate' else 'Low' end as severity,
 {', '.join(f"{Q.bands('s', t, otherwise=chr(39) + 'unranked' + chr(39))} as thesis_{n}" for n, t in (('score', S.THESIS_SCORE), ('valuation', S.THESIS_VALUATION), ('entry', S.THESIS_ENTRY), ('growth', S.THESIS_GROWTH), ('risk', S.THESIS_RISK)))}
 from (select ticker, floor((balance + 1000e0) / 11e0) / 10e0 as s from customers)"""))
def band_labels(spark, sf):
    rows = T.customers(spark, sf).select("ticker", (F.floor((F.col("balance") + 1000.0) / 11.0) / 10.0).alias("s"))
    s = F.col("s")
    return rows.select(
        "ticker", "s", *[card_label(c, s).alias(f"{c}_label") for c in S.CARDS],
        red_flag_status(s).alias("rf_status"), red_flag_cap(s).alias("rf_cap"), investability(s).alias("investability"),
        entry_signal(s).alias("entry_signal"), rsi_score(s).alias("rsi_score"), pledge_risk(s).alias("pledge_risk"),
        liquidity_risk(s / 2.0, F.col("ticker") % 5 == 0).alias("liquidity_risk"), regime_label(s).alias("regime"),
        confidence_label(s).alias("confidence"), confidence_rank(confidence_label(s)).alias("confidence_rank"),
        survivorship_severity(s).alias("severity"), thesis_label(s, S.THESIS_SCORE).alias("thesis_score"),
        thesis_label(s, S.THESIS_VALUATION).alias("thesis_valuation"), thesis_label(s, S.THESIS_ENTRY).alias("thesis_entry"),
        thesis_label(s, S.THESIS_GROWTH).alias("thesis_growth"), thesis_label(s, S.THESIS_RISK).alias("thesis_risk"))


# --- cards and composites ---------------------------------------------------------------------
@query("metric_scores", with_(Q.scored_universe(), "select ticker, metric, score from scores"))
def metric_scores(spark, sf):
    u = universe(spark, sf)
    large = is_large(u)
    return peer_percentile(with_peer_level(u.select("ticker", "basic_industry", "industry", "sector"), large=large),
                           metrics_long(u), large=large).select("ticker", "metric", "score")


@query("card_scores", with_(Q.carded(), "select ticker, template, card, score, label, coverage, rankable, reason from cards"))
def card_scores(spark, sf):
    return cards_long(ratings(spark, sf))


@query("disqualifier_rules", with_(Q.carded(), "select ticker, messages from disq where messages <> ''"))
def disqualifier_rules(spark, sf):
    return ratings(spark, sf).where(F.size("disqualifiers") > 0).select(
        "ticker", F.array_join("disqualifiers", "; ").alias("messages"))


_SEVEN = (*Q.SIX, "red_flags")
_RANKED = ", ".join(
    f"case when {c}_ok = 1 and {c} is not null then struct_pack(k := -{c}, i := {i}, t := '{c.replace('_', ' ').title()}: ' || {c}_label) end"
    for i, c in enumerate(_SEVEN))


@query("opportunity_scores", with_(Q.composed(), f"""select ticker, cast(n_ok as integer) as n_rankable_cards, opportunity_score, investability_status,
 potential_score, valuation_gap_score, entry_signal,
 case when n_ok >= 4 then array_to_string(list_transform(rk[1:3], lambda x: x.t), '; ') else '' end as strengths,
 case when n_ok >= 4 then array_to_string(list_transform(rk[greatest(len(rk) - 2, 1):], lambda x: x.t), '; ') else '' end as weaknesses
 from (select *, list_sort(list_filter([{_RANKED}], lambda x: x is not null)) as rk from composed)"""))
def opportunity_scores(spark, sf):
    return ratings(spark, sf).select(
        "ticker", "n_rankable_cards", "opportunity_score", "investability_status", "potential_score", "valuation_gap_score",
        "entry_signal", F.array_join("strengths", "; ").alias("strengths"), F.array_join("weaknesses", "; ").alias("weaknesses"))


@query("base_confidence", with_(Q.composed(), """select ticker, c as base_confidence, case when investability_status in ('Uninvestable', 'Avoid', 'Insufficient Data') or red_flags < 40 then 'Avoid'
  when potential_score >= 72 and valuation_gap_score >= 66 then 'Buy Candidate' else 'Watchlist' end as base_recommendation from (
 select *, case when n_ok = 0 then 'Low' when v >= 85 then 'High' when v >= 65 then 'Medium' else 'Low' end as c from (
 select *, (""" + " + ".join(f"case when {c}_ok = 1 then {c}_cov else 0e0 end" for c in S.CARDS) + """) / nullif(n_ok, 0) * 100 + n_ok * 4
  + case peer_level when 'Basic Industry' then 10 when 'Industry' then 5 else 0 end as v from composed))"""))
def base_confidence(spark, sf):
    return ratings(spark, sf).select("ticker", "base_confidence", "base_recommendation")


@query("market_mode", with_(Q.universe(True) + [Q.mode_cte()], "select r6 as median_return_6m, dd as median_recovery, market_mode from mode"))
def market_mode(spark, sf):
    return O.market_mode(universe(spark, sf))


@query("sector_regime", with_(Q.rated()[:-4], "select sector, sector_regime_score, sector_regime_label from regime"))
def sector_regime(spark, sf):
    return O.sector_regime(ratings(spark, sf)).drop("n_sector")


@query("overlay_scores", with_(Q.rated(), """select ticker, drawdown_resilience_score, valuation_confidence_score, confidence, expected_upside_pct,
 expected_downside_pct, risk_reward_ratio, risk_reward_score, gate_passed, gate_fail_reasons, recommendation, selection_score from rated"""))
def overlay_scores(spark, sf):
    return ratings(spark, sf).select(
        "ticker", "drawdown_resilience_score", "valuation_confidence_score", "confidence", "expected_upside_pct",
        "expected_downside_pct", "risk_reward_ratio", "risk_reward_score", "gate_passed",
        F.array_join("gate_fail_reasons", "; ").alias("gate_fail_reasons"), "recommendation", "selection_score")


_PLAN = """case entry_signal when 'Accumulation Zone' then 'add on confirmation break above 20D high' when 'Constructive Pullback' then 'add near support retest with volume' else 'wait; add only after base breakout' end"""
_PLAN3 = """case entry_signal when 'Accumulation Zone' then 'add after weekly close above 50DMA' when 'Constructive Pullback' then 'add on RS turn positive for 2 weeks' else 'final add after trend confirmation' end"""


@query("action_notes", with_(Q.rated(), f"""select ticker, 'Stage1 40% now; Stage2 35% (' || {_PLAN} || '); Stage3 25% (' || {_PLAN3} || '); ' as plan_head,
 sector_regime_label || ' sector regime; ' as note_head, case when gate_passed then 'Gate passed' else 'Gate failed: ' || array_to_string(reasons, ', ') end as note_tail from rated"""))
def action_notes(spark, sf):
    return ratings(spark, sf).select(
        "ticker", F.regexp_extract("staged_entry_plan", r"^(.*; )expected_upside", 1).alias("plan_head"),
        F.regexp_extract("action_note", r"^(.*; )RR=", 1).alias("note_head"),
        F.regexp_extract("action_note", r"; (Gate .*)$", 1).alias("note_tail"))


@query("sector_ranks", with_(Q.rated(), f"""select ticker, sector_rank, case when sector_rank is not null then {Q.percentile_of('sector_rank', 'sector_n')} end as sector_percentile,
 basic_industry_rank, case when basic_industry_rank is not null then {Q.percentile_of('basic_industry_rank', 'basic_n')} end as basic_industry_percentile from rated"""))
def sector_ranks(spark, sf):
    return ratings(spark, sf).select(
        "ticker", "sector_rank", "sector_percentile", "basic_industry_rank", "basic_industry_percentile")


_BOARD_COLUMNS = ("ticker", "name", "sector", "basic_industry", "template", "peer_level", *_SEVEN, "opportunity_score",
                  "investability_status", "potential_score", "valuation_gap_score", "recommendation", "confidence",
                  "entry_signal", "market_mode", "sector_regime_score", "selection_score", "gate_passed", "gate_fail_reasons")
_ORDER = "order by coalesce(selection_score, 0) desc, coalesce(opportunity_score, 0) desc, ticker"


@query("leaderboard", with_(Q.rated() + [Q.BOARD], f"select {', '.join(_BOARD_COLUMNS)} from board {_ORDER}"))
def leaderboard_query(spark, sf):
    return board(spark, sf).select(*_BOARD_COLUMNS)


@query("rate_universe", with_(Q.rated(), "select ticker, template, peer_level, opportunity_score, investability_status, recommendation, selection_score from rated"))
def rate_universe_query(spark, sf):
    """The whole rating run, nothing taken from stored run tables."""
    return rate_universe(loaded(spark, sf)).select(
        "ticker", "template", "peer_level", "opportunity_score", "investability_status", "recommendation", "selection_score")


@query("portfolio_watchlist", with_(Q.rated() + [Q.BOARD, """best as (select * from (select *, row_number() over (partition by sector order by selection_score desc, ticker) as pos
 from board where recommendation = 'Watchlist' and confidence in ('Medium', 'High')) where pos <= 5 order by selection_score desc, ticker limit 18)"""],
 f"select ticker, sector, selection_score, {Q.r('least(100.0 / (select count(*) from best), 8.0)')} as suggested_weight_pct from best"))
def portfolio_watchlist(spark, sf):
    """The portfolio rule over the watchlist, which is never empty on the test tables."""
    watch = board(spark, sf).where(F.col("recommendation") == "Watchlist").withColumn("recommendation", F.lit("Buy Candidate"))
    return O.portfolio_plan(watch).select("ticker", "sector", "selection_score", "suggested_weight_pct")


# --- reports ---------------------------------------------------------------------------------
_MEAN0 = "cast(sum(cast(round(coalesce(opportunity_score, 0) * 100) as bigint)) as double) / 100 / count(*)"


@query("sector_summary", with_(Q.rated() + [Q.BOARD], f"""select sector, count(*) as n_stocks, count(*) filter (where recommendation = 'Buy Candidate') as n_buy_candidates,
 {Q.r(_MEAN0)} as avg_opportunity_score from board group by sector order by sector"""))
def sector_summary(spark, sf):
    return R.sector_summary(board(spark, sf))


@query("sector_stats", with_(Q.rated(), f"""select sector, count(ticker) as n, {Q.r('cast(sum(cast(round(opportunity_score * 100) as bigint)) as double) / 100 / count(opportunity_score)', 4)} as avg_score,
 max(opportunity_score) as top_score, count(*) filter (where recommendation = 'Buy Candidate') as buy_count, count(*) filter (where gate_passed) as n_gate_passed from rated group by sector"""))
def sector_stats(spark, sf):
    return R.sector_stats(ratings(spark, sf))


@query("sector_top10", with_(Q.rated() + [Q.BOARD], """select sector, cast(p as integer) as sector_top_rank, ticker, opportunity_score from (
 select *, row_number() over (partition by sector order by coalesce(opportunity_score, 0) desc, ticker) as p from board) where p <= 10"""))
def sector_top10(spark, sf):
    return O.sector_top(board(spark, sf)).select("sector", "sector_top_rank", "ticker", "opportunity_score")


@query("undervalued_top200", with_(Q.rated() + [Q.BOARD], """select ticker, valuation_gap_score, potential_score, opportunity_score from board
 where potential_score is not null and valuation_gap_score is not null order by valuation_gap_score desc, potential_score desc, coalesce(opportunity_score, 0) desc, ticker limit 200"""))
def undervalued_top200(spark, sf):
    return R.undervalued(board(spark, sf)).select("ticker", "valuation_gap_score", "potential_score", "opportunity_score")


@query("red_flag_exclusions", with_(Q.rated() + [Q.BOARD], "select ticker, red_flags, investability_status from board where red_flags < 40 or investability_status = 'Avoid'"))
def red_flag_exclusions(spark, sf):
    return R.red_flag_exclusions(board(spark, sf)).select("ticker", "red_flags", "investability_status")


@query("value_hunter", with_(Q.rated(), f"""select ticker, {Q.r('coalesce(contrarian, 0) * 0.5e0 + coalesce(valuation, 0) * 0.25e0 + coalesce(profitability, 0) * 0.25e0', 1)} as vh_score, recommendation
 from rated where coalesce(red_flags, 0) >= 45 and coalesce(profitability, 0) >= 40 and coalesce(contrarian, 0) >= 30 order by vh_score desc, ticker limit 30"""))
def value_hunter(spark, sf):
    return R.value_hunter(flat(ratings(spark, sf))).select("ticker", "vh_score", "recommendation")


@query("screened_top100", with_(Q.rated(), """select ticker, opportunity_score, valuation, recommendation from rated
 where coalesce(opportunity_score, 0) >= 40 and recommendation in ('Buy Candidate', 'Watchlist', 'Avoid') order by valuation desc nulls last, ticker limit 100"""))
def screened_top100(spark, sf):
    rows = R.screen(flat(ratings(spark, sf)), 40, recommendations=["Buy Candidate", "Watchlist", "Avoid"])
    return R.sorted_view(rows, "valuation").select("ticker", "opportunity_score", "valuation", "recommendation")


@query("gate_passed_screen", with_(Q.rated(), "select ticker, selection_score from rated where gate_passed"))
def gate_passed_screen(spark, sf):
    return R.screen(ratings(spark, sf), gate_only=True).select("ticker", "selection_score")


@query("ticker_filter", with_(Q.rated(), "select ticker, opportunity_score from rated where ticker in ('SUPPLIER#000000003', 'SUPPLIER#000000007', 'SUPPLIER#000000042')"))
def ticker_filter(spark, sf):
    return R.by_tickers(ratings(spark, sf), "supplier#000000003, SUPPLIER#000000007,supplier#000000042, ").select(
        "ticker", "opportunity_score")


@query("score_histogram", with_(Q.rated(), """select cast(least(floor(opportunity_score / 5), 19) as integer) as bin, cast(least(floor(opportunity_score / 5), 19) * 5 as double) as bin_start, count(*) as n
 from rated where opportunity_score is not null group by all"""))
def score_histogram(spark, sf):
    return R.histogram(ratings(spark, sf), "opportunity_score")


@query("recommendation_counts", with_(Q.rated(), "select recommendation, count(*) as n from rated group by 1"))
def recommendation_counts(spark, sf):
    return R.value_counts(ratings(spark, sf), "recommendation")


@query("sector_counts_top15", with_(Q.rated(), "select sector, count(*) as n from rated group by 1 order by n desc, sector limit 15"))
def sector_counts_top15(spark, sf):
    return R.value_counts(ratings(spark, sf), "sector", 15)


@query("action_sheet", with_(Q.rated(), """select ticker, template, investability_status, recommendation, confidence, sector_regime_label as sector_regime, selection_score,
 risk_reward_ratio, gate_fail_reasons from rated order by coalesce(selection_score, 0) desc, ticker"""))
def action_sheet(spark, sf):
    return R.action_sheet(ratings(spark, sf)).select(
        "ticker", "template", "investability_status", "recommendation", "confidence", "sector_regime", "selection_score",
        "risk_reward_ratio", "gate_fail_reasons")


@query("top_n_cards", with_(Q.rated() + [Q.BOARD], f"""select c.ticker, c.card, c.score from cards c where c.ticker in (select ticker from board {_ORDER} limit 20)"""))
def top_n_cards(spark, sf):
    return R.top_n_only(cards_long(ratings(spark, sf)), board(spark, sf), 20).select("ticker", "card", "score")


@query("card_coverage", with_(Q.carded(), f"select card, {Q.r('count(*) filter (where rankable) / count(*) * 100.0', 1)} as rankable_pct, count(*) as total from cards group by card"))
def card_coverage(spark, sf):
    return R.card_coverage(cards_long(ratings(spark, sf)))


_FLAT = ("ticker", "name", "sector", "industry", "score", "selection", "recommendation", "entry_signal", *S.CARDS,
         "upside_pct", "risk_reward", "market_mode", "gate_passed")


@query("rating_json_rows", with_(Q.rated(), f"""select ticker, name, sector, basic_industry as industry, opportunity_score as score, selection_score as selection, recommendation, entry_signal,
 {', '.join(S.CARDS)}, expected_upside_pct as upside_pct, risk_reward_ratio as risk_reward, market_mode, gate_passed from rated"""))
def rating_json_rows(spark, sf):
    """Ratings written as nested JSON documents and read back by path."""
    return R.document_rows(R.document_json(R.documents(ratings(spark, sf)))).select(*_FLAT)


@query("rating_documents", with_(Q.rated(), """select ticker, cast(length(ticker) as integer) as n_ticker_chars, 'Template ' || template || ' (' || case template when 'A' then 'General' when 'B' then 'Bank' else 'NBFC/HFC' end || ')' as template_used,
 cast(n_peers as bigint) as n_peers, sector_rank from rated"""))
def rating_documents(spark, sf):
    entities = with_peer_level(ratings(spark, sf).select("ticker", "basic_industry", "industry", "sector"))
    docs = R.documents(ratings(spark, sf), first_peers(entities))
    return docs.select(
        "ticker", F.length("document.ticker").alias("n_ticker_chars"), F.col("document.template_used").alias("template_used"),
        F.col("document.peer_group.n_peers").alias("n_peers"), F.col("document.ranks.sector_rank").alias("sector_rank"))


def _name_sql(metric: str) -> str:
    return "case " + metric + " " + " ".join(f"when '{k}' then {Q.q(v)}" for k, v in S.METRIC_NAMES.items()) + f" else replace({metric}, '_', ' ') end"


_THESIS = [f"""named as materialized (select ticker, card, {_name_sql('metric')} || ' (' || printf('%.0f', score) || ')' as txt,
 row_number() over (partition by ticker, card order by score desc, pos) as best, row_number() over (partition by ticker, card order by score, pos) as worst, score
 from card_items where score is not null)""",
 """drivers as (select ticker, card, array_to_string(list(txt order by best) filter (where best <= 2), ' and ') as drv,
 array_to_string(list(txt order by worst) filter (where worst <= 2 and score < 50), ', ') as risks from named group by ticker, card)""",
 f"""strongest as (select c.ticker, c.card, c.score, row_number() over (partition by c.ticker order by c.score desc, case c.card {' '.join(f"when '{c}' then {i}" for i, c in enumerate(R.THESIS_CARDS))} end) as p
 from cards c where c.card in ('performance', 'valuation', 'growth', 'profitability', 'entry_point') and c.score is not null)"""]


def _lab(x: str, table: list) -> str:
    return Q.bands(x, table, otherwise="'unranked'")


@query("thesis_text", with_(Q.rated() + _THESIS, f"""select t.ticker, concat_ws(' ',
 case when opportunity_score is not null then name || ' (' || t.ticker || ') scores ' || printf('%.1f', {Q.r('opportunity_score', 1)}) || '/100 overall — an ' || {_lab('opportunity_score', S.THESIS_SCORE)} || ' opportunity in the ' || basic_industry || ' space.' end,
 case when s.card is not null then 'Its strongest suit is ' || case s.card when 'performance' then 'price performance' when 'growth' then 'growth trajectory' when 'entry_point' then 'entry timing' else s.card end
  || ' (' || printf('%.0f', s.score) || '/100), driven by ' || d.drv || '.' end,
 case when valuation is not null then 'Valuation looks ' || {_lab('valuation', S.THESIS_VALUATION)} || ' (' || printf('%.0f', valuation) || '/100).' end,
 case when growth is not null then 'Growth profile: ' || {_lab('growth', S.THESIS_GROWTH)} || ' (' || printf('%.0f', growth) || '/100).' end,
 case when red_flags is not null then 'Risk assessment: ' || {_lab('red_flags', S.THESIS_RISK)} || ' (' || printf('%.0f', red_flags) || '/100)'
  || case when coalesce(k.risks, '') <> '' then ' — watch ' || k.risks else '' end || '.' end,
 case when entry_point is not null then 'Entry timing: ' || {_lab('entry_point', S.THESIS_ENTRY)} || ' (' || printf('%.0f', entry_point) || '/100).' end) as thesis_head,
 array_to_string(list_filter([{', '.join(f"case when {c} >= 65 then '{c.replace('_', ' ').title()}: ' || printf('%.0f', {c}) || '/100' end" for c in R.THESIS_CARDS)}], lambda x: x is not null), '; ') as strengths,
 array_to_string(list_filter([{', '.join(f"case when {c} < 35 then '{c.replace('_', ' ').title()}: ' || printf('%.0f', {c}) || '/100' end" for c in R.THESIS_CARDS)}], lambda x: x is not null), '; ') as weaknesses
 from rated t left join strongest s on s.ticker = t.ticker and s.p = 1 left join drivers d on d.ticker = t.ticker and d.card = s.card
 left join drivers k on k.ticker = t.ticker and k.card = 'red_flags'"""))
def thesis_text(spark, sf):
    rows = R.with_thesis(ratings(spark, sf))
    return rows.select(
        "ticker", F.trim(F.regexp_replace("thesis", r"( ?Expected upside of .*| ?Note: market.*)$", "")).alias("thesis_head"),
        F.array_join("thesis_strengths", "; ").alias("strengths"), F.array_join("thesis_weaknesses", "; ").alias("weaknesses"))


# --- quality ---------------------------------------------------------------------------------
_COVERAGE = Q.carded() + [f"""coverage as materialized (select w.template, w.card, {Q.r('cast(sum(cast(round(c.coverage * 1000) as bigint)) as double) / 1000 / count(c.ticker)', 3)} as avg_coverage,
 {Q.r('count(*) filter (where c.coverage >= 0.65) / count(c.ticker) * 100.0')} as rankable_pct, count(c.ticker) as n_stocks, count(*) filter (where c.coverage >= 0.65) as n_rankable
 from (select distinct template, card from weights) w left join (select ticker, template, card, {Q.r('cov', 3)} as coverage from card_scored) c using (template, card) group by w.template, w.card)"""]


@query("coverage_by_template_card", with_(_COVERAGE, "select template, card, coalesce(avg_coverage, 0e0) as avg_coverage, coalesce(rankable_pct, 0e0) as rankable_pct, n_stocks, n_rankable from coverage"))
def coverage_by_template_card(spark, sf):
    return coverage_by_template(universe(spark, sf))


_CORE = ("valuation", "growth", "profitability", "entry_point", "performance")
_CORE_SQL = ", ".join(f"coalesce({Q.r(f'''sum(n_rankable) filter (where card = '{c}') / nullif(sum(n_stocks) filter (where card = '{c}'), 0) * 100.0''')}, 0e0) as {c}" for c in (*_CORE, "red_flags"))
_AVG = Q.r("(" + " + ".join(_CORE) + ") / 5.0")
_N_CORE = " + ".join(f"case when {c} > 0 then 1 else 0 end" for c in _CORE)


@query("input_quality", with_(_COVERAGE, f"""select (select count(*) from universe) as n_symbols_loaded, {_AVG} as avg_core_rankable_pct, cast({_N_CORE} as integer) as n_core_cards_with_rankable,
 100e0 as classification_coverage_pct, concat_ws(' ', case when (select count(*) from universe) < 250 then 'Universe too small (' || (select count(*) from universe) || ' < 250).' end,
 case when {_AVG} < 8 then 'Core coverage too low.' end) as blockers from (select {_CORE_SQL} from coverage)"""))
def input_quality(spark, sf):
    return K.input_quality(universe(spark, sf)).select(
        "n_symbols_loaded", "avg_core_rankable_pct", "n_core_cards_with_rankable", "classification_coverage_pct",
        F.array_join("blockers", " ").alias("blockers"))


_TQ = [f"""tq as materialized (select *, {_AVG} as core, cast({_N_CORE} as integer) as n_core from (select template, max(n_stocks) as n_stocks, {_CORE_SQL} from coverage group by template))""",
       f"""tqb as materialized (select *, array_to_string(list_filter([case when core < 55 then 'avg core rankable% too low (' || printf('%.2f', core) || '% < 55.0%)' end,
 case when n_core < 5 then printf('too few core cards rankable (%d < 5)', n_core) end,
 {', '.join(f"case when {c} < 25 then '{c} rankable% too low (' || printf('%.2f', {c}) || '% < 25.0%)' end" for c in (*_CORE, 'red_flags'))}], lambda x: x is not null), '; ') as blockers from tq)"""]


@query("template_quality", with_(_COVERAGE + _TQ, "select template, n_stocks > 0 as active, n_stocks > 0 and blockers = '' as supported, n_stocks, core as avg_core_rankable_pct, n_core as n_core_cards_with_rankable, red_flags as red_flags_rankable_pct, blockers from tqb"))
def template_quality(spark, sf):
    return K.template_quality(universe(spark, sf)).withColumn("blockers", F.array_join("blockers", "; "))


@query("template_support_override", with_(Q.rated() + _COVERAGE[-1:] + _TQ, """select r.ticker, case when blockers = '' then recommendation else 'Unsupported' end as recommendation,
 case when blockers = '' then investability_status else 'Unsupported Data' end as investability_status, blockers = '' as template_supported,
 gate_passed and blockers = '' as gate_passed from rated r join tqb using (template)"""))
def template_support_override(spark, sf):
    return K.apply_template_support(ratings(spark, sf), K.template_quality(universe(spark, sf))).select(
        "ticker", "recommendation", "investability_status", "template_supported", "gate_passed")


@query("unknown_metrics", """select event_type as metric, count(*) as n_rows from events group by 1""")
def unknown_metrics(spark, sf):
    """Metric names of the fact feed that no card weighs."""
    weights = spark.createDataFrame(S.weight_rows(), "template string, card string, metric string, pos int, weight double")
    long = T.facts(spark, sf).select("metric").unionByName(
        metrics_long(universe(spark, sf)).select("metric"))
    return K.unknown_metrics(long, weights)


@query("long_to_wide_metrics", with_(Q.universe(True), "select ticker, pe_percentile, roe, cast(default_distress as double) as default_distress from universe where pe_percentile is not null or roe is not null or default_distress is not null"))
def long_to_wide_metrics(spark, sf):
    """Metric rows pivoted back to columns."""
    return metrics_long(universe(spark, sf)).groupBy("ticker").pivot(
        "metric", ["pe_percentile", "roe", "default_distress"]).agg(F.max("value"))
