"""Ratings in bull and neutral markets over the tables' own universe with some strong names and one thin template.

The universe of the test tables rates as a bear market without buy candidates or unsupported templates.  Here every
third entity is moved to the good end of all its metrics, and lenders lose their growth metrics, so every branch of
overlays, gates, calls, texts and support rules has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.catalog import rating as RT
from ratewell.catalog import sql as Q
from ratewell.catalog.base import ORACLES, query, stored
from ratewell.catalog.history import _recs
from ratewell.catalog.metrics import bars_once
from ratewell.catalog.sql import with_
from ratewell.operators import asof as P
from ratewell.operators import backtest as B
from ratewell.operators import overlays as O
from ratewell.operators import quality as K
from ratewell.operators import reports as R
from ratewell.operators.ordered import exact_quantiles
from ratewell.operators.peers import peer_percentile, with_peer_level
from ratewell.plans.rating import leaderboard, rate_universe, supported_leaderboard
from ratewell.sources import tables as T

SHIFT = 1000
#: Rows of a block in the queries that cut the groups of the test tables as a large run would.
BLOCK = 97
_THIN = tuple(S.CARD_WEIGHTS["C"]["growth"])


def universe(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        rows = RT.universe(spark, sf)
        strong = F.substring("ticker", 10, 20).cast("long") % 3 == 0
        moved = {}
        for m in S.configured_metrics():
            value = F.col(m).cast("double")
            value = value + F.when(strong, -float(SHIFT) if m in S.LOWER_IS_BETTER else float(SHIFT)).otherwise(0.0)
            moved[m] = F.when(F.col("template") != "C", value) if m in _THIN else value
        return rows.withColumns(moved)

    return stored(spark, sf, "scenario_universe", build)


def ratings(spark: SparkSession, sf: str, mode: str = "bull") -> DataFrame:
    return stored(spark, sf, f"scenario_{mode}", lambda: rate_universe(universe(spark, sf), mode))


def board(spark: SparkSession, sf: str) -> DataFrame:
    return leaderboard(ratings(spark, sf))


def _moved(m: str) -> str:
    value = f"cast({m} as double) + case when cast(substr(ticker, 10) as bigint) % 3 = 0 then {'-' if m in S.LOWER_IS_BETTER else ''}{SHIFT}e0 else 0e0 end"
    return f"case when template <> 'C' then {value} end as {m}" if m in _THIN else f"{value} as {m}"


def universe_sql() -> list[str]:
    *before, last = Q.universe(True)
    names = ", ".join(map(_moved, S.configured_metrics()))
    return [*before, last.replace("universe as materialized", "universe0 as materialized", 1),
            f"universe as materialized (select * replace ({names}) from universe0)"]


def carded() -> list[str]:
    return universe_sql() + Q.peer_scores("universe", Q.METRICS_LONG) + Q.card_ctes()


def rated(mode: str = "bull") -> list[str]:
    ctes = carded() + Q.rating_ctes() + Q.overlay_ctes()
    return [f"mode as (select '{mode}' as market_mode)" if c == Q.mode_cte() else c for c in ctes]


_SUPPORT = RT._COVERAGE[-1:] + RT._TQ
_OVERLAYS = ("ticker", "opportunity_score", "investability_status", "potential_score", "valuation_gap_score", "confidence", "expected_upside_pct",
             "expected_downside_pct", "risk_reward_ratio", "risk_reward_score", "gate_passed", "gate_fail_reasons", "recommendation", "selection_score")


def _overlay_rows(spark, sf, mode):
    return ratings(spark, sf, mode).withColumn("gate_fail_reasons", F.array_join("gate_fail_reasons", "; ")).select(*_OVERLAYS)


@query("rated_bull_market", with_(rated(), f"select {', '.join(_OVERLAYS)} from rated"))
def rated_bull_market(spark, sf):
    return _overlay_rows(spark, sf, "bull")


@query("rated_neutral_market", with_(rated("neutral"), f"select {', '.join(_OVERLAYS)} from rated"))
def rated_neutral_market(spark, sf):
    return _overlay_rows(spark, sf, "neutral")


@query("rated_strong_bear_market", with_(rated("bear"), f"select {', '.join(_OVERLAYS)} from rated"))
def rated_strong_bear_market(spark, sf):
    """The strong names under the stricter gates and weights of a bear market."""
    return _overlay_rows(spark, sf, "bear")


# --- calls and lists -------------------------------------------------------------------------
@query("buy_candidates", with_(rated() + [Q.BOARD], "select ticker, selection_score from board where recommendation = 'Buy Candidate' and investability_status = 'Investable'"))
def buy_candidates(spark, sf):
    return R.buy_candidates(board(spark, sf)).select("ticker", "selection_score")


@query("top_picks", with_(rated(), "select ticker, selection_score from rated where gate_passed and recommendation = 'Buy Candidate' order by selection_score desc, ticker limit 10"))
def top_picks(spark, sf):
    return R.top_picks(ratings(spark, sf)).select("ticker", "selection_score")


@query("portfolio_plan", with_(rated() + [Q.BOARD, """best as (select * from (select *, row_number() over (partition by sector order by selection_score desc, ticker) as pos
 from board where recommendation in ('Buy Candidate') and confidence in ('Medium', 'High')) where pos <= 5 order by selection_score desc, ticker limit 18)"""],
 f"select ticker, sector, selection_score, {Q.r('least(100.0 / (select count(*) from best), 8.0)')} as suggested_weight_pct from best"))
def portfolio_plan(spark, sf):
    return O.portfolio_plan(board(spark, sf)).select("ticker", "sector", "selection_score", "suggested_weight_pct")


@query("unsupported_list", with_(rated() + _SUPPORT, "select r.ticker, r.template, blockers as support_reason from rated r join tqb using (template) where blockers <> '' order by 2, 1"))
def unsupported_list(spark, sf):
    """Entities of templates whose cards cover too little."""
    rows = K.apply_template_support(ratings(spark, sf), K.template_quality(universe(spark, sf)))
    return K.unsupported(rows).select("ticker", "template", "support_reason")


_OVERRIDE = """supported as (select r.* exclude (recommendation, investability_status, gate_passed, gate_fail_reasons), blockers = '' as template_supported, blockers as template_support_reason,
 case when blockers = '' then recommendation else 'Unsupported' end as recommendation, case when blockers = '' then investability_status else 'Unsupported Data' end as investability_status,
 gate_passed and blockers = '' as gate_passed, case when blockers = '' then gate_fail_reasons else concat_ws('; ', nullif(gate_fail_reasons, ''), blockers) end as gate_fail_reasons from rated r join tqb using (template))"""


@query("unsupported_override", with_(rated() + _SUPPORT + [_OVERRIDE], "select ticker, recommendation, investability_status, template_supported, template_support_reason, gate_passed, gate_fail_reasons from supported"))
def unsupported_override(spark, sf):
    """Calls withdrawn where the template is not supported, with the reasons among the gate's."""
    rows = K.apply_template_support(ratings(spark, sf), K.template_quality(universe(spark, sf)))
    return rows.select("ticker", "recommendation", "investability_status", "template_supported", F.array_join("template_support_reasons", "; ").alias("template_support_reason"),
                       "gate_passed", F.array_join("gate_fail_reasons", "; ").alias("gate_fail_reasons"))


_BOARD_COLUMNS = ("ticker", "template", "opportunity_score", "investability_status", "recommendation", "confidence", "selection_score", "gate_passed", "template_supported")


@query("supported_leaderboard", with_(rated() + _SUPPORT + [_OVERRIDE], f"""select {', '.join(_BOARD_COLUMNS)} from supported
 where coalesce(investability_status, '') not in ('Uninvestable', 'Insufficient Data', 'Unsupported Data') order by coalesce(selection_score, 0) desc, coalesce(opportunity_score, 0) desc, ticker"""))
def supported_board(spark, sf):
    """The leaderboard of a run: without the names whose template is not supported."""
    return supported_leaderboard(ratings(spark, sf), universe(spark, sf)).select(*_BOARD_COLUMNS)


@query("red_flag_exclusions_supported", with_(rated() + _SUPPORT + [_OVERRIDE], "select ticker, red_flags, investability_status from supported where red_flags < 40 or investability_status in ('Uninvestable', 'Avoid', 'Unsupported Data')"))
def red_flag_exclusions_supported(spark, sf):
    rows = K.apply_template_support(ratings(spark, sf), K.template_quality(universe(spark, sf)))
    return R.red_flag_exclusions(rows.withColumn("red_flags", F.col("card_red_flags.score"))).select("ticker", "red_flags", "investability_status")


@query("input_quality_thin", with_(carded() + RT._COVERAGE[-1:], f"""select (select count(*) from universe) as n_symbols_loaded, {RT._AVG} as avg_core_rankable_pct, cast({RT._N_CORE} as integer) as n_core_cards_with_rankable,
 {Q.r("(select count(*) filter (where sector <> 'ASIA') / count(*) * 100.0 from universe)")} as classified_pct from (select {RT._CORE_SQL} from coverage where template = 'C')"""))
def input_quality_thin(spark, sf):
    """Input quality of lenders alone: a core card that nobody can be ranked on."""
    rows = universe(spark, sf)
    found = K.input_quality(rows.where("template = 'C'"))
    labelled = rows.agg(F.floor(F.count_if(F.col("sector") != "ASIA") / F.count(F.lit(1)) * 100.0 * 1e2 + 0.5).cast("double") / 1e2).scalar()
    return found.select(rows.agg(F.count(F.lit(1))).scalar().alias("n_symbols_loaded"), "avg_core_rankable_pct", "n_core_cards_with_rankable", labelled.alias("classified_pct"))


# --- whole texts -----------------------------------------------------------------------------
def _tenth(x: str) -> str:
    """One decimal, the shown decimals rounded half up."""
    return f"printf('%.1f', cast(round(cast({x} as decimal(18, 2)), 1) as double))"


_STOP = Q.clip("(case when coalesce(expected_downside_pct, 0) = 0 then 5e0 else expected_downside_pct end) * 0.8e0", 8, 18)


@query("action_texts", with_(rated(), f"""select ticker, 'Stage1 40% now; Stage2 35% (' || {RT._PLAN} || '); Stage3 25% (' || {RT._PLAN3} || '); expected_upside=' || {_tenth('coalesce(expected_upside_pct, 0)')} || '%, expected_downside='
 || {_tenth('case when coalesce(expected_downside_pct, 0) = 0 then 5e0 else expected_downside_pct end')} || '%, stop=' || printf('%.1f', {_STOP}) || '%' as staged_entry_plan,
 sector_regime_label || ' sector regime; RR=' || printf('%.2f', coalesce(risk_reward_ratio, 0)) || '; ' || case when gate_passed then 'Gate passed' else 'Gate failed: ' || array_to_string(reasons, ', ') end as action_note from rated"""))
def action_texts(spark, sf):
    """Entry plans and notes, every character."""
    return ratings(spark, sf).select("ticker", "staged_entry_plan", "action_note")


_TOPS = "tops as (select ticker, array_to_string(list(regexp_replace(txt, ' \\([0-9]+\\)$', '') order by score desc, case card " + " ".join(
    f"when '{c}' then {i}" for i, c in enumerate(R.THESIS_CARDS)) + f" end), '; ') as tops from named where best = 1 and score >= 70 and card in {R.THESIS_CARDS} group by ticker)"


@query("thesis_texts", with_(rated() + RT._THESIS + [_TOPS], f"""select t.ticker, concat_ws(' ',
 case when opportunity_score is not null then name || ' (' || t.ticker || ') scores ' || {_tenth('opportunity_score')} || '/100 overall — an ' || {RT._lab('opportunity_score', S.THESIS_SCORE)} || ' opportunity in the ' || basic_industry || ' space.' end,
 case when s.card is not null then 'Its strongest suit is ' || case s.card when 'performance' then 'price performance' when 'growth' then 'growth trajectory' when 'entry_point' then 'entry timing' else s.card end
  || ' (' || printf('%.0f', s.score) || '/100), driven by ' || d.drv || '.' end,
 case when valuation is not null then 'Valuation looks ' || {RT._lab('valuation', S.THESIS_VALUATION)} || ' (' || printf('%.0f', valuation) || '/100).' end,
 case when growth is not null then 'Growth profile: ' || {RT._lab('growth', S.THESIS_GROWTH)} || ' (' || printf('%.0f', growth) || '/100).' end,
 case when red_flags is not null then 'Risk assessment: ' || {RT._lab('red_flags', S.THESIS_RISK)} || ' (' || printf('%.0f', red_flags) || '/100)' || case when coalesce(k.risks, '') <> '' then ' — watch ' || k.risks else '' end || '.' end,
 case when entry_point is not null then 'Entry timing: ' || {RT._lab('entry_point', S.THESIS_ENTRY)} || ' (' || printf('%.0f', entry_point) || '/100).' end,
 case when expected_upside_pct is not null and risk_reward_ratio is not null then 'Expected upside of ' || {_tenth('expected_upside_pct')} || '% with a ' || case when risk_reward_ratio > 1.5 then 'favorable' when risk_reward_ratio > 1 then 'acceptable' else 'unfavorable' end
  || ' risk-reward ratio of ' || printf('%.2f', risk_reward_ratio) || '.' end, 'Note: market is currently in bull mode.') as thesis, coalesce(tops, '') as top_metrics
 from rated t left join strongest s on s.ticker = t.ticker and s.p = 1 left join drivers d on d.ticker = t.ticker and d.card = s.card
 left join drivers k on k.ticker = t.ticker and k.card = 'red_flags' left join tops on tops.ticker = t.ticker"""))
def thesis_texts(spark, sf):
    """Investment theses, every sentence, and the best metrics named in them."""
    return R.with_thesis(ratings(spark, sf)).select("ticker", "thesis", F.array_join("thesis_top_metrics", "; ").alias("top_metrics"))


_CARD_FIELDS = ", ".join(f"{c} as {c}_score, {c}_label, {_tenth(Q.r(f'{c}_cov * 100.0', 1))} || '%' as {c}_coverage, {c}_ok = 1 as {c}_rankable" for c in S.CARDS)


@query("document_fields", with_(rated(), f"""select ticker, name as stock_name, concat_ws('/', macro_sector, sector, industry, basic_industry) as classification, {_CARD_FIELDS}, opportunity_score as final_opportunity_score,
 recommendation, confidence as recommendation_confidence, market_mode, selection_score, gate_passed, gate_fail_reasons from rated"""))
def document_fields(spark, sf):
    """Nested rating documents, field by field."""
    docs = R.documents(ratings(spark, sf))
    cards = [F.col(f"document.cards.{c}.{field}").alias(f"{c}_{name}") for c in S.CARDS
             for field, name in (("score", "score"), ("label", "label"), ("data_coverage", "coverage"), ("is_rankable", "rankable"))]
    kept = ("final_opportunity_score", "recommendation", "recommendation_confidence", "market_mode", "selection_score")
    return docs.select("ticker", "document.stock_name", F.concat_ws("/", *[f"document.classification.{c}" for c in ("macro_sector", "sector", "industry", "basic_industry")]).alias("classification"),
                       *cards, *[f"document.{c}" for c in kept], F.col("document.investability_gate_passed").alias("gate_passed"), F.array_join("document.gate_fail_reasons", "; ").alias("gate_fail_reasons"))


# --- groups that are cut into blocks -----------------------------------------------------------
@query("peer_percentile_in_blocks", ORACLES["peer_percentile_acctbal"])
def peer_percentile_in_blocks(spark, sf):
    """Peer scores where regions, nations and the whole value list are cut into key ranges."""
    c = T.customers(spark, sf)
    entities = with_peer_level(c.select("ticker", "basic_industry", "industry", "sector"), large=True, block_rows=BLOCK)
    metrics = c.select("ticker", F.lit("balance").alias("metric"), F.col("balance").alias("value"))
    return peer_percentile(entities, metrics, (), large=True, block_rows=BLOCK).select("ticker", "peer_level", "peer_value", F.col("value").alias("balance"), "score")


@query("backtest_stats_in_blocks", ORACLES["backtest_stats"])
def backtest_stats_in_blocks(spark, sf):
    bars = bars_once(spark, sf)
    returns = B.returns_long(B.forward_returns(_recs(spark, sf, bars), bars))
    return B.backtest_stats(returns, large=True, block_rows=BLOCK)


@query("pit_as_of_in_blocks", ORACLES["pit_as_of"])
def pit_as_of_in_blocks(spark, sf):
    """The latest view value before every purchase, with the time lines of users cut into blocks."""
    facts = T.facts(spark, sf)
    requests = facts.where(F.col("metric") == "purchase").select("ticker", F.col("ingest_id").alias("request_id"), F.col("filing_date").alias("as_of"))
    views = facts.where(F.col("metric") == "view").withColumnRenamed("ingest_id", "fid")
    return P.as_of_join(requests, views, ["ticker"], "as_of", "filing_date", ["value", "fid"], ["period_end_date", "fid"], large=True, block_rows=BLOCK)


@query("quantiles_in_blocks", "select l_returnflag as flag, count(*) as n, quantile_cont(l_extendedprice, 0.03) as p3, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.97) as p97 from lineitem group by l_returnflag")
def quantiles_in_blocks(spark, sf):
    """Exact quantiles of three groups that hold all rows, each cut into many ranges."""
    rows = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    return exact_quantiles(rows, ["flag"], "v", {"p3": 0.03, "p50": 0.5, "p97": 0.97}, large=True, block_rows=997)


@query("ranks_in_blocks", with_(rated(), f"""select ticker, sector_rank, case when sector_rank is not null then {Q.percentile_of('sector_rank', 'sector_n')} end as sector_percentile,
 basic_industry_rank, case when basic_industry_rank is not null then {Q.percentile_of('basic_industry_rank', 'basic_n')} end as basic_industry_percentile from rated"""))
def ranks_in_blocks(spark, sf):
    """A rating run in which every group above ten entities is cut."""
    rows = stored(spark, sf, "scenario_blocks", lambda: rate_universe(universe(spark, sf), "bull", block_rows=10))
    return rows.select("ticker", "sector_rank", "sector_percentile", "basic_industry_rank", "basic_industry_percentile")
