"""Common table expressions of the check SQL (ANSI SQL as DuckDB runs it), written from the scoring rules."""

from __future__ import annotations

from ratewell import settings as S
from ratewell.sources.export import AGGREGATES, CELLS, EVENTS, cell_sql


def r(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def clip(x: str, low: float, high: float) -> str:
    return f"(case when ({x}) is null then null when ({x}) < {low} then cast({low} as double) when ({x}) > {high} then cast({high} as double) else ({x}) end)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bands(x: str, table: list, value: int = 2, top: bool = False, otherwise: str = "null") -> str:
    whens = " ".join(
        f"when {x} >= {b[0]} and ({x} < {b[1]}{f' or {x} = {b[1]}' if top and b[1] == 100 else ''}) then "
        + ("null" if b[value] is None else q(b[value]) if isinstance(b[value], str) else f"cast({b[value]} as double)")
        for b in table)
    return f"case {whens} else {otherwise} end"


def with_(ctes: list[str], select: str) -> str:
    seen = list(dict.fromkeys(ctes))
    return "with recursive " + ",\n".join(seen) + "\n" + select


GEO = "geo as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey)"
CUSTOMERS = """customers as (select c_custkey as ticker, c_name as name, r_name as sector, n_name as industry,
 n_name || '/' || c_mktsegment as basic_industry, c_acctbal as balance, c_mktsegment as segment
 from customer join geo on c_nationkey = n_nationkey)"""
SUPPLIERS = """suppliers as (select s_suppkey as suppkey, printf('SUPPLIER#%09d', s_suppkey) as ticker, s_name as name,
 case when s_suppkey % 5 in (3, 4) then 'Financial Services' else 'Commerce' end as macro_sector, r_name as sector,
 case s_suppkey % 5 when 3 then r_name || ' Banking' when 4 then r_name || ' Housing Finance' else n_name end as industry,
 n_name || '/' || cast(s_suppkey % 5 as varchar) as basic_industry,
 case s_suppkey % 5 when 3 then 'B' when 4 then 'C' else 'A' end as template
 from supplier join geo on s_nationkey = n_nationkey)"""

# --- bars ------------------------------------------------------------------------------------
BARS = """bars as materialized (select printf('SUPPLIER#%09d', l_suppkey) as ticker, d as date, first(p order by o, l, c % 8191) as open,
 max(p) as high, min(p) as low, last(p order by o, l, c % 8191) as close, sum(q) as volume, sum(c) * 5e0 as traded_value
 from (select l_suppkey, cast(l_shipdate as date) as d, l_extendedprice / l_quantity as p, l_orderkey as o, l_linenumber as l,
  l_extendedprice as e, l_quantity as q, cast(round(l_extendedprice * 100) as bigint) as c from lineitem) group by l_suppkey, d)"""
INDEX = "index_bars as materialized (select date, avg(close) as close from bars group by date)"
SEQ = """seq as materialized (select b.*, row_number() over w as i, count(*) over (partition by ticker) as n,
 lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl, lag(close, 20) over w as c20
 from bars b window w as (partition by ticker order by date))"""
# Wilder averages of gains and losses by the recursion itself
RSI = """rsi_seed as (select ticker, avg(greatest(close - pc, 0)) as g, avg(greatest(pc - close, 0)) as l, max(n) as n from seq
 where i between 2 and 15 group by ticker having max(n) >= 15),
rsi_run as (select ticker, 15 as i, n, g, l from rsi_seed union all
 select s.ticker, s.i, s.n, (r.g * 13 + greatest(s.close - s.pc, 0)) / 14, (r.l * 13 + greatest(s.pc - s.close, 0)) / 14
 from rsi_run r join seq s on s.ticker = r.ticker and s.i = r.i + 1),
rsi as (select ticker, case when l = 0 then 100.0 else 100.0 - 100.0 / (1.0 + g / l) end as rsi from rsi_run where i = n)"""


def _back(column: str, k: int) -> str:
    return f"max(case when n - i = {k} then {column} end)"


def _mean(column: str, k: int, guard: int | None = None) -> str:
    mean = f"avg(case when n - i < {k} then {column} end)"
    return mean if guard is None else f"case when max(n) >= {guard} then {mean} end"


TR = "case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end"
PRICE = f"""price_fold as materialized (select ticker, max(n) as n, {_back('close', 0)} as c, {_back('close', 252)} as c252,
 {_back('close', 126)} as c126, {_back('close', 1260)} as c1260,
 max(case when n - i < 252 then high end) as hi, min(case when n - i < 252 then low end) as lo,
 {_mean('close', 50, 50)} as s50, {_mean('close', 200, 200)} as s200, {_mean(TR, 20)} as a20, {_mean(TR, 60)} as a60,
 {_mean('volume', 20)} as v20, {_mean('volume', 60, 60)} as v60, {_mean('traded_value', 30, 30)} as t30 from seq group by ticker),
price as materialized (select f.ticker, {r('c')} as close_price, {r('(c / c252 - 1.0) * 100')} as return_1y,
 {r('(c / c126 - 1.0) * 100')} as return_6m, {r('(power(c / c1260, 0.2e0) - 1.0) * 100')} as cagr_5y,
 case when n >= 252 and hi <> lo then {r(clip('(c - lo) / (hi - lo) * 100.0', 0, 100))} end as drawdown_recovery,
 case when n >= 252 and hi <> lo then {r(clip('(c - lo) / (hi - lo) * 100.0', 0, 100))} end as drawdown_normalization,
 rsi as rsi_14, case when rsi is not null then {bands('rsi', S.RSI_SCORES, otherwise='5e0')} end as rsi_state,
 {r('(c - s200) / s200 * 100')} as price_vs_200dma, {r('(c - s50) / s50 * 100')} as price_vs_50dma,
 case when n >= 61 and a60 <> 0 then {r(clip('(1.0 - a20 / a60) * 100', 0, 100))} end as volatility_compression,
 case when v60 > 0 then {r('v20 / v60', 4)} end as volume, {r('t30 / 1e7')} as avg_daily_turnover_cr
 from price_fold f left join rsi using (ticker))"""

# --- export and derived metrics --------------------------------------------------------------
EXPORT = (
    "sums as materialized (select l_suppkey as k, " + ", ".join(f"{sql} as {name}" for name, sql in AGGREGATES.items())
    + " from lineitem group by l_suppkey),\n"
    + "export as materialized (select s.*, k, qty, rev, "
    + ", ".join(f'cast({cell_sql(sql, every)} as double) as "{header}"' for header, sql, every, _ in CELLS)
    + ", rev % 19 = 0 as t2t from sums join suppliers s on k = suppkey)")
_ROUND_TRIP = {
    "pe_percentile": "P/E", "pb_percentile": "Price to Book value", "fcf_yield": "FCF Yield",
    "hist_pb_band": "Historical PB Band", "rev_cagr_3y": "Sales growth 3Years", "eps_cagr_3y": "Profit growth 3Years",
    "rev_growth_yoy": "Sales growth", "eps_growth_yoy": "Profit growth", "peer_growth_rank": "Peer Growth Rank",
    "growth_stability": "Growth Stability", "deposit_growth": "Deposit Growth", "aum_growth": "AUM Growth",
    "roce_3y_median": "ROCE 3Years", "ebitda_margin": "OPM", "cfo_pat_ratio": "CFO/PAT", "margin_trend": "Margin Trend",
    "roa": "ROA", "fcf_consistency": "FCF Consistency", "roe": "ROE", "nim": "NIM", "cost_to_income": "Cost to Income",
    "credit_cost_discipline": "Credit Cost", "peer_price_strength": "Relative Strength",
    "volume_delivery": "Delivery Score", "rs_turn": "RS Turn",
}
INPUTS = {
    "pledge_pct": "Pledged percentage", "intrinsic_value": "Intrinsic Value", "book_value_per_share": "Book Value Per Share",
    "eps_ttm": "EPS TTM", "eps_fy0": "EPS FY0", "eps_fy1": "EPS FY1", "eps_fy2": "EPS FY2",
    "debt_to_equity": "Debt to equity", "interest_coverage": "Interest Coverage",
    "credit_rating_grade": "Credit Rating Grade", "gnpa_pct": "GNPA %", "nnpa_pct": "NNPA %", "car_pct": "CAR %",
    "pcr_pct": "PCR %", "alm_st_pct": "ALM ST %", "beneish_m_score": "Beneish M Score", "roe_ttm": "ROE",
    "current_ratio": "Current Ratio", "current_ratio_fy1": "Current Ratio Prev Year", "dividend_yield": "Dividend Yield",
    "promoter_holding_pct": "Promoter Holding %", "promoter_holding_prev": "Promoter Holding Prev %",
    "gross_block_fy0": "Gross Block", "gross_block_fy3": "Gross Block 3Y Ago", "asset_turnover": "Asset Turnover",
    "asset_turnover_fy1": "Asset Turnover Prev Year", "opm_fy1": "OPM FY1", "opm_fy2": "OPM FY2",
    "roa_fy1": "ROA Prev Year", "de_fy1": "D/E Prev Year", "cfo_annual": "Cash from Operations",
}
PRICE_NAMES = ("return_1y", "return_6m", "cagr_5y", "drawdown_recovery", "drawdown_normalization", "rsi_state",
               "price_vs_200dma", "price_vs_50dma", "volatility_compression", "volume")
# a blank (every third missing cell) falls through to the next header, other missing tokens do not
_PCR = """case when "Provision Coverage" is not null then "Provision Coverage" when k % 3 = 0 then "PCR %" end"""
_EVENT_POINTS = " + ".join(f"case when qty % {m} = 0 then {S.GOVERNANCE_EVENT_SCORES[e]} else 0.0 end" for e, m in EVENTS)
MODIFIED = ("typed as materialized (select ticker, name, macro_sector, sector, industry, basic_industry, template, t2t, qty, "
            + ", ".join(f'"{h}" as {m}' for m, h in (_ROUND_TRIP | INPUTS).items())
            + f', {_PCR} as provision_coverage, cast("ASM Stage" as integer) as asm_stage, cast("GSM Stage" as integer) as gsm_stage'
            + f", cast(least({_EVENT_POINTS}, 100.0) as double) as event_risk from export)")


def _flag(cond: str) -> str:
    return f"case when {cond} then 1 else 0 end"


_PIOTROSKI = [("roa", "0", ">"), ("cfo_annual", "0", ">"), ("roa", "roa_fy1", ">"), ("cfo_pat_ratio", "1", ">="),
              ("debt_to_equity", "de_fy1", "<"), ("current_ratio", "current_ratio_fy1", ">"),
              ("ebitda_margin", "opm_fy1", ">"), ("asset_turnover", "asset_turnover_fy1", ">")]
_HAVE = " + ".join(_flag(f"{a} is not null and {b} is not null") for a, b, _ in _PIOTROSKI)
_PASS = " + ".join(_flag(f"{a} {op} {b}") for a, b, op in _PIOTROSKI)
_EPS3 = "[eps_fy0, eps_fy1, eps_fy2]"


def universe(with_price: bool) -> list[str]:
    """CTEs of the rated metric table, with or without price metrics from bars."""
    price_cols = ", ".join(
        f"p.{m}" if with_price else f"cast(null as double) as {m}" for m in (*PRICE_NAMES, "close_price", "avg_daily_turnover_cr"))
    joined = f"inputs as (select t.*, {price_cols} from typed t {'left join price p using (ticker)' if with_price else ''})"
    steps = f"""steps as (select *,
 coalesce(case when template = 'A' then (select case when median(e) > 0 and count(e) >= 2 then case when eps_ttm > 0 and book_value_per_share > 0
   then least(median(e) / 0.12e0, 2.0 * sqrt(22.5 * eps_ttm * book_value_per_share)) else median(e) / 0.12e0 end end
   from (select unnest({_EPS3}) as e) where e is not null) end, intrinsic_value) as iv,
 case when template = 'A' then null else roe_ttm / 100.0 / case when template = 'C' then 0.14e0 else 0.13e0 end end as fpb,
 case when eps_fy1 is not null and eps_fy0 <> 0 then (eps_fy1 / eps_fy0 - 1.0) * 100.0
   when eps_fy0 is not null and eps_ttm <> 0 and not (eps_fy1 is not null and eps_fy0 <> 0) then (eps_fy0 / eps_ttm - 1.0) * 100.0 end as eps_step,
 least(case when debt_to_equity > 5 then 40.0 when debt_to_equity > 3 then 20.0 else 0.0 end
  + case when interest_coverage < 1 then 40.0 when interest_coverage < 1.5 then 20.0 else 0.0 end
  + case when coalesce(credit_rating_grade, case when debt_to_equity is not null or interest_coverage is not null then 9 end) >= 5 then 25.0 else 0.0 end
  + case when credit_rating_grade = 8 then 100.0 else 0.0 end, 100.0) as distress,
 greatest(case asm_stage when 0 then 0.0 when 1 then 30.0 when 2 then 50.0 when 3 then 70.0 else 90.0 end,
  case gsm_stage when 0 then 0.0 when 1 then 50.0 else 0.0 end) as watch,
 case when opm_fy2 is not null then (ebitda_margin - opm_fy2) / 2.0 else ebitda_margin - opm_fy1 end as trend0,
 {_HAVE} as have, {_PASS} as pass
 from inputs)"""
    trend = "case when rev_growth_yoy < 5 and trend0 > 0 then trend0 * 1.3 else trend0 end"
    growth = "(gross_block_fy0 / gross_block_fy3 - 1.0)"
    final = f"""universe as materialized (select ticker, name, macro_sector, sector, industry, basic_industry, template,
 {', '.join(m for m in _ROUND_TRIP)}, provision_coverage, {', '.join(PRICE_NAMES)}, close_price, avg_daily_turnover_cr,
 {', '.join(m for m in INPUTS if m not in ('roe_ttm',))}, asm_stage, gsm_stage, qty,
 {bands('pledge_pct', S.PLEDGE_RISK)} as promoter_pledge,
 case when iv <> 0 then (iv - close_price) / iv * 100.0 end as iv_gap,
 case when iv <> 0 then (iv - close_price) / iv * 100.0 end as discount_to_iv,
 {r('case when eps_step is not null and eps_growth_yoy is not null then (eps_step + eps_growth_yoy) / 2.0 else coalesce(eps_step, eps_growth_yoy) end')} as forward_view,
 case when roe_ttm > 0 then pb_percentile / roe_ttm end as roe_adj_pb,
 case when roe_ttm > 0 and fpb <> 0 then (fpb - pb_percentile) / fpb * 100.0 end as fair_value_gap,
 case when roe_ttm > 0 and fpb <> 0 then (fpb - pb_percentile) / fpb * 100.0 end as discount_to_fair_pb,
 distress as default_distress, watch as asm_gsm_risk,
 case when gnpa_pct is null and nnpa_pct is null then null else least(coalesce(gnpa_pct, 0.0) * 5.0 + coalesce(nnpa_pct, 0.0) * 10.0, 100.0) end as gnpa_nnpa_stress,
 least(case when car_pct is not null then greatest(14.0 - car_pct, 0.0) end * (100e0 / 14e0), 100.0) + car_pct * 0 as capital_adequacy_stress,
 least(greatest(75.0 - coalesce(pcr_pct, 50.0), 0.0) * (100e0 / 75e0), 100.0) as pcr_weakness,
 {clip('alm_st_pct', 0, 100)} as alm_mismatch,
 case when avg_daily_turnover_cr is null then 70.0 else least({bands('avg_daily_turnover_cr', S.LIQUIDITY_RISK, otherwise='100e0')}
   + case when t2t then 20.0 else 0.0 end, 100.0) end as liquidity_manipulation,
 event_risk as governance_event, event_risk as governance_promoter, greatest(watch, distress) as surveillance_default,
 case when beneish_m_score > -1.78 then 100.0 when beneish_m_score > -2.22 then 50.0 when beneish_m_score is not null then 0.0 end as accounting_quality,
 case when have >= 4 then {r('pass / have * 100.0')} end as piotroski_f_score,
 case when pe_percentile > 0 then {r(clip('50.0 + (100.0 / pe_percentile - 7.0) * 5.0', 0, 100))} end as earnings_yield,
 {r(clip('dividend_yield * 10.0', 0, 100))} as dividend_yield_score,
 {r(clip('50.0 + (promoter_holding_pct - promoter_holding_prev) * 10.0', 0, 100))} as promoter_buying,
 case when gross_block_fy3 > 0 and gross_block_fy0 is not null and asset_turnover is not null then case when {growth} <= 0 then 20.0
   else {r(clip(f'{growth} * (1.0 / greatest(asset_turnover, 0.1e0)) * 500.0', 0, 100))} end end as operating_leverage_score,
 case when opm_fy1 is not null then {r(clip(f'50.0 + ({trend}) * 3.0', 0, 100))} end as margin_expansion,
 cast(null as double) as earnings_growth
 from steps)"""
    head = [GEO, SUPPLIERS, EXPORT, MODIFIED]
    return head + ([BARS, SEQ, RSI, PRICE] if with_price else []) + [joined, steps, final]


DERIVED = ("promoter_pledge", "iv_gap", "discount_to_iv", "forward_view", "roe_adj_pb", "fair_value_gap",
           "discount_to_fair_pb", "default_distress", "asm_gsm_risk", "gnpa_nnpa_stress", "capital_adequacy_stress",
           "pcr_weakness", "alm_mismatch", "liquidity_manipulation", "governance_event", "surveillance_default",
           "accounting_quality", "piotroski_f_score", "earnings_yield", "dividend_yield_score", "promoter_buying",
           "operating_leverage_score", "margin_expansion")

# --- peers, cards, ratings --------------------------------------------------------------------
LEVELS = """levels as materialized (select u.*,
 case when nb >= 8 then 'Basic Industry' when ni >= 5 then 'Industry' else 'Sector' end as peer_level,
 case when nb >= 8 then basic_industry when ni >= 5 then industry else sector end as peer_value,
 case when nb >= 8 then nb when ni >= 5 then ni else ns end - 1 as n_peers
 from (select *, count(*) over (partition by basic_industry) as nb, count(*) over (partition by industry) as ni,
  count(*) over (partition by sector) as ns from {source}) u)"""


def peer_scores(source: str, long: str) -> list[str]:
    """Peer percentile by its definition: every entity against each of its peers, values winsorised over the group."""
    low = ", ".join(q(m) for m in S.LOWER_IS_BETTER)
    return [
        LEVELS.format(source=source),
        f"metrics as materialized ({long})",
        f"""peers as (select a.ticker, a.metric, a.value, b.ticker as other, b.value as other_value from
 (select l.*, m.metric, m.value from levels l join metrics m using (ticker)) a join
 (select l.*, m.metric, m.value from levels l join metrics m using (ticker)) b on a.metric = b.metric and a.peer_value =
  case a.peer_level when 'Basic Industry' then b.basic_industry when 'Industry' then b.industry else b.sector end)""",
        f"""peer_bounds as materialized (select ticker, metric, quantile_cont(other_value, {S.WINSOR_LOW}) as lo,
 quantile_cont(other_value, {S.WINSOR_HIGH}) as hi from peers group by ticker, metric)""",
        f"""scores as materialized (select ticker, metric, any_value(value) as value, case when count(*) = 1 then 50.0 else
 {r(f'''sum(case when ticker <> other and (case when metric in ({low})
   then least(greatest(other_value, lo), hi) >= least(greatest(value, lo), hi)
   else least(greatest(other_value, lo), hi) <= least(greatest(value, lo), hi) end) then 1 else 0 end) / (count(*) - 1) * 100.0''')} end as score
 from peers join peer_bounds using (ticker, metric) group by ticker, metric)""",
    ]


_WEIGHTS = ("weights(template, card, metric, pos, weight) as (values "
            + ", ".join(f"('{t}', '{c}', '{m}', {i}, {w}e0)" for t, c, m, i, w in S.weight_rows()) + ")")
METRICS_LONG = " union all ".join(
    f"select ticker, '{m}' as metric, cast({m} as double) as value from universe where {m} is not null"
    for m in S.configured_metrics())


def _title(x: str) -> str:
    """Upper-case the first letter of every word, digits counting as word breaks."""
    return ("list_aggregate(list_transform(regexp_extract_all(replace(%s, '_', ' '), '[a-z]+|[^a-z]+'), "
            "lambda w: upper(w[1]) || w[2:]), 'string_agg', '')" % x)


def card_ctes() -> list[str]:
    labels = "case card " + " ".join(f"when '{c}' then {bands('score', S.CARD_LABELS[c], top=True)}" for c in S.CARDS) + " end"
    d = S
    rules = [
        "case when gsm_stage >= 1 then printf('GSM Stage %d active', gsm_stage) end",
        "case when asm_stage >= 3 then printf('ASM Stage %d active', asm_stage) end",
        f"case when interest_coverage < 1 then printf('Interest Coverage %.2fx < 1.0', {r('interest_coverage', 2)}) end",
        "case when credit_rating_grade = 8 then 'Credit Rating in Default category (grade 8)' end",
        f"case when coalesce(pledge_pct, promoter_pledge) > {d.PLEDGE_DISQUALIFIER} then printf('Promoter Pledge %.1f%% > 60%%', {r('coalesce(pledge_pct, promoter_pledge)', 1)}) end",
        f"case when gnpa_pct > 15 then printf('GNPA %.1f%% > 15%%', {r('gnpa_pct', 1)}) end",
        f"case when nnpa_pct > 8 then printf('NNPA %.1f%% > 8%%', {r('nnpa_pct', 1)}) end",
        f"case when car_pct < 10 then printf('CAR %.1f%% < 10%%', {r('car_pct', 1)}) end",
        f"case when pcr_pct < 30 then printf('PCR %.1f%% < 30%%', {r('pcr_pct', 1)}) end",
        f"case when alm_st_pct > 50 then printf('ALM ST Borrowings %.1f%% > 50%%', {r('alm_st_pct', 1)}) end",
        f"case when avg_daily_turnover_cr < 0.25 then printf('Daily Turnover ₹%.2fCr < ₹0.25Cr', {r('avg_daily_turnover_cr', 2)}) end",
    ]
    return [
        _WEIGHTS,
        f"""disq as materialized (select ticker, array_to_string(list_filter([{', '.join(rules)}], lambda x: x is not null), '; ') as messages from universe)""",
        """card_items as materialized (select l.ticker, w.template, w.card, w.metric, w.pos, w.weight, s.score,
 case when s.score is not null then w.weight end as seen from levels l join weights w using (template)
 left join scores s on s.ticker = l.ticker and s.metric = w.metric)""",
        f"""card_sums as materialized (select ticker, template, card,
 list_reduce(list(weight order by pos), lambda a, b: a + b) as total,
 coalesce(list_reduce(list(weight order by pos) filter (where score is not null), lambda a, b: a + b), 0e0) as seen,
 list_reduce(list(score * weight order by pos) filter (where score is not null), lambda a, b: a + b) as weighted,
 arg_max(metric, struct_pack(p := score * weight, o := -pos)) filter (where score is not null) as top_metric,
 arg_max(score, struct_pack(p := score * weight, o := -pos)) filter (where score is not null) as top_score
 from card_items group by ticker, template, card)""",
        f"""card_scored as (select *, seen / total as cov, seen / total >= {S.CARD_COVERAGE_MIN} and seen > 0 as rankable,
 case when seen / total >= {S.CARD_COVERAGE_MIN} and seen > 0 then {r('weighted / seen')} end as score from card_sums)""",
        f"""cards as materialized (select c.ticker, c.template, c.card,
 case when card = 'red_flags' and messages <> '' then 15.0 else score end as score,
 case when card = 'red_flags' and messages <> '' then 'Severe' when score is null then 'Unrankable' else {labels} end as label,
 {r('cov', 3)} as coverage, rankable,
 case when card = 'red_flags' and messages <> '' then 'DISQUALIFIER triggered: ' || messages
  when not rankable then 'Insufficient data to score this card.'
  else 'Primary driver: ' || {_title('top_metric')} || printf(' scored %.1f/100 (', {r('top_score', 1)})
   || case when {r('top_score', 1)} >= 60 then 'strong' else 'weak' end || ' relative to peers).' end as reason
 from card_scored c join disq using (ticker))""",
    ]


def _wavg(parts: list[tuple[str, float]]) -> str:
    top = " + ".join(f"coalesce({c} * {w}e0, 0e0)" for c, w in parts)
    bottom = " + ".join(f"case when {c} is not null then {w}e0 else 0e0 end" for c, w in parts)
    return f"(({top}) / nullif({bottom}, 0e0))"


SIX = ("performance", "valuation", "growth", "profitability", "entry_point", "contrarian")


def mode_cte() -> str:
    return f"""mode as materialized (select *, case when r6 is null and dd is null then 'neutral'
 when coalesce(r6, 0) <= {S.BEAR_RETURN} or coalesce(dd, 50) <= {S.BEAR_RECOVERY} then 'bear'
 when coalesce(r6, 0) >= {S.BULL_RETURN} and coalesce(dd, 50) >= {S.BULL_RECOVERY} then 'bull' else 'neutral' end as market_mode
 from (select list_sort(list(return_6m) filter (where return_6m is not null))[cast(floor(count(return_6m) / 2) as bigint) + 1] as r6,
  list_sort(list(drawdown_recovery) filter (where drawdown_recovery is not null))[cast(floor(count(drawdown_recovery) / 2) as bigint) + 1] as dd from universe))"""


def rating_ctes() -> list[str]:
    pivots = ", ".join(
        f"max(case when card = '{c}' then {src} end) as {c}{suffix}"
        for c in S.CARDS for src, suffix in (("score", ""), ("label", "_label"), ("coverage", "_cov"),
                                             ("case when rankable then 1 else 0 end", "_ok")))
    def blend(weights: dict) -> str:
        return f"coalesce({r(_wavg([(f'case when {c}_ok = 1 then {c} end', weights[c]) for c in SIX]))}, 0e0)"

    red = "case when red_flags_ok = 1 then red_flags end"
    status = f"""case when n_ok < {S.MIN_RANKABLE_CARDS} then 'Insufficient Data' when {bands(red, S.RED_FLAG_CAPS, 3, True)} = 'Uninvestable' then 'Uninvestable'
 when {bands(red, S.RED_FLAG_CAPS, 3, True)} = 'Avoid' then 'Avoid' when opportunity_score >= 70 then 'Investable'
 when opportunity_score >= 50 then 'Watchlist' when opportunity_score >= 0 then 'Avoid' end"""
    return [
        mode_cte(),
        f"wide as materialized (select ticker, {pivots} from cards group by ticker)",
        f"""blended as (select l.*, w.* exclude (ticker), (select market_mode from mode) as market_mode,
 {' + '.join(f'{c}_ok' for c in S.CARDS)} as n_ok from levels l join wide w using (ticker))""",
        f"""raws as (select *, case when market_mode = 'bear' then {blend(S.BEAR_OPPORTUNITY_WEIGHTS)} else {blend(S.OPPORTUNITY_WEIGHTS)} end as raw_score
 from blended)""",
        f"""capped as (select *, case when n_ok >= {S.MIN_RANKABLE_CARDS} then least(raw_score, coalesce(cast({bands(red, [b for b in S.RED_FLAG_CAPS if b[2]], 2)} as double), raw_score)) end as opportunity_score
 from raws)""",
        f"""composed as materialized (select *, {status} as investability_status,
 {r(_wavg([(c, w) for c, w in S.POTENTIAL_WEIGHTS.items()]))} as potential_score,
 {r(_wavg([(c, w) for c, w in S.VALUATION_GAP_WEIGHTS.items()]))} as valuation_gap_score,
 case when entry_point is null then 'Unknown' when entry_point >= 75 then 'Accumulation Zone' when entry_point >= 55 then 'Constructive Pullback'
  when entry_point >= 40 then 'Neutral - Wait for Setup' else 'Wait / Expensive Entry' end as entry_signal from capped)""",
    ]


def overlay_ctes() -> list[str]:
    def cents(c: str) -> str:
        return f"cast(sum(cast(round({c} * 100) as bigint)) as double) / 100e0 / nullif(count({c}), 0)"

    bear = "market_mode = 'bear'"
    regime_score = r(f"coalesce({_wavg([(f'm_{c}', w) for c, w in S.SECTOR_REGIME_WEIGHTS.items()])}, 50e0)")
    conf = _wavg([("valuation_confidence_score", 0.35), ("potential_score", 0.35), ("red_flags", 0.30)])
    fifty = "case when coalesce({c}, 0) = 0 then 50e0 else {c} end"
    down = (f"(8.0 + (100.0 - ({fifty.format(c='red_flags')})) * 0.18e0 + greatest(55.0 - ({fifty.format(c='entry_point')}), 0.0) * 0.12e0"
            " - coalesce((drawdown_resilience_score - 50.0) * 0.08e0, 0.0))"
            f" * case market_mode when 'bear' then 1.18e0 when 'bull' then 0.92e0 else 1e0 end")
    reasons = [
        f"case when red_flags is null or red_flags < case when {bear} then 55 else 45 end then 'Red flags too high (score<' || case when {bear} then '55.0' else '45.0' end || ')' end",
        "case when confidence = 'Low' then 'Confidence below Medium' end",
        "case when avg_daily_turnover_cr < 1 then 'Low liquidity (<₹1.0 Cr/day)' end",
        f"case when promoter_pledge > case when {bear} then 25 else 35 end then 'High promoter pledge (>' || case when {bear} then '25.0' else '35.0' end || '%)' end",
        f"case when default_distress > case when {bear} then 45 else 60 end then 'Default/distress risk too high (>' || case when {bear} then '45.0' else '60.0' end || ')' end",
    ]
    return [
        f"regime_means as (select sector, {', '.join(f'{cents(c)} as m_{c}' for c in S.SECTOR_REGIME_WEIGHTS)} from composed group by sector)",
        f"""regime as materialized (select sector, {regime_score} as sector_regime_score,
 case when {regime_score} >= 70 then 'Tailwind' when {regime_score} >= 55 then 'Constructive' when {regime_score} >= 40 then 'Mixed' else 'Headwind' end as sector_regime_label from regime_means)""",
        f"""over1 as (select c.*, g.sector_regime_score, g.sector_regime_label,
 {r(_wavg([('dr.score', 0.45), ("case when c.template = 'A' then cf.score end", 0.25), ('c.red_flags', 0.30)]))} as drawdown_resilience_score,
 {r("least(100.0, valuation_cov * 100.0 + (case when iv_gap is not null or fair_value_gap is not null then 8.0 else 0.0 end + case when hist_pb_band is not null then 7.0 else 0.0 end))")} as valuation_confidence_score
 from composed c join regime g using (sector) left join scores dr on dr.ticker = c.ticker and dr.metric = 'drawdown_recovery'
 left join scores cf on cf.ticker = c.ticker and cf.metric = 'cfo_pat_ratio')""",
        f"over2 as (select *, case when {conf} >= 85 then 'High' when {conf} >= 65 then 'Medium' else 'Low' end as confidence from over1)",
        f"""over3 as (select *, case when coalesce(iv_gap, fair_value_gap) is not null then greatest(coalesce(iv_gap, fair_value_gap), 0.0)
  when valuation_gap_score is not null then greatest((valuation_gap_score - 50.0) * 0.9e0, 0.0) end
  * case confidence when 'Low' then 0.8e0 when 'Medium' then 0.9e0 else 1e0 end
  * case market_mode when 'bear' then 0.88e0 when 'bull' then 1.05e0 else 1e0 end
  * (0.85e0 + sector_regime_score / 100.0 * 0.3e0) as up, {clip(down, 5.0, 35.0)} as down,
 list_filter([{', '.join(reasons)}], lambda x: x is not null) as reasons from over2)""",
        f"""over4 as (select *, {r('up')} as expected_upside_pct, {r('down')} as expected_downside_pct, {r('up / down')} as risk_reward_ratio,
 {r(clip('up / down * 35.0', 0, 100))} as risk_reward_score, len(reasons) = 0 as gate_passed, array_to_string(reasons, '; ') as gate_fail_reasons from over3)""",
        f"""rated as materialized (select *,
 case when potential_score >= 72 + case when {bear} then 4 else 0 end and valuation_gap_score >= 66 + case when {bear} then 4 else 0 end and gate_passed
   and investability_status = 'Investable' then 'Buy Candidate'
  when potential_score >= 56 + case when {bear} then 2 else 0 end and valuation_gap_score >= 46 + case when {bear} then 2 else 0 end
   and coalesce(investability_status, '') not in ('Uninvestable', 'Avoid') then 'Watchlist' else 'Avoid' end as recommendation,
 {r(f"(coalesce(opportunity_score, 0.0) * 0.4e0 + coalesce(potential_score, 0.0) * 0.3e0 * case when {bear} then 1.1e0 else 1e0 end + coalesce(risk_reward_score, 0.0) * 0.3e0) * ({fifty.format(c='red_flags')}) / 100.0 / case when {bear} then 1.15e0 else 1e0 end")} as selection_score,
 case when opportunity_score is not null then row_number() over (partition by sector, opportunity_score is null order by opportunity_score desc, ticker) end as sector_rank,
 case when opportunity_score is not null then count(opportunity_score) over (partition by sector) end as sector_n,
 case when opportunity_score is not null then row_number() over (partition by basic_industry, opportunity_score is null order by opportunity_score desc, ticker) end as basic_industry_rank,
 case when opportunity_score is not null then count(opportunity_score) over (partition by basic_industry) end as basic_n
 from over4)""",
    ]


def percentile_of(rank: str, n: str) -> str:
    return f"case when {n} <= 1 then 100.0 else {r(f'(1.0 - ({rank} - 1) / ({n} - 1)) * 100.0')} end"


def scored_universe() -> list[str]:
    return universe(True) + peer_scores("universe", METRICS_LONG)


def carded() -> list[str]:
    return scored_universe() + card_ctes()


def composed() -> list[str]:
    return carded() + rating_ctes()


def rated() -> list[str]:
    return composed() + overlay_ctes()


BOARD = "board as materialized (select * from rated where coalesce(investability_status, '') not in ('Uninvestable', 'Insufficient Data', 'Unsupported Data'))"
