"""Metric formulas as column expressions. Every input may be null; each formula states its own missing rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.bands import confidence_rank
from ratewell.functions.numeric import clamp, mean_of, median_of, missing_as, ratio, rounded
from ratewell.functions.text import mapped


def _null() -> Column:
    return F.lit(None).cast("double")


# --- prices ----------------------------------------------------------------------------------
def price_return(close: Column, earlier: Column) -> Column:
    return ratio(close, earlier) - 1.0


def cagr(latest: Column, base: Column, years: int) -> Column:
    """Compound growth; null unless both ends are positive."""
    return F.when((latest > 0) & (base > 0), F.pow(latest / base, F.lit(1.0 / years)) - 1.0)


def drawdown_recovery(close: Column, high: Column, low: Column) -> Column:
    return clamp(ratio((close - low), (high - low)) * 100.0, 0, 100)


def distance_from(close: Column, average: Column) -> Column:
    return ratio(close - average, average) * 100.0


def volume_delivery_score(avg_20: Column, avg_60: Column) -> Column:
    return clamp(ratio(avg_20, avg_60) * 50.0, 0, 100)


# --- valuation -------------------------------------------------------------------------------
def intrinsic_value(eps_fy0, eps_fy1, eps_fy2, eps_ttm, bvps) -> Column:
    """Median of two or three yearly EPS over the required return, capped by twice the Graham number."""
    normal = median_of([eps_fy0, eps_fy1, eps_fy2], at_least=2)
    epv = normal / F.lit(S.WACC_GENERAL)
    graham = F.sqrt(F.lit(S.GRAHAM_FACTOR) * eps_ttm * bvps) * F.lit(S.GRAHAM_CAP)
    value = F.when((eps_ttm > 0) & (bvps > 0), F.least(epv, graham)).otherwise(epv)
    return F.when((normal > 0) & (value > 0), value)


def gap_pct(value: Column, price: Column) -> Column:
    """How far price lies below value, in percent of value (IV gap, fair-P/B gap)."""
    return ratio(value - price, value) * 100.0


def fair_pb(roe_pct: Column, cost_of_equity: Column) -> Column:
    return F.when(roe_pct > 0, roe_pct / 100.0 / cost_of_equity)


def history_band(current: Column, history: Column) -> Column:
    """Median of at least three positive past ratios over the current ratio (history is an array)."""
    kept = F.array_sort(F.filter(history, lambda v: v.isNotNull() & (v > 0)))
    n = F.size(kept)
    low = F.try_element_at(kept, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(kept, (F.floor(n / 2) + 1).cast("int"))
    return F.when((current > 0) & (n >= 3), (low + high) / 2.0 / current * 100.0)


def earnings_yield(pe: Column, bond_yield: float = 7.0) -> Column:
    return F.when(pe > 0, rounded(clamp(50.0 + (100.0 / pe - bond_yield) * 5.0, 0, 100)))


def dividend_yield_score(yield_pct: Column, history_median: Column | None = None) -> Column:
    plain = clamp(yield_pct * 10.0, 0, 100)
    if history_median is None:
        return rounded(plain)
    versus = clamp(50.0 + (yield_pct - history_median) * 10.0, 0, 100)
    return rounded(F.when(history_median > 0, versus).otherwise(plain))


def forward_growth(eps_fy0, eps_fy1, eps_ttm, fallback_growth) -> Column:
    """Mean of the EPS step and the growth fallback. The EPS step is fy1/fy0, although fy1 is the older year."""
    step = (
        F.when(eps_fy1.isNotNull() & (eps_fy0 != 0), (eps_fy1 / eps_fy0 - 1.0) * 100.0)
        .when(eps_fy0.isNotNull() & (eps_ttm != 0), (eps_fy0 / eps_ttm - 1.0) * 100.0)
    )
    return mean_of(step, fallback_growth)


# --- growth and profitability ----------------------------------------------------------------
def yoy_growth(latest: Column, prior: Column) -> Column:
    return F.when(prior > 0, latest / prior - 1.0)


def stability(n_values: Column, n_rates: Column, mean: Column, std: Column) -> Column:
    """Consistency of growth rates from their moments: 1 - coefficient of variation, as 0..100."""
    score = clamp(F.lit(1.0) - F.least(std / F.abs(mean), F.lit(2.0)), 0, 1) * 100.0
    return F.when((n_values >= 4) & (n_rates >= 3), F.when(F.abs(mean) < 1e-9, 50.0).otherwise(score))


def roce(ebit, total_assets, current_liabilities) -> Column:
    employed = total_assets - current_liabilities
    return F.when(employed > 0, ebit / employed * 100.0)


def roce_median(fy0, fy1, fy2) -> Column:
    return median_of([fy0, fy1, fy2], at_least=2)


def share_positive(n_positive: Column, n: Column, at_least: int = 3) -> Column:
    return F.when(n >= at_least, n_positive / n * 100.0)


def promoter_buying(now: Column, before: Column) -> Column:
    return rounded(clamp(50.0 + (now - before) * 10.0, 0, 100))


def operating_leverage(block_now: Column, block_before: Column, turnover: Column) -> Column:
    growth = block_now / block_before - 1.0
    score = rounded(clamp(growth * (F.lit(1.0) / F.greatest(turnover, F.lit(0.1))) * 500.0, 0, 100))
    return F.when((block_before > 0) & block_now.isNotNull() & turnover.isNotNull(),
                  F.when(growth <= 0, F.lit(20.0)).otherwise(score))


def margin_expansion(fy0: Column, fy1: Column, fy2: Column, revenue_growth: Column) -> Column:
    trend = F.when(fy2.isNotNull(), (fy0 - fy2) / 2.0).otherwise(fy0 - fy1)
    trend = F.when((revenue_growth < 5.0) & (trend > 0), trend * 1.3).otherwise(trend)
    return F.when(fy1.isNotNull(), rounded(clamp(50.0 + trend * 3.0, 0, 100)))


def piotroski(roa, cfo, roa_prior, cash_conversion, debt, debt_prior, liquidity, liquidity_prior,
              margin, margin_prior, turnover, turnover_prior, diluted: Column | None = None) -> Column:
    """Share of the nine quality signals that pass, among those that can be read (at least four)."""
    signals = [roa > 0, cfo > 0, roa > roa_prior, cash_conversion >= 1.0, debt < debt_prior,
               liquidity > liquidity_prior, margin > margin_prior, turnover > turnover_prior]
    if diluted is not None:
        signals.append(~diluted)
    available, passed = F.lit(0), F.lit(0)
    for signal in signals:
        available = available + signal.isNotNull().cast("int")
        passed = passed + F.coalesce(signal, F.lit(False)).cast("int")
    return F.when(available >= 4, rounded(passed / available * 100.0))


# --- risk ------------------------------------------------------------------------------------
def surveillance_risk(asm_stage: Column, gsm_stage: Column) -> Column:
    return F.greatest(mapped(asm_stage, S.ASM_RISK, F.lit(90.0)), mapped(gsm_stage, S.GSM_RISK, F.lit(0.0)))


def distress_risk(debt: Column, coverage: Column, grade: Column) -> Column:
    """Additive distress points, 100 at most; an unrated entity with any other input counts as grade 9."""
    rated = F.coalesce(grade, F.when(debt.isNotNull() | coverage.isNotNull(), F.lit(9)))
    points = (
        F.when(debt > 5.0, 40.0).when(debt > 3.0, 20.0).otherwise(0.0)
        + F.when(coverage < 1.0, 40.0).when(coverage < 1.5, 20.0).otherwise(0.0)
        + F.when(rated >= 5, 25.0).otherwise(0.0)
        + F.when(rated == 8, 100.0).otherwise(0.0)
    )
    return F.least(points, F.lit(100.0))


def beneish_score(**inputs: Column) -> Column:
    total = F.lit(S.BENEISH["const"])
    for name in ("dsri", "gmi", "aqi", "sgi", "depi", "sgai", "tata", "lvgi"):
        total = total + F.lit(S.BENEISH[name]) * inputs[name]
    return total


def beneish_risk(m_score: Column) -> Column:
    return F.when(m_score > S.BENEISH_HIGH, 100.0).when(m_score > S.BENEISH_WATCH, 50.0).when(
        m_score.isNotNull(), 0.0)


def governance_risk(events: Column) -> Column:
    points = F.aggregate(
        F.transform(F.coalesce(events, F.array().cast("array<string>")),
                    lambda e: mapped(e, S.GOVERNANCE_EVENT_SCORES, F.lit(0.0))),
        F.lit(0.0), lambda acc, p: acc + p)
    return F.least(points, F.lit(100.0))


def bad_loan_risk(gross: Column, net: Column) -> Column:
    risk = F.coalesce(gross, F.lit(0.0)) * 5.0 + F.coalesce(net, F.lit(0.0)) * 10.0
    return F.when(gross.isNotNull() | net.isNotNull(), F.least(risk, F.lit(100.0)))


def shortfall_risk(value: Column, target: float) -> Column:
    """0 at or above the target, 100 at zero."""
    short = F.when(value.isNotNull(), F.greatest(F.lit(target) - value, F.lit(0.0)))
    return F.when(short.isNotNull(), F.least(short * F.lit(100.0 / target), F.lit(100.0)))


def capital_risk(car: Column) -> Column:
    return shortfall_risk(car, S.CAR_BUFFER)


def provision_risk(pcr: Column) -> Column:
    return shortfall_risk(F.coalesce(pcr, F.lit(S.PCR_DEFAULT)), S.PCR_TARGET)


def funding_risk(short_term_pct: Column) -> Column:
    return clamp(short_term_pct, 0, 100)


def disqualifiers(asm_stage, gsm_stage, coverage, grade, pledge, gnpa, nnpa, car, pcr, alm, turnover,
                  events) -> Column:
    """Messages of the triggered hard exclusions, in rule order (empty array = none)."""
    stopped = F.array_intersect(F.coalesce(events, F.array().cast("array<string>")),
                                F.array(*[F.lit(e) for e in S.GOVERNANCE_DISQUALIFIERS]))
    rules = [
        F.when(gsm_stage >= 1, F.format_string("GSM Stage %d active", gsm_stage)),
        F.when(asm_stage >= 3, F.format_string("ASM Stage %d active", asm_stage)),
        F.when(coverage < 1.0, F.format_string("Interest Coverage %.2fx < 1.0", coverage)),
        F.when(grade == 8, F.format_string("Credit Rating in Default category (grade %d)", grade)),
        F.when(pledge > S.PLEDGE_DISQUALIFIER, F.format_string("Promoter Pledge %.1f%% > 60%%", pledge)),
        F.when(gnpa > S.GNPA_DISQUALIFIER, F.format_string("GNPA %.1f%% > 15%%", gnpa)),
        F.when(nnpa > S.NNPA_DISQUALIFIER, F.format_string("NNPA %.1f%% > 8%%", nnpa)),
        F.when(car < S.CAR_DISQUALIFIER, F.format_string("CAR %.1f%% < 10%%", car)),
        F.when(pcr < S.PCR_DISQUALIFIER, F.format_string("PCR %.1f%% < 30%%", pcr)),
        F.when(alm > S.ALM_DISQUALIFIER, F.format_string("ALM ST Borrowings %.1f%% > 50%%", alm)),
        F.when(turnover < S.TURNOVER_DISQUALIFIER,
               F.format_string("Daily Turnover ₹%.2fCr < ₹0.25Cr", turnover)),
        F.when(F.size(stopped) > 0,
               F.concat(F.lit("Governance disqualifier: ['"), F.array_join(stopped, "', '"), F.lit("']"))),
    ]
    return F.array_compact(F.array(*rules))


# --- earnings, forward value, holdings, momentum ---------------------------------------------
def acceleration_score(recent: Column, trend: Column, slope: float = 1.5) -> Column:
    return rounded(clamp((recent - trend) * F.lit(slope) + 50.0, 0, 100))


def margin_surprise(margin: Column, long_run: Column) -> Column:
    return F.when(long_run > 0, acceleration_score(margin, long_run, 3.0))


def earnings_momentum(rev_yoy, rev_3y, profit_yoy, profit_3y) -> Column:
    up = (rev_yoy > rev_3y).cast("int") + (profit_yoy > profit_3y).cast("int")
    return F.when(up == 2, 80.0).when(up == 1, 60.0).when(up == 0, 30.0)


def blended_growth(yoy: Column, trend: Column) -> Column:
    return F.coalesce(trend * 0.6 + yoy * 0.4, trend, yoy)


def forward_pe(pe: Column, growth_pct: Column) -> Column:
    factor = F.lit(1.0) + growth_pct / 100.0
    return F.when((pe > 0) & (growth_pct > -80) & (factor > 0.1), pe / factor)


def peg_ratio(pe: Column, growth_pct: Column) -> Column:
    return F.when((pe > 0) & (growth_pct > 1), pe / growth_pct)


def peg_score(peg: Column) -> Column:
    return (
        F.when(peg <= 0, 10.0)
        .when(peg < 0.5, 90.0)
        .when(peg < 1.0, F.lit(80.0) - (peg - 0.5) * 20.0)
        .when(peg < 1.5, F.lit(70.0) - (peg - 1.0) * 30.0)
        .when(peg < 2.0, F.lit(55.0) - (peg - 1.5) * 30.0)
        .when(peg.isNotNull(), F.greatest(F.lit(10.0), F.lit(40.0) - (peg - 2.0) * 10.0))
    )


def garp_score(pe_score: Column, peg_score_: Column, growth_pct: Column) -> Column:
    """Sum of the present parts over .3, .7 or 1.0 for one, two or three parts, whichever they are."""
    quality = F.when(growth_pct > 15, clamp(growth_pct, 0, 50) * 0.3)
    parts = [pe_score * 0.3, peg_score_ * 0.4, quality]
    total, count = F.lit(0.0), F.lit(0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
        count = count + part.isNotNull().cast("int")
    divisor = F.when(count == 1, 0.3).when(count == 2, 0.7).when(count == 3, 1.0)
    return rounded(total / divisor)


def institutional_interest(*holdings: Column) -> Column:
    total, seen = F.lit(0.0), F.lit(False)
    for h in holdings:
        total = total + F.coalesce(h, F.lit(0.0))
        seen = seen | h.isNotNull()
    return F.when(seen, rounded(clamp(total * 1.3 + 20.0, 0, 100)))


def holding_change(now: Column, before: Column) -> Column:
    return rounded(clamp((now - before) * 6.0 + 50.0, 0, 100))


def fresh_entry(now: Column, before: Column) -> Column:
    return F.when((before < 0.1) & (now >= 0.5), 80.0)


def dual_momentum(r6, r12, index_r6, index_r12, bill_rate: float = 6.5) -> Column:
    absolute = clamp((r12 - F.lit(bill_rate)) / 40.0 * 50.0 + 25.0, 0, 50)
    relative = (r12 - index_r12) * 0.6 + (F.coalesce(r6, F.lit(0.0)) - F.coalesce(index_r6, F.lit(0.0))) * 0.4
    return rounded(absolute + clamp(relative / 30.0 * 50.0 + 25.0, 0, 50))


# --- recommendation layer --------------------------------------------------------------------
def _by_mode(mode: Column, bear, bull, neutral) -> Column:
    return F.when(mode == "bear", F.lit(bear)).when(mode == "bull", F.lit(bull)).otherwise(F.lit(neutral))


def expected_upside(gap, value_score, confidence, mode, regime_score) -> Column:
    base = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))).when(
        value_score.isNotNull(), F.greatest((value_score - 50.0) * 0.9, F.lit(0.0)))
    haircut = F.when(confidence == "Low", S.HAIRCUT_LOW).when(confidence == "Medium", S.HAIRCUT_MEDIUM).otherwise(1.0)
    sector = F.when(regime_score.isNotNull(), F.lit(0.85) + regime_score / 100.0 * 0.30).otherwise(1.0)
    return base * haircut * _by_mode(mode, 0.88, 1.05, 1.0) * sector


def expected_downside(red_flags, entry_point, resilience, mode) -> Column:
    """A score of exactly 0 counts as missing (50) in the risk and entry terms."""
    risk = F.lit(100.0) - missing_as(red_flags, 50.0)
    entry = F.greatest(F.lit(55.0) - missing_as(entry_point, 50.0), F.lit(0.0))
    cushion = F.coalesce((resilience - 50.0) * 0.08, F.lit(0.0))
    raw = (F.lit(8.0) + risk * 0.18 + entry * 0.12 - cushion) * _by_mode(mode, 1.18, 0.92, 1.0)
    return clamp(raw, S.DOWNSIDE_MIN, S.DOWNSIDE_MAX)


def gate_reasons(red_flags, confidence, turnover, pledge, distress, mode) -> Column:
    bear = mode == "bear"

    def limit(name: str) -> tuple[Column, Column]:
        value = F.when(bear, F.lit(S.BEAR_GATE[name])).otherwise(F.lit(S.GATE[name]))
        return value, F.format_string("%.1f", value)

    red_min, red_text = limit("red_flags")
    pledge_max, pledge_text = limit("pledge")
    distress_max, distress_text = limit("distress")
    return F.array_compact(F.array(
        F.when(red_flags.isNull() | (red_flags < red_min),
               F.concat(F.lit("Red flags too high (score<"), red_text, F.lit(")"))),
        F.when(confidence_rank(confidence) < 1, F.lit("Confidence below Medium")),
        F.when(turnover < S.GATE["turnover"], F.lit("Low liquidity (<₹1.0 Cr/day)")),
        F.when(pledge > pledge_max, F.concat(F.lit("High promoter pledge (>"), pledge_text, F.lit("%)"))),
        F.when(distress > distress_max,
               F.concat(F.lit("Default/distress risk too high (>"), distress_text, F.lit(")"))),
    ))


def base_recommendation(status, red_flags, potential, value) -> Column:
    """First-pass call before the overlays."""
    return (
        F.when(status.isin("Uninvestable", "Avoid", "Insufficient Data"), "Avoid")
        .when(red_flags < 40, "Avoid")
        .when((potential >= S.BUY_POTENTIAL) & (value >= S.BUY_VALUE), "Buy Candidate")
        .otherwise("Watchlist")
    )


def recommendation(status, potential, value, gate_passed, mode) -> Column:
    bear = mode == "bear"
    buy_extra, watch_extra = F.when(bear, 4.0).otherwise(0.0), F.when(bear, 2.0).otherwise(0.0)
    return (
        F.when((potential >= F.lit(S.BUY_POTENTIAL) + buy_extra) & (value >= F.lit(S.BUY_VALUE) + buy_extra)
               & gate_passed & (status == "Investable"), "Buy Candidate")
        .when((potential >= F.lit(S.WATCH_POTENTIAL) + watch_extra) & (value >= F.lit(S.WATCH_VALUE) + watch_extra)
              & ~F.coalesce(status, F.lit("")).isin("Uninvestable", "Avoid"), "Watchlist")
        .otherwise("Avoid")
    )


def selection_score(opportunity, potential, risk_reward, red_flags, mode) -> Column:
    w = S.SELECTION_WEIGHTS
    zero = F.lit(0.0)
    blend = (
        F.coalesce(opportunity, zero) * w["opportunity_score"]
        + F.coalesce(potential, zero) * w["potential_score"] * _by_mode(mode, S.BEAR_QUALITY_BOOST, 1.0, 1.0)
        + F.coalesce(risk_reward, zero) * w["risk_reward_score"]
    )
    return rounded(blend * missing_as(red_flags, 50.0) / 100.0 / _by_mode(mode, S.BEAR_RISK_PENALTY, 1.0, 1.0))


def staged_entry_plan(signal, upside, downside) -> Column:
    s1, s2, s3 = S.ENTRY_STAGES
    up = F.coalesce(upside, F.lit(0.0))
    down = missing_as(downside, S.DOWNSIDE_MIN)
    stop = clamp(down * 0.8, S.STOP_LOSS_MIN, S.STOP_LOSS_MAX)
    second = (
        F.when(signal == "Accumulation Zone", "add on confirmation break above 20D high")
        .when(signal == "Constructive Pullback", "add near support retest with volume")
        .otherwise("wait; add only after base breakout")
    )
    third = (
        F.when(signal == "Accumulation Zone", "add after weekly close above 50DMA")
        .when(signal == "Constructive Pullback", "add on RS turn positive for 2 weeks")
        .otherwise("final add after trend confirmation")
    )
    return F.format_string(
        f"Stage1 {s1}%% now; Stage2 {s2}%% (%s); Stage3 {s3}%% (%s); "
        "expected_upside=%.1f%%, expected_downside=%.1f%%, stop=%.1f%%", second, third, up, down, stop)


def action_note(regime, ratio_, gate_passed, reasons) -> Column:
    gate = F.when(gate_passed, F.lit("Gate passed")).otherwise(
        F.concat(F.lit("Gate failed: "), F.array_join(reasons, ", ")))
    return F.concat(regime, F.lit(" sector regime; RR="), F.format_string("%.2f", F.coalesce(ratio_, F.lit(0.0))),
                    F.lit("; "), gate)


def filing_deadline(period_end: Column, filing_type: Column) -> Column:
    days = mapped(filing_type, S.FILING_DEADLINE_DAYS, F.lit(S.FILING_DEADLINE_DAYS["quarterly"]))
    return F.date_add(period_end, days)


def valuation_basics(price, book, pe, high_52w, low_52w) -> dict[str, Column]:
    """Ratios that follow from price, book value, P/E and the 52-week range."""
    return {
        "price_to_book": F.when(book > 0, rounded(price / book)),
        "eps_ttm": F.when(pe > 0, rounded(price / pe)),
        "drawdown_recovery": rounded(drawdown_recovery(price, high_52w, low_52w), 1),
    }


