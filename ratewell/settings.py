"""Scoring parameters.

Fixed values: the numbers, labels, column names and patterns in this module have to equal the
published scoring rules for results to agree, so they are stated as plain literals.
"""

from __future__ import annotations

# --- peer groups and scoring -------------------------------------------------------------
PEER_MIN_BASIC_INDUSTRY = 8
PEER_MIN_INDUSTRY = 5
WINSOR_LOW = 0.03
WINSOR_HIGH = 0.97
NEUTRAL_SCORE = 50.0
CARD_COVERAGE_MIN = 0.65
MIN_RANKABLE_CARDS = 4
DISQUALIFIED_SCORE = 15.0

# --- card weights: template -> card -> metric -> weight (metric order matters) ------------
CARD_WEIGHTS = {
    "A": {
        "performance": {"return_1y": 0.22, "return_6m": 0.13, "cagr_5y": 0.12, "peer_price_strength": 0.20,
                        "drawdown_recovery": 0.18, "forward_view": 0.15},
        "valuation": {"pe_percentile": 0.20, "pb_percentile": 0.15, "fcf_yield": 0.20, "iv_gap": 0.20,
                      "roe_adj_pb": 0.15, "dividend_yield_score": 0.10},
        "growth": {"rev_cagr_3y": 0.18, "eps_cagr_3y": 0.18, "rev_growth_yoy": 0.14, "eps_growth_yoy": 0.14,
                   "peer_growth_rank": 0.16, "growth_stability": 0.20},
        "profitability": {"roce_3y_median": 0.20, "ebitda_margin": 0.17, "cfo_pat_ratio": 0.20,
                          "margin_trend": 0.13, "roa": 0.10, "fcf_consistency": 0.20},
        "entry_point": {"discount_to_iv": 0.29, "rsi_state": 0.10, "price_vs_200dma": 0.15, "price_vs_50dma": 0.10,
                        "volume_delivery": 0.14, "rs_turn": 0.11, "volatility_compression": 0.11},
        "red_flags": {"promoter_pledge": 0.18, "asm_gsm_risk": 0.22, "default_distress": 0.23,
                      "accounting_quality": 0.15, "liquidity_manipulation": 0.12, "governance_event": 0.10},
        "contrarian": {"piotroski_f_score": 0.25, "earnings_yield": 0.20, "dividend_yield_score": 0.15,
                       "promoter_buying": 0.20, "operating_leverage_score": 0.10, "margin_expansion": 0.10},
    },
    "B": {
        "performance": {"return_1y": 0.23, "return_6m": 0.14, "cagr_5y": 0.10, "peer_price_strength": 0.19,
                        "drawdown_recovery": 0.17, "forward_view": 0.17},
        "valuation": {"pb_percentile": 0.33, "roe_adj_pb": 0.21, "pe_percentile": 0.08, "hist_pb_band": 0.20,
                      "fair_value_gap": 0.18},
        "growth": {"deposit_growth": 0.20, "earnings_growth": 0.18, "rev_cagr_3y": 0.18, "eps_cagr_3y": 0.16,
                   "rev_growth_yoy": 0.14, "growth_stability": 0.14},
        "profitability": {"roa": 0.20, "roe": 0.18, "nim": 0.20, "cost_to_income": 0.11, "provision_coverage": 0.16,
                          "credit_cost_discipline": 0.15},
        "entry_point": {"discount_to_fair_pb": 0.30, "rsi_state": 0.10, "price_vs_200dma": 0.15,
                        "price_vs_50dma": 0.10, "volume": 0.10, "rs_turn": 0.15, "drawdown_normalization": 0.10},
        "red_flags": {"default_distress": 0.22, "asm_gsm_risk": 0.18, "pcr_weakness": 0.16,
                      "governance_promoter": 0.12, "liquidity_manipulation": 0.16, "surveillance_default": 0.16},
        "contrarian": {"piotroski_f_score": 0.30, "earnings_yield": 0.25, "dividend_yield_score": 0.20,
                       "promoter_buying": 0.25},
    },
    "C": {
        "performance": {"return_1y": 0.23, "return_6m": 0.14, "cagr_5y": 0.10, "peer_price_strength": 0.19,
                        "drawdown_recovery": 0.17, "forward_view": 0.17},
        "valuation": {"pb_percentile": 0.33, "roe_adj_pb": 0.21, "pe_percentile": 0.08, "hist_pb_band": 0.20,
                      "fair_value_gap": 0.18},
        "growth": {"aum_growth": 0.20, "earnings_growth": 0.18, "rev_cagr_3y": 0.18, "eps_cagr_3y": 0.16,
                   "rev_growth_yoy": 0.14, "growth_stability": 0.14},
        "profitability": {"roa": 0.20, "roe": 0.18, "nim": 0.20, "cost_to_income": 0.11, "provision_coverage": 0.16,
                          "credit_cost_discipline": 0.15},
        "entry_point": {"discount_to_fair_pb": 0.30, "rsi_state": 0.10, "price_vs_200dma": 0.15,
                        "price_vs_50dma": 0.10, "volume": 0.10, "rs_turn": 0.15, "drawdown_normalization": 0.10},
        "red_flags": {"default_distress": 0.24, "asm_gsm_risk": 0.18, "pcr_weakness": 0.12,
                      "governance_promoter": 0.12, "liquidity_manipulation": 0.18, "surveillance_default": 0.16},
        "contrarian": {"piotroski_f_score": 0.30, "earnings_yield": 0.25, "dividend_yield_score": 0.20,
                       "promoter_buying": 0.25},
    },
}
CARDS = ("performance", "valuation", "growth", "profitability", "entry_point", "red_flags", "contrarian")
CORE_CARDS = ("valuation", "growth", "profitability", "entry_point", "performance")
TEMPLATE_NAMES = {"A": "General", "B": "Bank", "C": "NBFC/HFC"}

# metrics where a smaller value earns the higher score; every other metric is higher-is-better
LOWER_IS_BETTER = (
    "pe_percentile", "pb_percentile", "p_cfo_percentile", "ev_ebitda_percentile", "roe_adj_pb", "cost_to_income",
    "credit_cost_discipline", "price_vs_200dma", "price_vs_50dma", "promoter_pledge", "asm_gsm_risk",
    "default_distress", "accounting_quality", "liquidity_manipulation", "governance_event", "gnpa_nnpa_stress",
    "pcr_weakness", "capital_adequacy_stress", "slippages_stress", "governance_promoter", "surveillance_default",
    "alm_mismatch",
)

# --- composites --------------------------------------------------------------------------
OPPORTUNITY_WEIGHTS = {"valuation": 0.22, "growth": 0.18, "profitability": 0.22, "entry_point": 0.15,
                       "performance": 0.15, "contrarian": 0.08}
BEAR_OPPORTUNITY_WEIGHTS = {"valuation": 0.24, "growth": 0.10, "profitability": 0.20, "entry_point": 0.10,
                            "performance": 0.08, "contrarian": 0.28}
POTENTIAL_WEIGHTS = {"growth": 0.34, "profitability": 0.32, "performance": 0.16, "red_flags": 0.18}
VALUATION_GAP_WEIGHTS = {"valuation": 0.72, "entry_point": 0.28}
SECTOR_REGIME_WEIGHTS = {"performance": 0.30, "growth": 0.25, "profitability": 0.25, "red_flags": 0.20}
SELECTION_WEIGHTS = {"opportunity_score": 0.40, "potential_score": 0.30, "risk_reward_score": 0.30}

# --- labels and bands: (low, high, label), low inclusive, high exclusive, 100 closes the last one
_LEVELS = [(0, 20, "Very Low"), (20, 40, "Low"), (40, 60, "Neutral"), (60, 80, "Good"), (80, 100, "High")]
CARD_LABELS = {
    "performance": _LEVELS,
    "growth": _LEVELS,
    "profitability": _LEVELS,
    "valuation": [(0, 20, "Very Expensive"), (20, 40, "Expensive"), (40, 60, "Fair"), (60, 80, "Attractive"),
                  (80, 100, "Very Attractive")],
    "entry_point": [(0, 20, "Poor"), (20, 40, "Weak"), (40, 60, "Neutral"), (60, 80, "Good"), (80, 100, "Strong")],
    "red_flags": [(0, 20, "Severe"), (20, 40, "High"), (40, 60, "Moderate"), (60, 80, "Low"), (80, 100, "None")],
    "contrarian": [(0, 20, "None"), (20, 40, "Weak"), (40, 60, "Moderate"), (60, 80, "Strong"),
                   (80, 100, "Very Strong")],
}
RED_FLAG_CAPS = [(0, 20, None, "Uninvestable"), (20, 40, 40.0, "Avoid"), (40, 60, 60.0, "Watchlist"),
                 (60, 80, 80.0, "Investable"), (80, 100, None, "Investable")]
RSI_SCORES = [(0.0, 20.0, 10.0), (20.0, 25.0, 40.0), (25.0, 35.0, 100.0), (35.0, 45.0, 80.0), (45.0, 55.0, 55.0),
              (55.0, 65.0, 35.0), (65.0, 75.0, 15.0), (75.0, 100.1, 5.0)]
PLEDGE_RISK = [(0.0, 10.0, 0.0), (10.0, 25.0, 25.0), (25.0, 40.0, 50.0), (40.0, 60.0, 75.0), (60.0, 101.0, 100.0)]
LIQUIDITY_RISK = [(50.0, 1e18, 0.0), (5.0, 50.0, 10.0), (1.0, 5.0, 30.0), (0.25, 1.0, 70.0), (0.0, 0.25, 100.0)]
ASM_RISK = {0: 0.0, 1: 30.0, 2: 50.0, 3: 70.0, 4: 90.0}
GSM_RISK = {0: 0.0, 1: 50.0, 2: 65.0, 3: 75.0, 4: 85.0, 5: 95.0, 6: 100.0}
GOVERNANCE_EVENT_SCORES = {
    "auditor_resignation": 50.0, "auditor_qualification": 40.0, "sebi_penalty_major": 40.0,
    "sebi_penalty_minor": 15.0, "exchange_disciplinary": 20.0, "management_fraud_news": 30.0,
    "nse_action_suspension": 100.0, "promoter_insider_trading": 35.0, "agm_delayed": 10.0,
}
GOVERNANCE_DISQUALIFIERS = ("nse_action_suspension",)
THESIS_SCORE = [(80, 101, "exceptional"), (65, 80, "strong"), (50, 65, "above average"), (40, 50, "moderate"),
                (25, 40, "below average"), (0, 25, "weak")]
THESIS_VALUATION = [(80, 101, "deeply undervalued"), (65, 80, "undervalued"), (50, 65, "fairly valued"),
                    (40, 50, "slightly expensive"), (25, 40, "expensive"), (0, 25, "very expensive")]
THESIS_ENTRY = [(70, 101, "excellent entry point"), (55, 70, "favorable entry"), (40, 55, "neutral timing"),
                (25, 40, "unfavorable entry"), (0, 25, "poor timing (wait)")]
THESIS_GROWTH = [(80, 101, "high-growth"), (60, 80, "above-average growth"), (40, 60, "moderate growth"),
                 (20, 40, "low growth"), (0, 20, "declining")]
THESIS_RISK = [(80, 101, "minimal risk flags"), (60, 80, "low risk"), (40, 60, "moderate risk"),
               (20, 40, "elevated risk"), (0, 20, "high risk")]

# --- formula constants -------------------------------------------------------------------
WACC_GENERAL = 0.12
COST_OF_EQUITY = {"B": 0.13, "C": 0.14}
GRAHAM_FACTOR = 22.5
GRAHAM_CAP = 2.0
BENEISH = {"const": -4.84, "dsri": 0.920, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172,
           "tata": 4.679, "lvgi": -0.327}
BENEISH_HIGH = -1.78
BENEISH_WATCH = -2.22
PLEDGE_DISQUALIFIER = 60.0
GNPA_DISQUALIFIER = 15.0
NNPA_DISQUALIFIER = 8.0
CAR_BUFFER = 14.0
CAR_DISQUALIFIER = 10.0
PCR_TARGET = 75.0
PCR_DISQUALIFIER = 30.0
PCR_DEFAULT = 50.0
ALM_DISQUALIFIER = 50.0
TURNOVER_DISQUALIFIER = 0.25
FILING_DEADLINE_DAYS = {"quarterly": 45, "annual": 60, "shareholding": 21}

# --- regime, gates, recommendation ---------------------------------------------------------
BEAR_RETURN, BEAR_RECOVERY = -8.0, 45.0
BULL_RETURN, BULL_RECOVERY = 8.0, 60.0
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 85.0, 65.0
BUY_POTENTIAL, BUY_VALUE, WATCH_POTENTIAL, WATCH_VALUE = 72.0, 66.0, 56.0, 46.0
DOWNSIDE_MIN, DOWNSIDE_MAX = 5.0, 35.0
HAIRCUT_LOW, HAIRCUT_MEDIUM = 0.80, 0.90
GATE = {"red_flags": 45.0, "turnover": 1.0, "pledge": 35.0, "distress": 60.0}
BEAR_GATE = {"red_flags": 55.0, "turnover": 1.0, "pledge": 25.0, "distress": 45.0}
BEAR_QUALITY_BOOST, BEAR_RISK_PENALTY = 1.10, 1.15
ENTRY_STAGES = (40, 35, 25)
STOP_LOSS_MIN, STOP_LOSS_MAX = 8.0, 18.0

# --- portfolio, monitoring, publishing gates ------------------------------------------------
PORTFOLIO_MAX_NAMES, PORTFOLIO_MAX_SINGLE, PORTFOLIO_MAX_SECTOR = 18, 8.0, 28.0
OUTCOME_HORIZON_DAYS, BUY_HIT_RATE_ALERT = 30, 0.50
TEMPLATE_CARD_MIN, TEMPLATE_RED_FLAG_MIN, TEMPLATE_CORE_MIN = 25.0, 25.0, 55.0
INPUT_GATES = {"min_universe": 250, "min_core_pct": 8.0, "min_core_cards": 3, "min_classified_pct": 90.0}
HOLDOUT_START, VALIDATION_START, CHANGE_BUDGET = "2024-04-01", "2022-04-01", 5
BACKTEST_HORIZONS = {"1M": 22, "3M": 63, "6M": 130, "1Y": 252}

# --- taxonomy routing ----------------------------------------------------------------------
BANK_BASIC = ("private sector bank", "public sector bank", "foreign bank", "bank - private", "bank - public", "banks")
BANK_INDUSTRY = ("banking", "private sector bank", "public sector bank", "other bank", "foreign bank")
NBFC_INDUSTRY = ("non banking financial company (nbfc)", "housing finance company", "microfinance institutions",
                 "micro finance", "financial institution", "asset finance company")
NBFC_TOKENS = ("non banking financial company", "housing finance", "microfinance", "micro finance",
               "financial institution", "asset finance", "nbfc", "hfc")

# --- text ----------------------------------------------------------------------------------
MISSING_TOKENS = ("", "na", "nan", "none", "-", "—")
# cells that a universe merge replaces, case as written
UNSET_TOKENS = ("", "nan", "none", "-", "None")
FUND_NAME_PATTERN = (r"(?i)\b(etf|etn|bees|index fund|liquid etf|gold etf|silver etf|exchange traded fund)\b")
RECOMMENDATION_ALIASES = {
    "buy": "Buy Candidate", "buy candidate": "Buy Candidate", "hold": "Watchlist", "watch": "Watchlist",
    "watchlist": "Watchlist", "avoid": "Avoid", "unsupported": "Unsupported", "unsupported data": "Unsupported",
}
METRIC_NAMES = {
    "return_1y": "1-year return", "return_6m": "6-month return", "cagr_5y": "5-year CAGR",
    "peer_price_strength": "peer relative strength", "drawdown_recovery": "drawdown recovery",
    "forward_view": "forward outlook", "pe_percentile": "P/E valuation", "pb_percentile": "P/B valuation",
    "p_cfo_percentile": "price-to-cash-flow", "ev_ebitda_percentile": "EV/EBITDA",
    "hist_val_band": "historical valuation band", "fcf_yield": "free cash flow yield",
    "iv_gap": "intrinsic value gap", "rev_cagr_3y": "3Y revenue CAGR", "eps_cagr_3y": "3Y EPS CAGR",
    "rev_growth_yoy": "YoY revenue growth", "eps_growth_yoy": "YoY EPS growth",
    "peer_growth_rank": "peer growth rank", "growth_stability": "growth consistency",
    "roce_3y_median": "3Y median ROCE", "ebitda_margin": "EBITDA margin",
    "cfo_pat_ratio": "cash-flow-to-profit ratio", "margin_trend": "margin trend", "roa": "return on assets",
    "fcf_consistency": "FCF consistency", "discount_to_iv": "discount to intrinsic value",
    "rsi_state": "RSI momentum", "price_vs_200dma": "price vs 200-DMA", "price_vs_50dma": "price vs 50-DMA",
    "volume_delivery": "delivery volume", "rs_turn": "relative strength turn",
    "volatility_compression": "volatility compression", "promoter_pledge": "promoter pledge",
    "asm_gsm_risk": "ASM/GSM surveillance", "default_distress": "default/distress risk",
    "accounting_quality": "accounting quality", "liquidity_manipulation": "liquidity risk",
    "governance_event": "governance risk",
}


def configured_metrics() -> list[str]:
    """Every metric any card weighs, first appearance first."""
    seen: dict[str, None] = {}
    for cards in CARD_WEIGHTS.values():
        for weights in cards.values():
            seen.update(dict.fromkeys(weights))
    return list(seen)


def weight_rows() -> list[tuple[str, str, str, int, float]]:
    """(template, card, metric, position, weight) rows of the weights dimension."""
    return [
        (template, card, metric, position, weight)
        for template, cards in CARD_WEIGHTS.items()
        for card, weights in cards.items()
        for position, (metric, weight) in enumerate(weights.items())
    ]
