"""Header aliases of the wide metric export.

Fixed values: headers have to be spelled as data vendors export them.  Matching ignores case and
punctuation, and every header may also carry a ``fund__`` prefix.
"""

METRIC_HEADERS = {
    "return_1y": ["1 Year Return", "Return 1yr", "1Y Return", "Price Return 1Y"],
    "return_6m": ["6 Month Return", "Return 6m", "6M Return", "Price Return 6M"],
    "cagr_5y": ["5 Year CAGR", "Price CAGR 5Y", "Stock CAGR 5Years"],
    "peer_price_strength": ["Relative Strength", "Peer Price Strength"],
    "drawdown_recovery": ["Drawdown Recovery", "52W Recovery", "Price from 52W Low"],
    "forward_view": ["Forward Growth", "Consensus Growth", "EPS Growth Next Year"],
    "pe_percentile": ["P/E", "PE", "Price to Earning"],
    "pb_percentile": ["Price to Book value", "P/B", "PB", "Price to Book"],
    "p_cfo_percentile": ["Price to Cash Flow", "P/CFO", "Price/CFO"],
    "ev_ebitda_percentile": ["EV / EBITDA", "EV/EBITDA", "EV EBITDA"],
    "hist_val_band": ["Historical PE Band", "PE vs 5Y Median", "Hist Val Band"],
    "fcf_yield": ["FCF Yield", "Free Cash Flow Yield"],
    "iv_gap": ["IV Gap", "Intrinsic Value Gap", "Discount to IV"],
    "roe_adj_pb": ["ROE Adjusted PB", "PB/ROE", "ROE Adjusted P/B"],
    "hist_pb_band": ["Historical PB Band", "PB vs 5Y Median", "Hist PB Band"],
    "fair_value_gap": ["Fair Value Gap", "Discount to Fair PB", "Fair PB Gap"],
    "rev_cagr_3y": ["Sales growth 3Years", "Revenue CAGR 3Y", "Sales CAGR 3Y"],
    "eps_cagr_3y": ["Profit growth 3Years", "EPS CAGR 3Y", "PAT CAGR 3Y"],
    "rev_growth_yoy": ["Sales growth", "Revenue Growth YoY", "Sales Growth YoY"],
    "eps_growth_yoy": ["Profit growth", "EPS Growth YoY", "PAT Growth YoY"],
    "peer_growth_rank": ["Peer Growth Rank", "Relative Growth Rank"],
    "growth_stability": ["Growth Stability", "Revenue Stability", "Growth Consistency"],
    "advances_growth": ["Advances Growth", "Loan Book Growth"],
    "deposit_growth": ["Deposit Growth"],
    "nii_growth": ["NII Growth", "Net Interest Income Growth"],
    "fee_income_growth": ["Fee Income Growth", "Non Interest Income Growth"],
    "earnings_growth": ["Earnings Growth", "PAT Growth YoY"],
    "aum_growth": ["AUM Growth"],
    "roce_3y_median": ["ROCE 3Years", "ROCE 3Y", "Median ROCE 3Y"],
    "ebitda_margin": ["OPM", "EBITDA Margin", "Operating Margin"],
    "cfo_pat_ratio": ["CFO/PAT", "Cash Conversion", "CFO PAT Ratio"],
    "margin_trend": ["Margin Trend", "EBITDA Margin Trend"],
    "roa": ["ROA", "Return on Assets"],
    "fcf_consistency": ["FCF Consistency", "Positive FCF %"],
    "roe": ["ROE", "Return on Equity"],
    "nim": ["NIM", "Net Interest Margin"],
    "cost_to_income": ["Cost to Income", "Cost/Income", "Cost-to-Income"],
    "provision_coverage": ["Provision Coverage", "PCR", "PCR %"],
    "credit_cost_discipline": ["Credit Cost", "Credit Cost Ratio"],
    "discount_to_iv": ["Discount to IV", "IV Gap"],
    "rsi_state": ["RSI", "RSI 14", "RSI(14)"],
    "price_vs_200dma": ["Price vs 200 DMA", "Price vs 200DMA", "Distance from 200 DMA"],
    "price_vs_50dma": ["Price vs 50 DMA", "Price vs 50DMA", "Distance from 50 DMA"],
    "volume_delivery": ["Delivery Score", "Delivery Ratio", "Volume Delivery Score"],
    "rs_turn": ["RS Turn", "Relative Strength Turn"],
    "volatility_compression": ["Volatility Compression", "ATR Compression"],
    "discount_to_fair_pb": ["Discount to Fair PB", "Fair PB Gap"],
    "volume": ["Volume Score", "Volume Confirmation"],
    "drawdown_normalization": ["Drawdown Normalization", "Drawdown Recovery"],
    "promoter_pledge": ["Pledged percentage", "Promoter Pledge", "Promoter Pledge %"],
    "accounting_quality": ["Accounting Quality Risk", "Beneish Risk"],
    "liquidity_manipulation": ["Liquidity Risk", "Manipulation Risk"],
    "governance_event": ["Governance Risk", "Governance Event Risk"],
    "slippages_stress": ["Slippage Ratio", "Slippages Stress"],
    "governance_promoter": ["Governance Promoter Risk", "Promoter Governance Risk"],
    "surveillance_default": ["Surveillance Default Risk"],
    "piotroski_f_score": ["Piotroski F-Score", "Piotroski Score", "F-Score"],
    "earnings_yield": ["Earnings Yield Score", "Earnings Yield"],
    "dividend_yield_score": ["Dividend Yield Score"],
    "promoter_buying": ["Promoter Buying Signal", "Promoter Buying"],
    "operating_leverage_score": ["Operating Leverage Score", "Op Leverage Score"],
    "margin_expansion": ["Margin Expansion Score", "Margin Expansion"],
}

INPUT_HEADERS = {
    "close_price": ["Current Price", "CMP", "Close Price", "Price"],
    "intrinsic_value": ["Intrinsic Value", "Estimated Intrinsic Value", "Fair Value"],
    "pledge_pct": ["Pledged percentage", "Promoter Pledge", "Promoter Pledge %"],
    "book_value_per_share": ["Book Value Per Share", "Book Value", "BVPS"],
    "eps_ttm": ["EPS TTM", "EPS (TTM)", "TTM EPS"],
    "eps_fy0": ["EPS FY0", "EPS Latest FY", "EPS FY"],
    "eps_fy1": ["EPS FY1", "EPS FY-1"],
    "eps_fy2": ["EPS FY2", "EPS FY-2"],
    "debt_to_equity": ["Debt to equity", "Debt/Equity", "D/E"],
    "interest_coverage": ["Interest Coverage", "Interest coverage ratio", "ICR"],
    "credit_rating_grade": ["Credit Rating Grade", "Rating Grade"],
    "gnpa_pct": ["GNPA %", "Gross NPA %", "GNPA"],
    "nnpa_pct": ["NNPA %", "Net NPA %", "NNPA"],
    "car_pct": ["CAR %", "CRAR %", "Capital Adequacy"],
    "pcr_pct": ["PCR %", "Provision Coverage Ratio"],
    "alm_st_pct": ["ALM ST %", "Short Term Borrowings %", "ALM Mismatch %"],
    "avg_daily_turnover_cr": ["Avg Daily Turnover Cr", "Turnover 30D Cr", "Daily Turnover Cr"],
    "asm_stage": ["ASM Stage", "ASM"],
    "gsm_stage": ["GSM Stage", "GSM"],
    "is_t2t": ["T2T", "Trade to Trade", "Is T2T"],
    "governance_events": ["Governance Events", "Governance Flags"],
    "beneish_m_score": ["Beneish M Score", "Beneish M-Score"],
    "roe_ttm": ["ROE", "ROE TTM"],
    "current_ratio": ["Current Ratio", "CR"],
    "current_ratio_fy1": ["Current Ratio Prev Year", "Current Ratio FY1"],
    "dividend_yield": ["Dividend Yield", "Div Yield %", "Yield %"],
    "promoter_holding_pct": ["Promoter Holding %", "Promoter %", "Promoter Holdings"],
    "promoter_holding_prev": ["Promoter Holding Prev %", "Promoter Prev Quarter %"],
    "dii_holding_pct": ["DII %", "DII Holding %", "DII Holdings"],
    "gross_block_fy0": ["Gross Block", "Fixed Assets Gross", "Gross Block FY0"],
    "gross_block_fy3": ["Gross Block 3Y Ago", "Gross Block FY3"],
    "asset_turnover": ["Asset Turnover", "Assets Turnover"],
    "asset_turnover_fy1": ["Asset Turnover Prev Year", "Asset Turnover FY1"],
    "opm_fy1": ["OPM FY1", "OPM Prev Year", "Operating Margin FY1"],
    "opm_fy2": ["OPM FY2", "OPM 2Y Ago", "Operating Margin FY2"],
    "roa_fy0": ["ROA", "Return on Assets"],
    "roa_fy1": ["ROA Prev Year", "ROA FY1"],
    "de_fy1": ["D/E Prev Year", "Debt to Equity FY1", "D/E FY1"],
    "cfo_annual": ["Cash from Operations", "CFO Annual", "Operating Cash Flow Annual"],
}

SYMBOL_HEADERS = ["NSE Symbol", "Symbol", "Ticker"]
NAME_HEADERS = ["Name", "Company Name"]
SERIES_HEADERS = ["Series"]
TAXONOMY_HEADERS = {
    "macro_sector": ["Macro Sector", "Macro"],
    "sector": ["Sector"],
    "industry": ["Industry"],
    "basic_industry": ["Basic Industry"],
}
BAR_HEADERS = {
    "ticker": ["TckrSymb", "SYMBOL"],
    "series": ["SctySrs", "SERIES"],
    "date": ["TradDt", "DATE1"],
    "open": ["OpnPric", "OPEN_PRICE"],
    "high": ["HghPric", "HIGH_PRICE"],
    "low": ["LwPric", "LOW_PRICE"],
    "close": ["ClsPric", "CLOSE_PRICE"],
    "prev_close": ["PrvsClsgPric", "PREV_CLOSE"],
    "volume": ["TtlTradgVol", "TOTTRDQTY"],
    "traded_value": ["TtlTrfVal", "TOTTRDVAL"],
}
# file-name date patterns: (regular expression with the date token in group 1, date format)
DATED_FILE_PATTERNS = {
    "bars": [(r"(?i)BhavCopy_NSE_CM_0_0_0_(\d{8})_F_0000\.csv", "yyyyMMdd"),
             (r"(?i)cm(\d{2}[A-Z]{3}\d{4})bhav\.csv", "ddMMMyyyy")],
    "delivery": [(r"(?i)sec_del_eq_(\d{8})", "ddMMyyyy"), (r"(?i)MTO_(\d{8})", "ddMMyyyy")],
    "index": [(r"(?i)ind_close_all_(\d{2}[A-Z]{3}\d{4})", "ddMMMyyyy")],
    "snapshot": [(r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd")],
}
DELIVERY_HEADERS = {
    "symbol": ["SYMBOL", "TckrSymb", "SCRIP_NAME"],
    "series": ["SERIES", "SctySrs"],
    "traded_qty": ["QTY_PER_TRADE", "TRADED_QTY", "TOTTRDQTY", "TtlTradgVol", "TotalTradedQuantity"],
    "deliverable_qty": ["DELIVERABLE_QTY", "DELIV_QTY", "DlvrblQty", "DeliverableQuantity"],
    "delivery_pct": ["DELIV_PER", "DELIVERY_PCT", "DlvryPctge", "Pct_Deliv_Qty_to_TradedQty", "%DlyQt_to_TrdQty",
                     "DeliverablePercentage"],
}
INDEX_HEADERS = {
    "index_name": ["Index Name", "Index"],
    "close": ["Closing Index Value", "Closing Value", "Close", "Close Value"],
}
INDEX_SHORT_NAMES = {
    "NIFTY 500": "nifty500", "NIFTY 50": "nifty50", "NIFTY NEXT 50": "niftynext50",
    "NIFTY MIDCAP 150": "niftymidcap150", "NIFTY SMALLCAP 250": "niftysmallcap250", "NIFTY BANK": "niftybank",
}
# column order of the universe file
TEMPLATE_COLUMNS = [
    "NSE Symbol", "Name", "Macro Sector", "Sector", "Industry", "Basic Industry", "P/E", "Price to Book value",
    "EV / EBITDA", "FCF Yield", "Sales growth 3Years", "Profit growth 3Years", "ROCE 3Years", "OPM", "ROA",
    "Pledged percentage", "1 Year Return", "6 Month Return", "5 Year CAGR", "Relative Strength",
    "Drawdown Recovery", "Forward Growth", "Current Price", "Intrinsic Value", "RSI", "Price vs 200 DMA",
    "Price vs 50 DMA", "Delivery Score", "RS Turn", "Volatility Compression", "Debt to equity",
    "Interest Coverage", "Credit Rating Grade", "Avg Daily Turnover Cr", "ASM Stage", "GSM Stage",
]
IDENTITY_COLUMNS = ["Name", "Macro Sector", "Sector", "Industry", "Basic Industry"]
