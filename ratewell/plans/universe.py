"""From a text export (and optionally bars) to the wide metric table that is rated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import columns as H
from ratewell import settings as S
from ratewell.functions import formulas as M
from ratewell.functions.bands import liquidity_risk, pledge_risk
from ratewell.functions.numeric import rounded
from ratewell.functions.taxonomy import template_code
from ratewell.functions.text import clean_symbol, is_fund_like, is_missing, is_unset
from ratewell.operators.bars import price_metrics
from ratewell.operators.schema import (
    find_column, first_value, in_template_order, input_columns, metric_columns, prefixed, quoted, fill_missing,
    taxonomy_columns)

PRICE_METRICS = ("close_price", "return_1y", "return_6m", "cagr_5y", "drawdown_recovery", "drawdown_normalization",
                 "rsi_state", "price_vs_200dma", "price_vs_50dma", "volatility_compression", "volume",
                 "avg_daily_turnover_cr")


def read_export(export: DataFrame, arrival: str | None = None) -> DataFrame:
    """Typed wide rows of a text export: ticker, name, taxonomy, template, metrics and raw inputs.

    Fund-like securities and blank tickers are dropped.  Where a ticker repeats, the row with the
    greatest ``arrival`` stays.
    """
    cols = [c for c in export.columns if c != arrival]
    ticker = F.upper(F.trim(first_value(cols, H.SYMBOL_HEADERS)))
    chosen = {"ticker": ticker, "name": F.coalesce(F.trim(first_value(cols, H.NAME_HEADERS)), ticker)}
    chosen |= taxonomy_columns(cols) | metric_columns(cols) | input_columns(cols)
    extra = [quoted(arrival)] if arrival else []
    rows = export.select(*[c.alias(n) for n, c in chosen.items()], *extra).where(
        F.col("ticker").isNotNull() & ~is_fund_like(F.col("name")))
    if arrival:
        rest = [n for n in chosen if n != "ticker"]
        rows = rows.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("r")).select("ticker", "r.*")
    return rows.withColumn("template", template_code(
        F.col("macro_sector"), F.col("sector"), F.col("industry"), F.col("basic_industry")))


def derived_columns() -> dict[str, Column]:
    """Derived metrics; a metric that is already there is kept."""
    c = F.col

    def fill(name: str, value: Column) -> tuple[str, Column]:
        return name, F.coalesce(c(name), value)

    coe = F.when(c("template") == "C", S.COST_OF_EQUITY["C"]).otherwise(S.COST_OF_EQUITY["B"])
    lender = c("template").isin("B", "C")
    fair_gap = F.when(lender, M.gap_pct(M.fair_pb(c("roe_ttm"), coe), c("pb_percentile")))
    value = F.coalesce(
        F.when(c("template") == "A", M.intrinsic_value(
            c("eps_fy0"), c("eps_fy1"), c("eps_fy2"), c("eps_ttm"), c("book_value_per_share"))),
        c("intrinsic_value"))
    distress = M.distress_risk(c("debt_to_equity"), c("interest_coverage"), c("credit_rating_grade").cast("int"))
    watch = M.surveillance_risk(c("asm_stage"), c("gsm_stage"))
    governance = M.governance_risk(c("governance_events"))
    iv_gap = F.coalesce(c("iv_gap"), M.gap_pct(value, c("close_price")))
    return dict([
        ("promoter_pledge", F.when(c("pledge_pct").isNotNull(), pledge_risk(c("pledge_pct"))).otherwise(c("promoter_pledge"))),
        ("iv_gap", iv_gap),
        fill("discount_to_iv", iv_gap),
        fill("forward_view", rounded(M.forward_growth(
            c("eps_fy0"), c("eps_fy1"), c("eps_ttm"), F.coalesce("earnings_growth", "eps_growth_yoy")))),
        fill("roe_adj_pb", F.when(c("roe_ttm") > 0, c("pb_percentile") / c("roe_ttm"))),
        fill("fair_value_gap", fair_gap),
        fill("discount_to_fair_pb", fair_gap),
        fill("default_distress", distress),
        fill("asm_gsm_risk", watch),
        ("gnpa_nnpa_stress", M.bad_loan_risk(c("gnpa_pct"), c("nnpa_pct"))),
        ("capital_adequacy_stress", M.capital_risk(c("car_pct"))),
        fill("pcr_weakness", M.provision_risk(c("pcr_pct"))),
        ("alm_mismatch", M.funding_risk(c("alm_st_pct"))),
        fill("liquidity_manipulation", liquidity_risk(c("avg_daily_turnover_cr"), c("is_t2t"))),
        fill("governance_event", governance),
        fill("governance_promoter", governance),
        fill("surveillance_default", F.greatest(watch, distress)),
        fill("accounting_quality", M.beneish_risk(c("beneish_m_score"))),
        fill("piotroski_f_score", M.piotroski(
            c("roa"), c("cfo_annual"), c("roa_fy1"), c("cfo_pat_ratio"), c("debt_to_equity"), c("de_fy1"),
            c("current_ratio"), c("current_ratio_fy1"), c("ebitda_margin"), c("opm_fy1"), c("asset_turnover"),
            c("asset_turnover_fy1"))),
        fill("earnings_yield", M.earnings_yield(c("pe_percentile"))),
        fill("dividend_yield_score", M.dividend_yield_score(c("dividend_yield"))),
        fill("promoter_buying", M.promoter_buying(c("promoter_holding_pct"), c("promoter_holding_prev"))),
        fill("operating_leverage_score", M.operating_leverage(
            c("gross_block_fy0"), c("gross_block_fy3"), c("asset_turnover"))),
        fill("margin_expansion", M.margin_expansion(
            c("ebitda_margin"), c("opm_fy1"), c("opm_fy2"), c("rev_growth_yoy"))),
    ])


def with_derived(rows: DataFrame) -> DataFrame:
    return rows.withColumns(derived_columns())


def load_universe(export: DataFrame, bars: DataFrame | None = None, arrival: str | None = None,
                  price: DataFrame | None = None) -> DataFrame:
    """The rated table: export values, price metrics from bars where bars exist, then derived metrics."""
    rows = read_export(export, arrival)
    if price is None and bars is not None:
        price = price_metrics(bars)
    if price is not None:
        fresh = price.select("ticker", *[F.col(m).alias(f"__{m}") for m in PRICE_METRICS])
        rows = rows.join(fresh, "ticker", "left").withColumns(
            {m: F.coalesce(F.col(f"__{m}"), F.col(m)) for m in PRICE_METRICS}).drop(*[f"__{m}" for m in PRICE_METRICS])
    return with_derived(rows)


# --- building the export from an end-of-day universe, a classification and a fundamentals file --------
def _cell(df: DataFrame, aliases: list[str]) -> Column:
    found = find_column(df.columns, aliases)
    return F.trim(quoted(found)) if found else F.lit("")


def keep_first(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """First row per key in arrival order, as one aggregate (no window over the key)."""
    rest = [c for c in df.columns if c not in (key, arrival)]
    return df.groupBy(key).agg(F.min_by(F.struct(*[quoted(c) for c in rest]), F.col(arrival)).alias("r")).select(
        key, *[F.col("r").getField(c).alias(c) for c in rest])


def universe_frame(eod: DataFrame, arrival: str, include_all_series: bool = False) -> DataFrame:
    """Symbols of an end-of-day file: EQ series only unless asked, cleaned, first row per symbol."""
    series = find_column(eod.columns, H.SERIES_HEADERS)
    if series and not include_all_series:
        eod = eod.where(F.upper(F.trim(quoted(series))) == "EQ")
    rows = eod.select(
        clean_symbol(quoted(find_column(eod.columns, H.SYMBOL_HEADERS))).alias("NSE Symbol"),
        _cell(eod, ["Name", "Company Name", "Name of Company"]).alias("Name"),
        *[_cell(eod, H.TAXONOMY_HEADERS[k]).alias(title) for k, title in zip(
            H.TAXONOMY_HEADERS, H.IDENTITY_COLUMNS[1:], strict=True)],
        F.col(arrival).alias("__arrival"))
    return keep_first(rows.where(F.col("NSE Symbol") != ""), "NSE Symbol", "__arrival")


def apply_classification(universe: DataFrame, classes: DataFrame, arrival: str) -> DataFrame:
    """Fill blank name and taxonomy cells from the classification master."""
    master = universe_frame(classes, arrival, include_all_series=True)
    master = master.select("NSE Symbol", *[F.col(c).alias(f"__{c}") for c in H.IDENTITY_COLUMNS])
    return universe.join(master, "NSE Symbol", "left").select("NSE Symbol", *[
        F.coalesce(F.when(quoted(c) != "", quoted(c)), quoted(f"__{c}"), F.lit("")).alias(c)
        for c in H.IDENTITY_COLUMNS])


def merge_fundamentals(universe: DataFrame, fundamentals: DataFrame, arrival: str) -> DataFrame:
    """Left join of the universe to the first fundamentals row per symbol; prefixed columns fill the blanks."""
    symbol = find_column([c for c in fundamentals.columns if c != arrival], H.SYMBOL_HEADERS)
    rows = fundamentals.select(
        clean_symbol(quoted(symbol)).alias("NSE Symbol"),
        *[quoted(c) for c in fundamentals.columns if c != symbol])
    rows = keep_first(rows.where(F.col("NSE Symbol") != ""), "NSE Symbol", arrival)
    merged = universe.join(prefixed(rows, "NSE Symbol"), "NSE Symbol", "left")
    return fill_missing(merged, H.IDENTITY_COLUMNS + [c for c in H.TEMPLATE_COLUMNS if c not in (
        "NSE Symbol", *H.IDENTITY_COLUMNS)])


def has_any_value(columns: list[str]) -> Column:
    any_value = F.lit(False)
    for c in columns:
        any_value = any_value | ~is_unset(quoted(c).cast("string"))
    return any_value


def prepare_universe(eod: DataFrame, fundamentals: DataFrame | None, arrival: str,
                     include_all_series: bool = False) -> DataFrame:
    """Universe export in template column order, fundamentals merged in when given."""
    rows = universe_frame(eod, arrival, include_all_series)
    if fundamentals is not None:
        rows = merge_fundamentals(rows, fundamentals, arrival)
    return in_template_order(rows, H.TEMPLATE_COLUMNS)


def preparation_report(prepared: DataFrame) -> DataFrame:
    """One row: symbols, symbols with any fundamentals value, match percentage."""
    fund = [c for c in prepared.columns if c.startswith("fund__")]
    return prepared.agg(
        F.count(F.lit(1)).alias("n_universe_symbols"), F.count_if(has_any_value(fund)).alias("n_fundamentals_matched"),
    ).withColumn("fundamentals_match_pct", F.when(
        F.col("n_universe_symbols") > 0,
        rounded(F.col("n_fundamentals_matched") / F.col("n_universe_symbols") * 100.0)).otherwise(0.0))


def missing_fundamentals(prepared: DataFrame) -> DataFrame:
    """Symbols without a single metric value."""
    metric = [c for c in prepared.columns if c not in ("NSE Symbol", *H.IDENTITY_COLUMNS)]
    return prepared.where(~has_any_value(metric)).select("NSE Symbol", "Name", "Sector", "Industry", "Basic Industry")


def missing_classification(universe: DataFrame) -> DataFrame:
    blank = is_missing(F.col("Sector")) | is_missing(F.col("Industry")) | is_missing(quoted("Basic Industry"))
    return universe.where(blank).select("NSE Symbol", *[quoted(c) for c in H.IDENTITY_COLUMNS])
