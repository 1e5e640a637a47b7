"""Holdings, deals, earnings and forward-value scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.functions import formulas as M
from ratewell.functions.numeric import mean_of, rounded
from ratewell.functions.text import holder_column

HOLDERS = ("promoter_holding_pct", "mf_holding_pct", "fii_holding_pct", "insurance_holding_pct")


def holdings_wide(categories: DataFrame, arrival: str) -> DataFrame:
    """One row per (symbol, as_of) from holder-category rows; the last row of a kind wins."""
    kinds = categories.withColumn("kind", holder_column(F.col("category"))).where(F.col("kind").isNotNull())
    return kinds.groupBy("symbol", "as_of").agg(*[
        rounded(F.max_by("pct", F.when(F.col("kind") == h, F.col(arrival)))).alias(h) for h in HOLDERS])


def latest_snapshot(snapshots: DataFrame, day: str = "as_of") -> DataFrame:
    """Rows of the newest snapshot only."""
    newest = snapshots.agg(F.max(day).alias("newest"))
    return snapshots.where(F.col(day) == newest.scalar())


def net_flows(deals: DataFrame) -> DataFrame:
    """Net bought quantity per symbol and its signal; quantities are added as whole numbers of shares."""
    signed = F.when(F.col("buy_sell").startswith("B"), F.col("quantity")).otherwise(-F.col("quantity"))
    return deals.where(F.col("symbol") != "").groupBy("symbol").agg(
        F.sum(F.round(signed).cast("long")).alias("net_quantity")).withColumn(
        "bulk_deal_signal",
        F.when(F.col("net_quantity") > 0, 75.0).when(F.col("net_quantity") < 0, 25.0).otherwise(50.0))


def institutional_metrics(holdings: DataFrame, deals: DataFrame | None = None) -> DataFrame:
    """Scores of the latest holdings snapshot per symbol, its change to the one before, and the deal signal."""
    series = Window.partitionBy("symbol").orderBy("as_of")
    newest = Window.partitionBy("symbol").orderBy(F.desc("as_of"))
    known = set(holdings.columns)
    rows = holdings.withColumns({c: F.lit(None).cast("double") for c in (
        "fii_holding_pct", "mf_holding_pct", "dii_holding_pct", "insurance_holding_pct") if c not in known})
    rows = (
        rows.withColumn("fii_before", F.lag("fii_holding_pct").over(series))
        .withColumn("mf_before", F.lag("mf_holding_pct").over(series))
        .withColumn("back", F.row_number().over(newest)).where(F.col("back") == 1)
    )
    scores = rows.select(
        "symbol",
        M.institutional_interest(*[F.col(c) for c in (
            "fii_holding_pct", "mf_holding_pct", "dii_holding_pct", "insurance_holding_pct")]).alias(
            "institutional_interest"),
        M.holding_change(F.col("fii_holding_pct"), F.col("fii_before")).alias("fii_holding_change"),
        M.holding_change(F.col("mf_holding_pct"), F.col("mf_before")).alias("mf_holding_change"),
        M.fresh_entry(F.col("mf_holding_pct"), F.col("mf_before")).alias("fresh_mf_entry"))
    if deals is None:
        return scores.withColumn("bulk_deal_signal", F.lit(None).cast("double"))
    return scores.join(net_flows(deals).drop("net_quantity"), "symbol", "left")


def earnings_surprise(rows: DataFrame) -> DataFrame:
    """Surprise scores from rev_growth_yoy, rev_cagr_3y, eps_growth_yoy, eps_cagr_3y, ebitda_margin, opm_5y."""
    c = F.col
    scored = rows.select(
        "ticker",
        M.acceleration_score(c("rev_growth_yoy"), c("rev_cagr_3y")).alias("revenue_surprise"),
        M.acceleration_score(c("eps_growth_yoy"), c("eps_cagr_3y")).alias("profit_surprise"),
        M.margin_surprise(c("ebitda_margin"), c("opm_5y")).alias("margin_surprise"),
        M.earnings_momentum(c("rev_growth_yoy"), c("rev_cagr_3y"), c("eps_growth_yoy"), c("eps_cagr_3y")).alias(
            "earnings_momentum"))
    return scored.withColumn("earnings_surprise_composite", rounded(mean_of(
        c("revenue_surprise"), c("profit_surprise"), c("margin_surprise"))))


def forward_value(rows: DataFrame) -> DataFrame:
    """Forward P/E, PEG and growth-at-a-reasonable-price scores from pe and the growth columns."""
    c = F.col
    eps = M.blended_growth(c("eps_growth_yoy"), c("eps_cagr_3y"))
    rev = M.blended_growth(c("rev_growth_yoy"), c("rev_cagr_3y"))
    base = rows.select(
        "ticker", eps.alias("eps"), rev.alias("rev"), M.forward_pe(c("pe"), eps).alias("fpe"),
        M.peg_ratio(c("pe"), eps).alias("peg"))
    pe_score = F.when(c("fpe").isNotNull(), rounded(F.greatest(F.lit(5.0), F.least(F.lit(95.0), F.lit(100.0) - c("fpe") * 1.5))))
    return base.withColumn("forward_pe_score", pe_score).withColumn("peg_score", rounded(M.peg_score(c("peg")))).select(
        "ticker", rounded(c("fpe")).alias("forward_pe"), "forward_pe_score", rounded(c("peg")).alias("peg_ratio"),
        "peg_score", M.garp_score(c("forward_pe_score"), c("peg_score"), c("eps")).alias("garp_score"),
        rounded(c("eps")).alias("est_eps_growth"), rounded(c("rev")).alias("est_rev_growth"))


def earnings_stats(scores: DataFrame) -> DataFrame:
    x = F.col("earnings_surprise_composite")
    return scores.where(x.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum(F.round(x * 100).cast("long")) / 100.0 / F.count(F.lit(1))).alias("mean_composite"),
        F.count_if(x > 70).alias("n_beats"), F.count_if(x < 30).alias("n_misses"))
