"""Market mode, sector regime, risk/reward, gates, ranks and portfolio selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.bands import confidence_label, confidence_rank, regime_label
from ratewell.functions.formulas import (
    action_note, expected_downside, expected_upside, gate_reasons, recommendation, selection_score, staged_entry_plan)
from ratewell.functions.numeric import clamp, ratio, rounded, weighted_mean
from ratewell.operators.ordered import BLOCK_ROWS, is_large, match_groups, ordinal_ranks, upper_median


def market_mode(universe: DataFrame, requested: str = "auto", large: bool | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: the medians the decision rests on and the mode (bear, bull or neutral)."""
    spark = universe.sparkSession
    if requested.lower().strip() in ("bear", "bull", "neutral"):
        return spark.range(1).select(
            F.lit(None).cast("double").alias("median_return_6m"), F.lit(None).cast("double").alias("median_recovery"),
            F.lit(requested.lower().strip()).alias("market_mode"))
    both = universe.select(F.explode(F.array(
        F.struct(F.lit("r6").alias("metric"), F.col("return_6m").alias("value")),
        F.struct(F.lit("dd").alias("metric"), F.col("drawdown_recovery").alias("value")))).alias("m")).select("m.*")
    medians = upper_median(both, ["metric"], "value", "median", large, block_rows).agg(
        F.max(F.when(F.col("metric") == "r6", F.col("median"))).alias("median_return_6m"),
        F.max(F.when(F.col("metric") == "dd", F.col("median"))).alias("median_recovery"))
    r6, dd = F.coalesce("median_return_6m", F.lit(0.0)), F.coalesce("median_recovery", F.lit(50.0))
    nothing = F.col("median_return_6m").isNull() & F.col("median_recovery").isNull()
    return medians.withColumn("market_mode", F.when(nothing, "neutral").when(
        (r6 <= S.BEAR_RETURN) | (dd <= S.BEAR_RECOVERY), "bear").when(
        (r6 >= S.BULL_RETURN) & (dd >= S.BULL_RECOVERY), "bull").otherwise("neutral"))


def sector_regime(ratings: DataFrame) -> DataFrame:
    """Sector score: weighted mean of the sector's mean card scores (scores are added as whole hundredths)."""
    means = ratings.groupBy("sector").agg(F.count(F.lit(1)).alias("n_sector"), *[
        F.sum(F.round(F.col(f"card_{c}.score") * 100).cast("long")).alias(f"{c}_cents")
        for c in S.SECTOR_REGIME_WEIGHTS], *[
        F.count(F.col(f"card_{c}.score")).alias(f"{c}_n") for c in S.SECTOR_REGIME_WEIGHTS])
    score = weighted_mean([
        (F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_cents") / 100.0 / F.col(f"{c}_n")), w)
        for c, w in S.SECTOR_REGIME_WEIGHTS.items()])
    return means.withColumn("sector_regime_score", rounded(F.coalesce(score, F.lit(50.0)))).select(
        "sector", "n_sector", "sector_regime_score", regime_label(F.col("sector_regime_score")).alias(
            "sector_regime_label"))


def with_overlays(ratings: DataFrame, large: bool | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add regime, confidence, expected up/downside, gate, final recommendation, selection score and notes."""
    if large is None:
        large = is_large(ratings, block_rows)
    rows = match_groups(ratings, sector_regime(ratings), ["sector"], "n_sector", ["ticker"], large,
                        block_rows).drop("n_sector")
    red, entry = F.col("card_red_flags.score"), F.col("card_entry_point.score")
    mode = F.col("market_mode")
    cash = F.when(F.col("template") == "A", F.try_element_at("scores", F.lit("cfo_pat_ratio")))
    gap = F.coalesce("iv_gap", "fair_value_gap")
    # the loader keeps weighed metrics only, so the price-to-earnings band comes with universes of other origin
    bands = [F.col(c) for c in ("hist_val_band", "hist_pb_band") if c in ratings.columns]
    evidence = F.when(gap.isNotNull(), 8.0).otherwise(0.0) + F.when(F.coalesce(*bands).isNotNull(), 7.0).otherwise(0.0)
    rows = rows.withColumns({
        "drawdown_resilience_score": rounded(weighted_mean([
            (F.try_element_at("scores", F.lit("drawdown_recovery")), 0.45), (cash, 0.25), (red, 0.30)])),
        "valuation_confidence_score": rounded(F.least(
            F.lit(100.0), F.col("card_valuation.coverage") * 100.0 + evidence))})
    rows = rows.withColumn("confidence", confidence_label(weighted_mean([
        (F.col("valuation_confidence_score"), 0.35), (F.col("potential_score"), 0.35), (red, 0.30)])))
    rows = rows.withColumns({
        "__up": expected_upside(gap, F.col("valuation_gap_score"), F.col("confidence"), mode, F.col("sector_regime_score")),
        "__down": expected_downside(red, entry, F.col("drawdown_resilience_score"), mode),
        "gate_fail_reasons": gate_reasons(
            red, F.col("confidence"), F.col("avg_daily_turnover_cr"), F.col("promoter_pledge"),
            F.col("default_distress"), mode)})
    rows = rows.withColumns({"__ratio": ratio(F.col("__up"), F.col("__down")), "gate_passed": F.size("gate_fail_reasons") == 0})
    rows = rows.withColumns({
        "expected_upside_pct": rounded(F.col("__up")),
        "expected_downside_pct": rounded(F.col("__down")),
        "risk_reward_ratio": rounded(F.col("__ratio")),
        "risk_reward_score": rounded(clamp(F.col("__ratio") * 35.0, 0, 100)),
        "recommendation": recommendation(
            F.col("investability_status"), F.col("potential_score"), F.col("valuation_gap_score"),
            F.col("gate_passed"), mode)})
    return rows.withColumns({
        "selection_score": selection_score(
            F.col("opportunity_score"), F.col("potential_score"), F.col("risk_reward_score"), red, mode),
        "staged_entry_plan": staged_entry_plan(
            F.col("entry_signal"), F.col("expected_upside_pct"), F.col("expected_downside_pct")),
        "action_note": action_note(
            F.col("sector_regime_label"), F.col("risk_reward_ratio"), F.col("gate_passed"), F.col("gate_fail_reasons")),
    }).drop("__up", "__down", "__ratio")


def with_ranks(ratings: DataFrame, large: bool | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ordinal rank and percentile by opportunity score within sector and basic industry (ties by ticker)."""
    if large is None:
        large = is_large(ratings, block_rows)
    key = F.struct((-F.col("opportunity_score")).alias("down"), F.col("ticker"))
    scored = F.col("opportunity_score").isNotNull()
    rows = ratings
    for group, prefix in (("sector", "sector"), ("basic_industry", "basic_industry")):
        # rows without a score rank in a group of their own, spread by ticker, and lose the rank again
        rows = rows.withColumn("__bin", F.when(scored, 0).otherwise(F.pmod(F.xxhash64("ticker"), F.lit(64)).cast("int") + 1))
        rows = ordinal_ranks(rows, [group, "__bin"], key, "__rank", "__n", large, block_rows)
        pct = F.when(F.col("__n") <= 1, 100.0).otherwise(
            rounded((F.lit(1.0) - (F.col("__rank") - 1) / (F.col("__n") - 1)) * 100.0))
        rows = rows.withColumn(f"{prefix}_rank", F.when(scored, F.col("__rank"))).withColumn(
            f"{prefix}_percentile", F.when(scored, pct)).drop("__bin", "__rank", "__n")
    return rows


def sector_top(leaderboard: DataFrame, limit: int = 10) -> DataFrame:
    """Best ``limit`` names per sector; the rank bound cuts rows per task before the shuffle."""
    w = Window.partitionBy("sector").orderBy(F.coalesce("opportunity_score", F.lit(0.0)).desc(), "ticker")
    return leaderboard.withColumn("sector_top_rank", F.row_number().over(w)).where(F.col("sector_top_rank") <= limit)


def portfolio_plan(leaderboard: DataFrame, max_names: int = S.PORTFOLIO_MAX_NAMES,
                   single: float = S.PORTFOLIO_MAX_SINGLE, sector: float = S.PORTFOLIO_MAX_SECTOR,
                   min_confidence: int = 1) -> DataFrame:
    """Best buy candidates under a sector cap, equally weighted.

    All candidates carry the same weight, so the greedy pick equals: the first floor(cap / weight)
    of each sector, then the first ``max_names`` of those.
    """
    weight = min(100.0 / max_names, single)
    per_sector = int((sector + 1e-9) // weight)
    best = [F.coalesce("selection_score", F.lit(0.0)).desc(), F.col("ticker")]
    picked = (
        leaderboard.where((F.col("recommendation") == "Buy Candidate") & (confidence_rank(F.col("confidence")) >= min_confidence))
        .withColumn("__pos", F.row_number().over(Window.partitionBy("sector").orderBy(*best)))
        .where(F.col("__pos") <= per_sector).drop("__pos")
        .orderBy(*best).limit(max_names)
    )
    share = F.lit(100.0) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # at most max_names rows
    return picked.withColumn("suggested_weight_pct", rounded(F.least(share, F.lit(single)))).withColumn(
        "risk_budget_note", F.lit(f"sector_cap={sector}%, single_cap={single}%"))

