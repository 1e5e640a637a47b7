"""The rating run: wide metric table in, ratings and leaderboard out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.operators.cards import score_maps, with_cards, with_composites
from ratewell.operators.ordered import BLOCK_ROWS, is_large, written
from ratewell.operators.overlays import market_mode, with_overlays, with_ranks
from ratewell.operators.peers import peer_percentile, with_peer_level
from ratewell.operators.quality import apply_template_support, template_quality

LEADERBOARD_EXCLUDED = ("Uninvestable", "Insufficient Data", "Unsupported Data")


def metrics_long(universe: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(ticker, metric, value) rows of the non-null metric cells."""
    names = metrics or S.configured_metrics()
    values = ", ".join(f"`{m}`" for m in names)
    labels = ", ".join(f"'{m}'" for m in names)
    # one array per row: a generic unpivot plans a projection per metric
    return universe.selectExpr("ticker", f"posexplode(array({values})) as (pos, value)").where(
        F.col("value").isNotNull()).selectExpr("ticker", f"array({labels})[pos] as metric", "value")


def score_universe(universe: DataFrame, large: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The universe with peer level, peer count and the metric -> score map of every entity."""
    entities = with_peer_level(
        universe.select("ticker", "basic_industry", "industry", "sector"), large=large, block_rows=block_rows)
    scored = peer_percentile(entities, metrics_long(universe), large=large, block_rows=block_rows)
    return universe.join(entities.select("ticker", "peer_level", "peer_value", "n_peers"), "ticker").join(
        score_maps(scored), "ticker", "left")


def rate_universe(universe: DataFrame, mode: str = "auto", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ratings of every entity of the wide metric table.

    The table and the card stage are written to the shared folder once: both are read by several
    later branches (peer groups, market mode, sector means), which would otherwise recompute the
    whole metric derivation.
    """
    universe = written(universe, "universe")
    large = is_large(universe, block_rows)
    regime = market_mode(universe, mode, large, block_rows).select("market_mode")
    rows = with_cards(score_universe(universe, large, block_rows))
    rows = written(with_composites(rows, regime.scalar()), "cards")
    return with_ranks(with_overlays(rows, large, block_rows), large, block_rows)


def flat(ratings: DataFrame) -> DataFrame:
    """Ratings with the card scores as plain columns under the card names."""
    return ratings.withColumns({c: F.col(f"card_{c}.score") for c in S.CARDS})


def leaderboard_order() -> list[Column]:
    return [F.coalesce("selection_score", F.lit(0.0)).desc(), F.coalesce("opportunity_score", F.lit(0.0)).desc(),
            F.col("ticker")]


def supported_leaderboard(ratings: DataFrame, universe: DataFrame, enforce: bool = True) -> DataFrame:
    """The leaderboard of a run: calls of templates whose cards cover too little are withdrawn first."""
    return leaderboard(apply_template_support(ratings, template_quality(universe), enforce))


def leaderboard(ratings: DataFrame, excluded: tuple[str, ...] = LEADERBOARD_EXCLUDED) -> DataFrame:
    """Flat rating rows without the excluded statuses, best selection score first (ties by ticker)."""
    columns = [
        "ticker", "name", "sector", "basic_industry", "template", "peer_level", *(
            "performance", "valuation", "growth", "profitability", "entry_point", "contrarian", "red_flags"),
        "opportunity_score", "investability_status", "potential_score", "valuation_gap_score", "recommendation",
        "confidence", "entry_signal", "market_mode", "sector_regime_score", "sector_regime_label",
        "drawdown_resilience_score", "valuation_confidence_score", "expected_upside_pct", "expected_downside_pct",
        "risk_reward_ratio", "risk_reward_score", "selection_score", "gate_passed", "gate_fail_reasons",
        "template_supported", "template_support_status", "template_support_reason", "staged_entry_plan",
        "action_note", "sector_rank", "sector_percentile", "basic_industry_rank", "basic_industry_percentile"]
    rows = flat(ratings)
    defaults = {"template_supported": F.lit(True), "template_support_status": F.lit("Supported"),
                "template_support_reasons": F.array().cast("array<string>")}
    rows = rows.withColumns({n: v for n, v in defaults.items() if n not in rows.columns})
    rows = rows.withColumn("gate_fail_reasons", F.array_join("gate_fail_reasons", "; ")).withColumn(
        "template_support_reason", F.array_join("template_support_reasons", "; "))
    keep = F.col("investability_status").isNull() | ~F.col("investability_status").isin(*excluded)
    return rows.where(keep).select(*columns).orderBy(*leaderboard_order())
