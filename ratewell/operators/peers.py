"""Peer groups and winsorised peer-percentile scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.numeric import rounded
from ratewell.operators.ordered import (
    BLOCK_ROWS, between, cumulative_counts, is_large, match_groups, value_at, written)

LEVELS = ("Basic Industry", "Industry", "Sector")
TAXONOMY = ["basic_industry", "industry", "sector"]


def with_peer_level(entities: DataFrame, min_basic: int = S.PEER_MIN_BASIC_INDUSTRY,
                    min_industry: int = S.PEER_MIN_INDUSTRY, large: bool | None = None,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Resolve each entity's peer level (basic industry, else industry, else sector) and peer count.

    ``peer_groups`` lists every (level, value) group the entity is a member of *and* some entity
    is scored in; members that resolved at a finer level still count as peers there.  Group sizes
    come from one table of distinct label triples, not from windows over the entities.
    """
    if large is None:
        large = is_large(entities, block_rows)
    triples = entities.groupBy(*TAXONOMY).agg(F.count(F.lit(1)).alias("n_triple"))
    by_basic, by_industry, by_sector = (Window.partitionBy(c) for c in TAXONOMY)
    needs_industry = F.col("n_basic") < min_basic
    needs_sector = needs_industry & (F.col("n_industry") < min_industry)

    def pick(at_basic: Column, at_industry: Column, at_sector: Column) -> Column:
        return F.when(~needs_industry, at_basic).when(~needs_sector, at_industry).otherwise(at_sector)

    def group(level: str, column: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.col(column).alias("value"))

    levels = (
        triples.withColumn("n_basic", F.sum("n_triple").over(by_basic))
        .withColumn("n_industry", F.sum("n_triple").over(by_industry))
        .withColumn("industry_used", F.max(needs_industry).over(by_industry))
        .withColumn("n_sector", F.sum("n_triple").over(by_sector))
        .withColumn("sector_used", F.max(needs_sector).over(by_sector))
        .select(
            *TAXONOMY, "n_triple",
            pick(F.lit(LEVELS[0]), F.lit(LEVELS[1]), F.lit(LEVELS[2])).alias("peer_level"),
            pick(F.col("basic_industry"), F.col("industry"), F.col("sector")).alias("peer_value"),
            (pick(F.col("n_basic"), F.col("n_industry"), F.col("n_sector")) - 1).alias("n_peers"),
            F.array_compact(F.array(
                F.when(~needs_industry, group("Basic Industry", "basic_industry")),
                F.when(F.col("industry_used") & (F.col("n_industry") >= min_industry), group("Industry", "industry")),
                F.when(F.col("sector_used"), group("Sector", "sector")),
            )).alias("peer_groups"))
    )
    return match_groups(entities, levels, TAXONOMY, "n_triple", ["ticker"], large, block_rows).drop("n_triple")


def first_peers(entities: DataFrame, limit: int = 10, large: bool | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The first ``limit`` peers by ticker of each entity, without pairing up the group.

    Needs :func:`with_peer_level`; keeps the first limit + 1 members of each group, enough for
    every entity to leave itself out.
    """
    if large is None:
        large = is_large(entities, block_rows)
    members = entities.select("ticker", F.explode("peer_groups").alias("g")).select("ticker", "g.level", "g.value")
    # row_number with an upper bound is cut down per task before the shuffle
    firsts = (
        members.withColumn("pos", F.row_number().over(Window.partitionBy("level", "value").orderBy("ticker")))
        .where(F.col("pos") <= limit + 1)
        .groupBy(F.col("level").alias("peer_level"), F.col("value").alias("peer_value"))
        .agg(F.array_sort(F.collect_list("ticker")).alias("first_members"))
    )
    sizes = entities.groupBy("peer_level", "peer_value").agg(F.count(F.lit(1)).alias("resolved"))
    groups = sizes.join(firsts, ["peer_level", "peer_value"])
    listed = match_groups(entities, groups, ["peer_level", "peer_value"], "resolved", ["ticker"], large, block_rows)
    return listed.withColumn(
        "peers", F.slice(F.filter("first_members", lambda t: t != F.col("ticker")), 1, limit)
    ).drop("first_members", "resolved")


def _share(lower: Column, lo: Column, hi: Column, upto_lo: Column, below_hi: Column) -> Column:
    """Rounded share of the other winsorised values the own value beats or equals."""
    v, n = F.col("value"), F.col("n")
    at_most = (
        F.when(lo == hi, n).when(v >= hi, n).when(v <= lo, upto_lo).otherwise(F.col("upto")))
    at_least = (
        F.when(lo == hi, n).when(v <= lo, n).when(v >= hi, n - below_hi).otherwise(n - F.col("below")))
    hits = F.when(lower, at_least).otherwise(at_most)
    return F.when(n == 1, F.lit(S.NEUTRAL_SCORE)).otherwise(rounded((hits - 1) / (n - 1) * 100.0))


def peer_percentile(entities: DataFrame, metrics: DataFrame, lower_is_better: Sequence[str] = S.LOWER_IS_BETTER,
                    low: float = S.WINSOR_LOW, high: float = S.WINSOR_HIGH, large: bool | None = None,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Score (0..100, two decimals) of every (ticker, metric, value) within the ticker's peer group.

    ``entities`` comes from :func:`with_peer_level`.  A score is the share of the other winsorised
    values that are at or below the own one (at or above it for ``lower_is_better``); a value without
    peers scores 50.  Bounds and shares follow from counts below and up to each value, so no entity
    is ever paired with its peers.  Small inputs take one windowed shuffle; for large ones the counts
    of distinct values are built over key ranges (see :mod:`ratewell.operators.ordered`).
    """
    if large is None:
        large = is_large(entities, block_rows)
    lower = F.col("metric").isin(*lower_is_better)
    group = ["level", "level_value", "metric"]
    member = metrics.where(F.col("value").isNotNull()).join(
        entities.select("ticker", "peer_level", "peer_value", "peer_groups"), "ticker")
    at_low, at_high = F.lit(low) * (F.col("n") - 1), F.lit(high) * (F.col("n") - 1)

    if not large:
        whole = Window.partitionBy(*group)
        sorted_ = whole.orderBy("value")

        def at(position: Column, x: str) -> Column:
            return F.max(F.when(F.col("pos") == position, F.col(x))).over(whole)

        ranked = (
            member.select("*", F.explode("peer_groups").alias("g"))
            .select("ticker", "peer_level", "peer_value", F.col("g.level").alias("level"),
                    F.col("g.value").alias("level_value"), "metric", "value")
            .withColumn("n", F.count(F.lit(1)).over(whole))
            .withColumn("pos", F.row_number().over(sorted_) - 1)
            .withColumn("below", F.rank().over(sorted_) - 1)
            .withColumn("upto", F.count(F.lit(1)).over(sorted_.rangeBetween(Window.unboundedPreceding, 0)))
            .withColumn("a0", at(F.floor(at_low), "value")).withColumn("a1", at(F.ceil(at_low), "value"))
            .withColumn("b0", at(F.floor(at_high), "value")).withColumn("b1", at(F.ceil(at_high), "value"))
            .withColumn("upto_a0", at(F.floor(at_low), "upto"))
            .withColumn("below_b0", at(F.floor(at_high), "below"))
            .withColumn("below_b1", at(F.ceil(at_high), "below"))
            .where((F.col("level") == F.col("peer_level")) & (F.col("level_value") == F.col("peer_value")))
        )
        lo, hi = between(F.col("a0"), F.col("a1"), at_low), between(F.col("b0"), F.col("b1"), at_high)
        below_hi = F.when(hi > F.col("b0"), F.col("below_b1")).otherwise(F.col("below_b0"))
        return ranked.select("ticker", "peer_level", "peer_value", "metric", "value",
                             _share(lower, lo, hi, F.col("upto_a0"), below_hi).alias("score"))

    member = written(member, "member")
    long = member.select("metric", "value", F.explode("peer_groups").alias("g")).select(
        F.col("g.level").alias("level"), F.col("g.value").alias("level_value"), "metric", "value")
    counts = written(cumulative_counts(long, group, "value", True, block_rows), "counts")
    bounds = counts.groupBy(*group).agg(
        F.max("n").alias("n_group"),
        value_at(F.floor(at_low), "value").alias("a0"), value_at(F.ceil(at_low), "value").alias("a1"),
        value_at(F.floor(at_high), "value").alias("b0"), value_at(F.ceil(at_high), "value").alias("b1"),
        value_at(F.floor(at_low), "upto").alias("upto_a0"),
        value_at(F.floor(at_high), "below").alias("below_b0"), value_at(F.ceil(at_high), "below").alias("below_b1"))
    scored = match_groups(counts, bounds, group, "n_group", ["value"], True, block_rows)
    lo, hi = between(F.col("a0"), F.col("a1"), at_low), between(F.col("b0"), F.col("b1"), at_high)
    below_hi = F.when(hi > F.col("b0"), F.col("below_b1")).otherwise(F.col("below_b0"))
    scores = written(scored.select(
        F.col("level").alias("peer_level"), F.col("level_value").alias("peer_value"), "metric", "value", "cnt",
        _share(lower, lo, hi, F.col("upto_a0"), below_hi).alias("score")), "scores")
    own = member.select("ticker", "peer_level", "peer_value", "metric", "value")
    return match_groups(own, scores, ["peer_level", "peer_value", "metric", "value"], "cnt", ["ticker"], True,
                        block_rows).drop("cnt")
