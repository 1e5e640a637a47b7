"""Score-to-label and value-to-risk lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.numeric import band


def card_label(card: str, score: Column) -> Column:
    return F.when(score.isNull(), "Unrankable").otherwise(band(score, S.CARD_LABELS[card], closed_top=100.0))


def red_flag_status(score: Column) -> Column:
    return F.coalesce(band(score, S.RED_FLAG_CAPS, value=3, closed_top=100.0), F.lit("Avoid"))


def red_flag_cap(score: Column) -> Column:
    return band(score, [b for b in S.RED_FLAG_CAPS if b[2] is not None])


def investability(score: Column) -> Column:
    return (
        F.when((score >= 70) & (score <= 100), "Investable")
        .when((score >= 50) & (score <= 70), "Watchlist")
        .when((score >= 0) & (score <= 50), "Avoid")
    )


def entry_signal(score: Column) -> Column:
    return (
        F.when(score.isNull(), "Unknown")
        .when(score >= 75, "Accumulation Zone")
        .when(score >= 55, "Constructive Pullback")
        .when(score >= 40, "Neutral - Wait for Setup")
        .otherwise("Wait / Expensive Entry")
    )


def rsi_score(rsi: Column) -> Column:
    return F.when(rsi.isNotNull(), F.coalesce(band(rsi, S.RSI_SCORES), F.lit(5.0)))


def pledge_risk(pledge_pct: Column) -> Column:
    return F.when(pledge_pct.isNull(), F.lit(0.0)).otherwise(F.coalesce(band(pledge_pct, S.PLEDGE_RISK), F.lit(100.0)))


def liquidity_risk(turnover: Column, is_t2t: Column) -> Column:
    base = F.coalesce(band(turnover, S.LIQUIDITY_RISK), F.lit(100.0))
    extra = F.when(is_t2t, F.lit(20.0)).otherwise(F.lit(0.0))
    return F.when(turnover.isNull(), F.lit(70.0)).otherwise(F.least(base + extra, F.lit(100.0)))


def regime_label(score: Column) -> Column:
    return F.when(score >= 70, "Tailwind").when(score >= 55, "Constructive").when(score >= 40, "Mixed").otherwise(
        "Headwind"
    )


def confidence_label(score: Column) -> Column:
    return F.when(score >= S.CONFIDENCE_HIGH, "High").when(score >= S.CONFIDENCE_MEDIUM, "Medium").otherwise("Low")


def confidence_rank(label: Column) -> Column:
    text = F.lower(label)
    return F.when(text == "high", 2).when(text == "medium", 1).otherwise(0)


def thesis_label(score: Column, bands: list) -> Column:
    return F.when(score.isNull(), "insufficient data").otherwise(F.coalesce(band(score, bands), F.lit("unranked")))


def survivorship_severity(pct: Column) -> Column:
    return F.when(pct > 15, "Severe").when(pct > 8, "High").when(pct > 3, "Moderate").otherwise("Low")
