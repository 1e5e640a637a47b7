"""Score cards: weighted roll-up of metric scores with coverage rules, composites and caps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.bands import (
    confidence_label, entry_signal, investability, red_flag_cap, red_flag_status)
from ratewell.functions.formulas import base_recommendation, disqualifiers
from ratewell.functions.numeric import rounded, weighted_mean

INSUFFICIENT = "Insufficient data to score this card."


def title(name: str) -> str:
    return name.replace("_", " ").title()


def _weight_list(card: str, weights: Mapping) -> str:
    """SQL of the card's (metric, weight, title) list for the row's ``template``, in configured order."""
    cases = []
    for code, cards in weights.items():
        items = ", ".join(f"named_struct('m', '{m}', 'w', {float(w)!r}D, 't', '{title(m)}')"
                          for m, w in cards[card].items())
        cases.append(f"when '{code}' then array({items})")
    return f"case template {' '.join(cases)} end"


def _fold(card: str, scores: str, weights: Mapping) -> Column:
    """Total weight, weight with data, weighted sum, and the metric that contributes most.

    Weights are added in configured order, because a coverage of exactly the threshold depends on it.
    """
    s = f"try_element_at({scores}, x.m)"
    better = f"coalesce({s} * x.w > acc.best, false)"
    return F.expr(f"""aggregate({_weight_list(card, weights)},
        named_struct('total', 0D, 'seen', 0D, 'sum', 0D, 'best', -1D, 'title', '', 'top', 0D),
        (acc, x) -> named_struct(
            'total', acc.total + x.w,
            'seen', acc.seen + if(isnull({s}), 0D, x.w),
            'sum', acc.sum + coalesce({s} * x.w, 0D),
            'best', if({better}, {s} * x.w, acc.best),
            'title', if({better}, x.t, acc.title),
            'top', if({better}, {s}, acc.top)))""")


def _round_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5D) / 1e{digits}"


def _card_sql(card: str, fold: str, threshold: float) -> Column:
    rankable = f"({fold}.seen / {fold}.total >= {threshold!r}D and {fold}.seen > 0)"
    score = f"if({rankable}, {_round_sql(f'{fold}.sum / {fold}.seen', 2)}, null)"
    top = _round_sql(f"{fold}.top", 1)
    label = " ".join(f"when s >= {low} and (s < {high}{' or s = 100' if high == 100 else ''}) then '{text}'"
                     for low, high, text in S.CARD_LABELS[card]).replace("s >=", f"{score} >=").replace(
        "s <", f"{score} <").replace("s = 100", f"{score} = 100")
    return F.expr(f"""named_struct('score', {score}, 'label', case when not {rankable} then 'Unrankable' {label} end,
        'coverage', {_round_sql(f'{fold}.seen / {fold}.total', 3)}, 'rankable', {rankable},
        'reason', if({rankable}, format_string('Primary driver: %s scored %.1f/100 (%s relative to peers).',
            {fold}.title, {top}, if({top} >= 60, 'strong', 'weak')), '{INSUFFICIENT}'))""")


def with_card_structs(rows: DataFrame, scores: str = "scores", weights: Mapping = S.CARD_WEIGHTS,
                      threshold: float = S.CARD_COVERAGE_MIN) -> DataFrame:
    """Add ``card_<name>`` (score, label, coverage, rankable, reason) from the row's metric -> score map.

    Missing metrics drop out of the average instead of counting as zero.
    """
    folded = rows.withColumns({f"__fold_{c}": _fold(c, scores, weights) for c in S.CARDS})
    return folded.withColumns({f"card_{c}": _card_sql(c, f"__fold_{c}", threshold) for c in S.CARDS}).drop(
        *[f"__fold_{c}" for c in S.CARDS])


def sub_scores(card: str, scores: str = "scores", weights: Mapping = S.CARD_WEIGHTS) -> Column:
    """metric -> score map of one card; metrics without a score stay in it as null."""
    names = f"transform({_weight_list(card, weights)}, x -> x.m)"
    return F.expr(f"map_from_arrays({names}, transform({names}, m -> try_element_at({scores}, m)))")


def score_maps(scored: DataFrame) -> DataFrame:
    """One row per ticker with its metric -> score map (one entry per configured metric at most)."""
    return scored.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("scores"))


def with_cards(rows: DataFrame, weights: Mapping = S.CARD_WEIGHTS) -> DataFrame:
    """Add a struct column ``card_<name>`` per card; hard exclusions force the red-flag card to 15 / Severe.

    The exclusion leaves coverage and rankability of the red-flag card as they were, so a poorly
    covered one does not cap the opportunity score.
    """
    rows = with_card_structs(rows, weights=weights)
    triggered = disqualifiers(
        F.coalesce("asm_stage", F.lit(0)), F.coalesce("gsm_stage", F.lit(0)), F.col("interest_coverage"),
        F.col("credit_rating_grade").cast("int"), F.coalesce("pledge_pct", "promoter_pledge"), F.col("gnpa_pct"),
        F.col("nnpa_pct"), F.col("car_pct"), F.col("pcr_pct"), F.col("alm_st_pct"), F.col("avg_daily_turnover_cr"),
        F.col("governance_events"))
    rows = rows.withColumn("disqualifiers", triggered)
    hit = F.size("disqualifiers") > 0
    card = F.col("card_red_flags")
    return rows.withColumn("card_red_flags", F.struct(
        F.when(hit, F.lit(S.DISQUALIFIED_SCORE)).otherwise(card["score"]).alias("score"),
        F.when(hit, F.lit("Severe")).otherwise(card["label"]).alias("label"),
        card["coverage"].alias("coverage"), card["rankable"].alias("rankable"),
        F.when(hit, F.concat(F.lit("DISQUALIFIER triggered: "), F.array_join("disqualifiers", "; ")))
        .otherwise(card["reason"]).alias("reason")))


def _card(name: str, field: str) -> Column:
    return F.col(f"card_{name}.{field}")


def with_composites(rows: DataFrame, market_mode: Column) -> DataFrame:
    """Opportunity score with red-flag cap, status, strengths, potential and valuation-gap scores, first calls."""
    order = ("performance", "valuation", "growth", "profitability", "entry_point", "contrarian")
    n_rankable = sum((_card(c, "rankable").cast("int") for c in S.CARDS), F.lit(0))
    enough = n_rankable >= S.MIN_RANKABLE_CARDS
    bear = F.col("market_mode") == "bear"

    def blend(weights: Mapping) -> Column:
        mean = weighted_mean([(F.when(_card(c, "rankable"), _card(c, "score")), weights[c]) for c in order])
        return F.coalesce(rounded(mean), F.lit(0.0))

    raw = F.when(bear, blend(S.BEAR_OPPORTUNITY_WEIGHTS)).otherwise(blend(S.OPPORTUNITY_WEIGHTS))
    red = F.when(_card("red_flags", "rankable"), _card("red_flags", "score"))
    red_status = F.when(red.isNotNull(), red_flag_status(red))
    cap = F.when(red.isNotNull(), red_flag_cap(red))
    opportunity = F.when(enough, F.when(cap.isNotNull(), F.least(F.col("raw_score"), cap)).otherwise(F.col("raw_score")))
    status = (
        F.when(~enough, "Insufficient Data")
        .when(red_status == "Uninvestable", "Uninvestable")
        .when(red_status == "Avoid", "Avoid")
        .otherwise(investability(F.col("opportunity_score")))
    )
    ranked = F.array_sort(F.array_compact(F.array(*[
        F.when(_card(c, "rankable") & _card(c, "score").isNotNull(), F.struct(
            (-_card(c, "score")).alias("down"), F.lit(i).alias("i"),
            F.concat(F.lit(f"{title(c)}: "), _card(c, "label")).alias("text")))
        for i, c in enumerate([*order, "red_flags"])])))
    texts = F.when(enough, F.transform(F.col("ranked_cards"), lambda x: x["text"])).otherwise(
        F.array().cast("array<string>"))
    covered = weighted_mean([(F.when(_card(c, "rankable"), _card(c, "coverage")), 1.0) for c in S.CARDS])
    bonus = F.when(F.col("peer_level") == "Basic Industry", 10.0).when(F.col("peer_level") == "Industry", 5.0).otherwise(0.0)
    base_confidence = F.when(n_rankable > 0, covered * 100.0 + n_rankable * 4.0 + bonus)
    rows = rows.withColumns({
        "market_mode": market_mode,
        "n_rankable_cards": n_rankable,
        "ranked_cards": ranked,
        "potential_score": rounded(weighted_mean([(_card(c, "score"), w) for c, w in S.POTENTIAL_WEIGHTS.items()])),
        "valuation_gap_score": rounded(weighted_mean([(_card(c, "score"), w) for c, w in S.VALUATION_GAP_WEIGHTS.items()])),
        "entry_signal": entry_signal(_card("entry_point", "score")),
        "base_confidence_score": base_confidence})
    rows = rows.withColumn("raw_score", raw).withColumn("opportunity_score", opportunity)
    rows = rows.withColumns({
        "investability_status": status,
        "strengths": F.slice(texts, 1, 3),
        "weaknesses": F.slice(texts, F.greatest(F.size(texts) - 2, F.lit(1)), F.lit(3)),
        "base_confidence": confidence_label(F.col("base_confidence_score"))})
    return rows.withColumn("base_recommendation", base_recommendation(
        F.col("investability_status"), _card("red_flags", "score"), F.col("potential_score"),
        F.col("valuation_gap_score"))).drop("ranked_cards")


def cards_long(rows: DataFrame) -> DataFrame:
    """One row per ticker and card."""
    each = F.array(*[F.struct(F.lit(c).alias("card"), F.col(f"card_{c}").alias("c"))
                     for c in S.CARDS])
    return rows.select("ticker", "template", F.explode(each).alias("e")).select(
        "ticker", "template", "e.card", "e.c.score", "e.c.label", "e.c.coverage", "e.c.rankable", "e.c.reason")


def coverage_by_template(metrics_wide: DataFrame, weights: Mapping = S.CARD_WEIGHTS) -> DataFrame:
    """Mean weighted coverage and rankable share per template and card; empty templates keep zero rows."""
    names = S.configured_metrics()
    listed = ", ".join(f"'{m}', if(isnull(`{m}`), null, 1D)" for m in names)
    present = F.expr(f"map({listed})")
    rows = with_card_structs(metrics_wide.select("template", present.alias("have")), "have", weights)
    each = F.array(*[F.struct(F.lit(c).alias("card"), F.col(f"card_{c}.coverage").alias("coverage")) for c in S.CARDS])
    covered = rows.select("template", F.explode(each).alias("e")).select("template", "e.card", "e.coverage")
    found = covered.groupBy("template", "card").agg(
        F.sum(F.round(F.col("coverage") * 1000).cast("long")).alias("covered"),
        F.count(F.lit(1)).alias("n_stocks"),
        F.count_if(F.col("coverage") >= S.CARD_COVERAGE_MIN).alias("n_rankable"))
    grid = metrics_wide.sparkSession.createDataFrame(
        [(t, c) for t, cards in weights.items() for c in cards], "template string, card string")
    zero = F.lit(0)
    return grid.join(found, ["template", "card"], "left").select(
        "template", "card",
        F.coalesce(rounded(F.col("covered") / 1000.0 / F.col("n_stocks"), 3), F.lit(0.0)).alias("avg_coverage"),
        F.coalesce(rounded(F.col("n_rankable") / F.col("n_stocks") * 100.0), F.lit(0.0)).alias("rankable_pct"),
        F.coalesce("n_stocks", zero).alias("n_stocks"), F.coalesce("n_rankable", zero).alias("n_rankable"))
