"""Views over ratings: sector summaries, action lists, distributions, documents, thesis text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.bands import thesis_label
from ratewell.functions.numeric import rounded
from ratewell.functions.taxonomy import template_name
from ratewell.functions.text import metric_name
from ratewell.operators.cards import sub_scores, title

BUY = "Buy Candidate"


def _mean_cents(column: str, zero_for_null: bool = False) -> Column:
    cell = F.coalesce(column, F.lit(0.0)) if zero_for_null else F.col(column)
    return F.sum(F.round(cell * 100).cast("long")) / 100.0 / F.count(cell)


def sector_summary(leaderboard: DataFrame) -> DataFrame:
    return leaderboard.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_stocks"), F.count_if(F.col("recommendation") == BUY).alias("n_buy_candidates"),
        rounded(_mean_cents("opportunity_score", True)).alias("avg_opportunity_score")).orderBy("sector")


def sector_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sector").agg(
        F.count("ticker").alias("n"), rounded(_mean_cents("opportunity_score"), 4).alias("avg_score"),
        F.max("opportunity_score").alias("top_score"), F.count_if(F.col("recommendation") == BUY).alias("buy_count"),
        F.count_if(F.col("gate_passed")).alias("n_gate_passed")).orderBy(F.desc_nulls_last("avg_score"), "sector")


def value_counts(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), column)
    return counted if limit is None else counted.limit(limit)


def histogram(rows: DataFrame, column: str, bins: int = 20, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Counts per equal-width bin; the top edge belongs to the last bin."""
    width = (high - low) / bins
    cell = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(column).isNotNull()).groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), "n")


def screen(rows: DataFrame, min_score: float = 0.0, gate_only: bool = False,
           recommendations: list[str] | None = None) -> DataFrame:
    """Interactive filter: null scores count as 0."""
    out = rows
    if min_score > 0:
        out = out.where(F.coalesce("opportunity_score", F.lit(0.0)) >= min_score)
    if gate_only:
        out = out.where(F.col("gate_passed"))
    if recommendations:
        out = out.where(F.col("recommendation").isin(*recommendations))
    return out


def by_tickers(rows: DataFrame, tickers: str) -> DataFrame:
    """Rows of a comma-separated ticker list."""
    wanted = [t.strip().upper() for t in tickers.split(",") if t.strip()]
    return rows.where(F.col("ticker").isin(*wanted)) if wanted else rows


def sorted_view(rows: DataFrame, column: str, limit: int = 100) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(column), "ticker").limit(limit)


def value_hunter(rows: DataFrame, min_red: float = 45, min_profit: float = 40, min_contrarian: float = 30,
                 limit: int | None = 30) -> DataFrame:
    def zero(c: str) -> Column:
        return F.coalesce(c, F.lit(0.0))

    out = rows.where((zero("red_flags") >= min_red) & (zero("profitability") >= min_profit)
                     & (zero("contrarian") >= min_contrarian)).withColumn("vh_score", rounded(
        zero("contrarian") * 0.50 + zero("valuation") * 0.25 + zero("profitability") * 0.25, 1)).orderBy(
        F.desc("vh_score"), "ticker")
    return out if limit is None else out.limit(limit)


def buy_candidates(leaderboard: DataFrame) -> DataFrame:
    return leaderboard.where((F.col("recommendation") == BUY) & (F.col("investability_status") == "Investable"))


def undervalued(leaderboard: DataFrame, limit: int = 200) -> DataFrame:
    return leaderboard.where(F.col("potential_score").isNotNull() & F.col("valuation_gap_score").isNotNull()).orderBy(
        F.desc("valuation_gap_score"), F.desc("potential_score"),
        F.coalesce("opportunity_score", F.lit(0.0)).desc(), "ticker").limit(limit)


def red_flag_exclusions(leaderboard: DataFrame) -> DataFrame:
    return leaderboard.where((F.col("red_flags") < 40) | F.col("investability_status").isin(
        "Uninvestable", "Avoid", "Unsupported Data"))


def top_picks(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Gate-passing buy candidates for the daily message."""
    best = F.when(F.coalesce("selection_score", F.lit(0.0)) != 0, F.col("selection_score")).otherwise(
        F.coalesce("opportunity_score", F.lit(0.0)))
    return rows.where(F.col("gate_passed") & (F.col("recommendation") == BUY)).orderBy(best.desc(), "ticker").limit(limit)


def top_n_only(rows: DataFrame, leaderboard: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` tickers of the leaderboard order."""
    from ratewell.plans.rating import leaderboard_order

    first = leaderboard.orderBy(*leaderboard_order()).limit(n).select("ticker")
    return rows.join(F.broadcast(first), "ticker", "left_semi")  # n rows


def action_sheet(ratings: DataFrame) -> DataFrame:
    reasons = F.array_join("template_support_reasons", "; ") if "template_support_reasons" in ratings.columns else F.lit("")
    supported = F.col("template_supported") if "template_supported" in ratings.columns else F.lit(True)
    state = F.col("template_support_status") if "template_support_status" in ratings.columns else F.lit("Supported")
    return ratings.select(
        "ticker", "name", "sector", "template", supported.alias("template_supported"),
        state.alias("template_support_status"), reasons.alias("template_support_reason"), "investability_status",
        "recommendation", "confidence", "market_mode", F.col("sector_regime_label").alias("sector_regime"),
        "selection_score", "potential_score", "valuation_gap_score", "expected_upside_pct", "expected_downside_pct",
        "risk_reward_ratio", "entry_signal", "staged_entry_plan", "gate_passed",
        F.array_join("gate_fail_reasons", "; ").alias("gate_fail_reasons"), "action_note",
    ).orderBy(F.coalesce("selection_score", F.lit(0.0)).desc(), "ticker")


def card_coverage(cards: DataFrame) -> DataFrame:
    """Rankable share per card over cards_long rows."""
    return cards.groupBy("card").agg(
        rounded(F.count_if("rankable") / F.count(F.lit(1)) * 100.0, 1).alias("rankable_pct"), F.count(F.lit(1)).alias("total"))


# --- documents -------------------------------------------------------------------------------
def documents(ratings: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """One nested record per rating (struct column ``document``); all seven cards are included."""
    rows = ratings if peers is None else ratings.join(peers.select("ticker", "peers"), "ticker", "left")
    tickers = F.col("peers") if peers is not None else F.array().cast("array<string>")

    def block(card: str) -> Column:
        c = F.col(f"card_{card}")
        return F.struct(
            c["score"].alias("score"), c["label"].alias("label"),
            F.format_string("%.1f%%", rounded(c["coverage"] * 100.0, 1)).alias("data_coverage"),
            c["rankable"].alias("is_rankable"), c["reason"].alias("reason"),
            sub_scores(card).alias("sub_scores")).alias(card)

    plain = ["investability_status", "potential_score", "valuation_gap_score", "recommendation",
             F.col("confidence").alias("recommendation_confidence"), "entry_signal", "market_mode",
             "sector_regime_score", "sector_regime_label", "drawdown_resilience_score", "valuation_confidence_score",
             "expected_upside_pct", "expected_downside_pct", "risk_reward_ratio", "risk_reward_score",
             "selection_score", F.col("gate_passed").alias("investability_gate_passed"), "gate_fail_reasons",
             "staged_entry_plan", "action_note"]
    document = F.struct(
        F.col("name").alias("stock_name"), "ticker",
        F.struct("macro_sector", "sector", "industry", "basic_industry").alias("classification"),
        F.concat(F.lit("Template "), "template", F.lit(" ("), template_name(F.col("template")), F.lit(")")).alias("template_used"),
        F.struct(F.col("peer_level").alias("level"), "n_peers", tickers.alias("tickers")).alias("peer_group"),
        F.struct(*[block(c) for c in S.CARDS]).alias("cards"),
        F.col("opportunity_score").alias("final_opportunity_score"), *plain,
        F.struct("sector_rank", "sector_percentile", "basic_industry_rank", "basic_industry_percentile").alias("ranks"),
        F.struct(F.col("strengths").alias("top_3_strengths"), F.col("weaknesses").alias("top_3_weaknesses")).alias("summary"))
    return rows.select("ticker", document.alias("document"))


def document_json(docs: DataFrame) -> DataFrame:
    return docs.select("ticker", F.to_json("document", {"ignoreNullFields": "false"}).alias("json"))


def document_rows(docs_json: DataFrame) -> DataFrame:
    """Flat dashboard rows read back out of the JSON documents by path."""
    from ratewell.functions.text import normal_recommendation

    def at(path: str, kind: str = "string") -> Column:
        return F.get_json_object("json", f"$.{path}").cast(kind)

    return docs_json.select(
        F.coalesce(at("ticker"), F.lit("")).alias("ticker"), F.coalesce(at("stock_name"), F.lit("")).alias("name"),
        F.coalesce(at("classification.sector"), F.lit("")).alias("sector"),
        F.coalesce(at("classification.basic_industry"), F.lit("")).alias("industry"),
        at("final_opportunity_score", "double").alias("score"), at("selection_score", "double").alias("selection"),
        normal_recommendation(at("recommendation")).alias("recommendation"),
        F.coalesce(at("entry_signal"), F.lit("")).alias("entry_signal"),
        *[at(f"cards.{c}.score", "double").alias(c) for c in S.CARDS],
        at("expected_upside_pct", "double").alias("upside_pct"), at("risk_reward_ratio", "double").alias("risk_reward"),
        F.coalesce(at("market_mode"), F.lit("")).alias("market_mode"),
        F.coalesce(at("investability_gate_passed", "boolean"), F.lit(False)).alias("gate_passed"))


# --- thesis ----------------------------------------------------------------------------------
THESIS_CARDS = ("performance", "valuation", "growth", "profitability", "entry_point")
CARD_PHRASES = {"performance": "price performance", "valuation": "valuation", "growth": "growth trajectory",
                "profitability": "profitability", "entry_point": "entry timing"}


def ranked_metrics(scores: Column, best: bool, limit: int) -> Column:
    """First ``limit`` (metric, score) entries of a score map, best or worst first; nulls left out."""
    kept = F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull())
    keyed = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), lambda i: F.struct(
        (F.try_element_at(kept, i)["value"] * (-1.0 if best else 1.0)).alias("k"), i.alias("i"),
        F.try_element_at(kept, i)["key"].alias("metric"), F.try_element_at(kept, i)["value"].alias("score"))))
    return F.slice(F.filter(keyed, lambda e: e["metric"].isNotNull()), 1, limit)


def _whole(x: Column) -> Column:
    return F.format_string("%.0f", F.rint(x))


def _named(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.concat(metric_name(e["metric"]), F.lit(" ("), _whole(e["score"]), F.lit(")")))


def with_thesis(ratings: DataFrame) -> DataFrame:
    """Add the thesis text and its strengths, weaknesses and top metrics."""
    def score(card: str) -> Column:
        return F.col(f"card_{card}.score")

    rows = ratings.withColumns({f"__sub_{c}": sub_scores(c) for c in (*THESIS_CARDS, "red_flags")})
    ordered = F.array_sort(F.array_compact(F.array(*[
        F.when(score(c).isNotNull(), F.struct(
            (-score(c)).alias("k"), F.lit(i).alias("i"), F.lit(CARD_PHRASES[c]).alias("phrase"), score(c).alias("s"),
            _named(ranked_metrics(F.col(f"__sub_{c}"), True, 2)).alias("drivers")))
        for i, c in enumerate(THESIS_CARDS)])))
    rows = rows.withColumn("__best", F.try_element_at(ordered, F.lit(1)))
    opp, red, up, rr = F.col("opportunity_score"), score("red_flags"), F.col("expected_upside_pct"), F.col("risk_reward_ratio")
    label = thesis_label(opp, S.THESIS_SCORE)
    place = F.when(F.col("basic_industry") != "", F.col("basic_industry")).otherwise(F.col("sector"))
    risks = _named(F.filter(ranked_metrics(F.col("__sub_red_flags"), False, 2), lambda e: e["score"] < 50))
    article = F.when(opp.isNotNull(), F.concat(
        F.col("name"), F.lit(" ("), F.col("ticker"), F.lit(") scores "), F.format_string("%.1f", opp),
        F.lit("/100 overall — an "), label, F.lit(" opportunity in the "), place, F.lit(" space.")))
    parts = [
        article,
        F.when(F.col("__best").isNotNull(), F.concat(
            F.lit("Its strongest suit is "), F.col("__best.phrase"), F.lit(" ("), _whole(F.col("__best.s")),
            F.lit("/100), driven by "), F.array_join("__best.drivers", " and "), F.lit("."))),
        F.when(score("valuation").isNotNull(), F.concat(
            F.lit("Valuation looks "), thesis_label(score("valuation"), S.THESIS_VALUATION), F.lit(" ("),
            _whole(score("valuation")), F.lit("/100)."))),
        F.when(score("growth").isNotNull(), F.concat(
            F.lit("Growth profile: "), thesis_label(score("growth"), S.THESIS_GROWTH), F.lit(" ("),
            _whole(score("growth")), F.lit("/100)."))),
        F.when(red.isNotNull(), F.concat(
            F.lit("Risk assessment: "), thesis_label(red, S.THESIS_RISK), F.lit(" ("), _whole(red), F.lit("/100)"),
            F.when(F.size(risks) > 0, F.concat(F.lit(" — watch "), F.array_join(risks, ", "))).otherwise(""), F.lit("."))),
        F.when(score("entry_point").isNotNull(), F.concat(
            F.lit("Entry timing: "), thesis_label(score("entry_point"), S.THESIS_ENTRY), F.lit(" ("),
            _whole(score("entry_point")), F.lit("/100)."))),
        F.when(up.isNotNull() & rr.isNotNull(), F.concat(
            F.lit("Expected upside of "), F.format_string("%.1f", up), F.lit("% with a "),
            F.when(rr > 1.5, "favorable").when(rr > 1.0, "acceptable").otherwise("unfavorable"),
            F.lit(" risk-reward ratio of "), F.format_string("%.2f", rr), F.lit("."))),
        F.when(F.col("market_mode") != "neutral", F.concat(
            F.lit("Note: market is currently in "), F.col("market_mode"), F.lit(" mode."))),
    ]
    strong = F.array_compact(F.array(*[F.when(score(c) >= 65, F.concat(
        F.lit(f"{title(c)}: "), _whole(score(c)), F.lit("/100"))) for c in THESIS_CARDS]))
    weak = F.array_compact(F.array(*[F.when(score(c) < 35, F.concat(
        F.lit(f"{title(c)}: "), _whole(score(c)), F.lit("/100"))) for c in THESIS_CARDS]))
    tops = F.array_sort(F.array_compact(F.array(*[
        F.when(F.try_element_at(ranked_metrics(F.col(f"__sub_{c}"), True, 1), F.lit(1))["score"] >= 70, F.struct(
            (-F.try_element_at(ranked_metrics(F.col(f"__sub_{c}"), True, 1), F.lit(1))["score"]).alias("k"),
            F.lit(i).alias("i"),
            metric_name(F.try_element_at(ranked_metrics(F.col(f"__sub_{c}"), True, 1), F.lit(1))["metric"]).alias("name")))
        for i, c in enumerate(THESIS_CARDS)])))
    return rows.withColumn("thesis", F.concat_ws(" ", *parts)).withColumn(
        "thesis_strengths", F.slice(strong, 1, 5)).withColumn("thesis_weaknesses", F.slice(weak, 1, 5)).withColumn(
        "thesis_top_metrics", F.transform(tops, lambda t: t["name"])).drop(
        "__best", *[f"__sub_{c}" for c in (*THESIS_CARDS, "red_flags")])
