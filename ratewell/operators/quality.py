"""Coverage, completeness and publishing gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.numeric import rounded
from ratewell.functions.text import is_missing
from ratewell.operators.cards import coverage_by_template


def _per_core_card(coverage: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Wide rankable percentages of the core cards and the red-flag card."""
    def pct(card: str) -> Column:
        stocks = F.sum(F.when(F.col("card") == card, F.col("n_stocks")))
        ranked = F.sum(F.when(F.col("card") == card, F.col("n_rankable")))
        return F.when(stocks > 0, rounded(ranked / stocks * 100.0)).otherwise(0.0)

    return coverage.groupBy(*groups).agg(
        F.max("n_stocks").alias("n_stocks"), *[pct(c).alias(c) for c in (*S.CORE_CARDS, "red_flags")])


def _core_mean() -> Column:
    return rounded(sum((F.col(c) for c in S.CORE_CARDS), F.lit(0.0)) / len(S.CORE_CARDS))


def _core_count() -> Column:
    return sum(((F.col(c) > 0).cast("int") for c in S.CORE_CARDS), F.lit(0))


def input_quality(universe: DataFrame, gates: dict = S.INPUT_GATES) -> DataFrame:
    """One row: size, core-card coverage, classification coverage and the blocker messages."""
    coverage = coverage_by_template(universe)
    core = _per_core_card(coverage, []).select(
        *S.CORE_CARDS, _core_mean().alias("avg_core_rankable_pct"), _core_count().alias("n_core_cards_with_rankable"))
    labels = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("sector", "industry", "basic_industry")]
    classified = F.lit(True)
    for x in labels:
        classified = classified & ~x.isin("", "diversified")
    counts = universe.agg(F.count(F.lit(1)).alias("n_symbols_loaded"), F.count_if(classified).alias("n_symbols_classified"))
    both = counts.withColumn("core", core.select(F.struct("*").alias("c")).scalar()).select(
        "n_symbols_loaded", "n_symbols_classified", "core.*",
        F.when(F.col("n_symbols_loaded") > 0, rounded(
            F.col("n_symbols_classified") / F.col("n_symbols_loaded") * 100.0)).otherwise(0.0).alias(
            "classification_coverage_pct"))
    n, pct = F.col("n_symbols_loaded"), F.col("avg_core_rankable_pct")
    cards, cls = F.col("n_core_cards_with_rankable"), F.col("classification_coverage_pct")
    messages = F.array_compact(F.array(
        F.when(n < gates["min_universe"], F.format_string(f"Universe too small (%d < {gates['min_universe']}).", n)),
        F.when(pct < gates["min_core_pct"], F.concat(
            F.lit("Core coverage too low ("), F.format_string("%.2f", pct), F.lit(f"% < {gates['min_core_pct']}%)."))),
        F.when(cards < gates["min_core_cards"], F.format_string(
            f"Too few core cards have any rankable stocks (%d < {gates['min_core_cards']}).", cards)),
        F.when(cls < gates["min_classified_pct"], F.concat(
            F.lit("Classification coverage too low ("), F.format_string("%.2f", cls),
            F.lit(f"% < {gates['min_classified_pct']}%).")))))
    return both.withColumn("blockers", messages)


def template_quality(universe: DataFrame) -> DataFrame:
    """Per template: coverage of the core and red-flag cards, blockers, and whether it is supported."""
    wide = _per_core_card(coverage_by_template(universe), ["template"]).withColumn(
        "avg_core_rankable_pct", _core_mean()).withColumn("n_core_cards_with_rankable", _core_count())
    active = F.col("n_stocks") > 0

    def pct(value: Column) -> Column:
        return F.format_string("%.2f", value)

    messages = F.array_compact(F.array(
        F.when(F.col("avg_core_rankable_pct") < S.TEMPLATE_CORE_MIN, F.concat(
            F.lit("avg core rankable% too low ("), pct(F.col("avg_core_rankable_pct")), F.lit(f"% < {S.TEMPLATE_CORE_MIN}%)"))),
        F.when(F.col("n_core_cards_with_rankable") < len(S.CORE_CARDS), F.format_string(
            f"too few core cards rankable (%d < {len(S.CORE_CARDS)})", F.col("n_core_cards_with_rankable"))),
        *[F.when(F.col(c) < S.TEMPLATE_CARD_MIN, F.concat(
            F.lit(f"{c} rankable% too low ("), pct(F.col(c)), F.lit(f"% < {S.TEMPLATE_CARD_MIN}%)")))
          for c in S.CORE_CARDS],
        F.when(F.col("red_flags") < S.TEMPLATE_RED_FLAG_MIN, F.concat(
            F.lit("red_flags rankable% too low ("), pct(F.col("red_flags")), F.lit(f"% < {S.TEMPLATE_RED_FLAG_MIN}%)")))))
    return wide.withColumn("blockers", F.when(active, messages).otherwise(F.array().cast("array<string>"))).select(
        "template", active.alias("active"), (active & (F.size("blockers") == 0)).alias("supported"), "n_stocks",
        "avg_core_rankable_pct", "n_core_cards_with_rankable", F.col("red_flags").alias("red_flags_rankable_pct"), "blockers")


def apply_template_support(ratings: DataFrame, quality: DataFrame, enforce: bool = True) -> DataFrame:
    """Mark ratings of unsupported templates and, when enforced, withdraw their recommendation.

    The quality table has one row per template (three), so broadcasting it is bounded.
    """
    q = quality.select("template", F.col("supported").alias("template_supported"), F.col("blockers").alias("__b"))
    rows = ratings.join(F.broadcast(q), "template", "left")
    ok = F.coalesce("template_supported", F.lit(False))
    reasons = F.coalesce("__b", F.array().cast("array<string>"))
    rows = rows.withColumn("template_supported", ok).withColumn("template_support_reasons", reasons).withColumn(
        "template_support_status", F.when(F.col("template_supported"), "Supported").otherwise(
            "Unsupported Template Coverage")).drop("__b")
    bad = ~F.col("template_supported")
    text = F.array_join("template_support_reasons", "; ")
    if not enforce:
        return rows.withColumn("action_note", F.when(bad, F.concat_ws(
            "; ", "action_note", F.concat(F.lit("Template unsupported (debug only): "), text))).otherwise(F.col("action_note")))
    return (
        rows.withColumn("investability_status", F.when(bad, "Unsupported Data").otherwise(F.col("investability_status")))
        .withColumn("recommendation", F.when(bad, "Unsupported").otherwise(F.col("recommendation")))
        .withColumn("gate_passed", F.col("gate_passed") & ~bad)
        .withColumn("gate_fail_reasons", F.when(bad, F.array_distinct(F.concat(
            "gate_fail_reasons", "template_support_reasons"))).otherwise(F.col("gate_fail_reasons")))
        .withColumn("action_note", F.when(bad, F.concat(F.lit("Template unsupported: "), text)).otherwise(F.col("action_note")))
    )


def unsupported(ratings: DataFrame) -> DataFrame:
    return ratings.where(~F.col("template_supported")).select(
        "ticker", "name", "template", "sector", "basic_industry",
        F.col("template_support_status").alias("support_status"),
        F.array_join("template_support_reasons", "; ").alias("support_reason"), "investability_status",
        "recommendation").orderBy("template", "ticker")


def completeness(df: DataFrame, columns: Sequence[str] | None = None, blank_is_missing: bool = False) -> DataFrame:
    """Share of filled cells per column, in one pass over the table."""
    names = list(columns or df.columns)

    def filled(c: str) -> Column:
        cell = F.col(f"`{c}`")
        return F.count_if(~is_missing(cell.cast("string"))) if blank_is_missing else F.count(cell)

    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[filled(c).alias(f"__c{i}") for i, c in enumerate(names)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__c{i}").alias("n_filled")) for i, c in enumerate(names)])
    return wide.select("__rows", F.explode(each).alias("e")).select(
        "e.column_name", "e.n_filled", F.col("__rows").alias("n_rows"),
        F.when(F.col("__rows") > 0, rounded(F.col("e.n_filled") / F.col("__rows") * 100.0, 1)).otherwise(0.0).alias("filled_pct"))


def taxonomy_coverage(universe: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percentage of non-missing labels per taxonomy column."""
    return completeness(universe, columns, blank_is_missing=True).select(
        "column_name", F.when(F.col("n_rows") > 0, rounded(F.col("n_filled") / F.col("n_rows") * 100.0)).otherwise(0.0).alias("filled_pct"))


def enrichment_gain(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled cells per column before and after an enrichment step."""
    known = [c for c in columns if c in before.columns]
    old = completeness(before, known).select("column_name", F.col("n_filled").alias("n_before"))
    new = completeness(after, columns).select("column_name", F.col("n_filled").alias("n_after"))
    return new.join(old, "column_name", "left").select(
        "column_name", F.coalesce("n_before", F.lit(0)).alias("n_before"), "n_after",
        (F.col("n_after") - F.coalesce("n_before", F.lit(0))).alias("improvement"))


def freshness(latest: DataFrame, run_date, max_age: dict[str, int], default_age: int = 7) -> DataFrame:
    """Status per source from (source, n_rows, latest_date): ok, stale or empty."""
    limit = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in max_age.items() for x in kv]), F.col("source")),
        F.lit(default_age))
    age = F.datediff(F.lit(run_date).cast("date"), F.col("latest_date"))
    return latest.select(
        "source", "n_rows", "latest_date", age.alias("age_days"),
        F.when(F.col("n_rows") == 0, "empty").when(age <= limit, "ok").otherwise("stale").alias("status"))


def check_weights(weights: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Violations in a (template, card, metric, weight) table: sums away from 1, cards missing per template."""
    sums = weights.groupBy("template", "card").agg(F.sum("weight").alias("total")).where(
        F.abs(F.col("total") - 1.0) > tolerance).select(
        "template", "card", F.format_string("weights sum to %.6f", "total").alias("problem"))
    held = weights.groupBy("template").agg(F.collect_set("card").alias("cards"))
    gaps = held.select("template", F.explode(F.array_except(
        F.array(*[F.lit(c) for c in S.CARDS]), "cards")).alias("card")).withColumn("problem", F.lit("card missing"))
    return sums.unionByName(gaps)


def unknown_metrics(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """Metrics of a long table that no card weighs."""
    return metrics.groupBy("metric").agg(F.count(F.lit(1)).alias("n_rows")).join(
        weights.select("metric").distinct(), "metric", "left_anti")
