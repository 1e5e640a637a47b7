"""Metrics over fiscal-year and quarter series: a handful of rows per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.functions.formulas import cagr, share_positive, stability, yoy_growth
from ratewell.functions.numeric import ratio, rounded


def growth_metrics(facts: DataFrame, value: str) -> DataFrame:
    """Latest value, YoY and 3-year growth (percent) and growth stability of the last five years.

    Years without a value are dropped before years are paired, so a gap is bridged.
    """
    years = Window.partitionBy("entity").orderBy("fy")
    back = Window.partitionBy("entity").orderBy(F.desc("fy"))
    rows = (
        facts.where(F.col(value).isNotNull())
        .withColumn("back", F.row_number().over(back) - 1)
        .withColumn("before", F.lag(value).over(years))
        .withColumn("rate", F.when((F.col("before") > 0) & (F.col("back") < 4), F.col(value) / F.col("before") - 1.0))
    )
    folded = rows.groupBy("entity").agg(
        F.least(F.count(F.lit(1)), F.lit(5)).alias("n_values"),
        *[F.max(F.when(F.col("back") == k, F.col(value))).alias(f"fy{k}") for k in (0, 1, 3)],
        F.count("rate").alias("n_rates"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("std"))
    return folded.select(
        "entity", F.col("fy0").alias("latest"),
        rounded(yoy_growth(F.col("fy0"), F.col("fy1")) * 100.0).alias("growth_yoy"),
        rounded(cagr(F.col("fy0"), F.col("fy3"), 3) * 100.0).alias("cagr_3y"),
        rounded(stability(F.col("n_values"), F.col("n_rates"), F.col("mean"), F.col("std"))).alias("growth_stability"))


def margin_trend(facts: DataFrame, margin: str, years: int = 3) -> DataFrame:
    """Slope of the margin on the year over the entity's last ``years`` fiscal years; flat margins give 0."""
    latest = Window.partitionBy("entity")
    rows = facts.withColumn("x", (F.col("fy") - F.max("fy").over(latest) + years - 1).cast("double")).where(
        (F.col("x") >= 0) & F.col(margin).isNotNull())
    folded = rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(margin).alias("std"), F.regr_slope(margin, "x").alias("slope"))
    return folded.select("entity", F.when(
        F.col("n") >= 2, F.when(F.col("std") < 1e-9, 0.0).otherwise(F.col("slope"))).alias("margin_trend"))


def positive_share(facts: DataFrame, value: str, years: int = 5) -> DataFrame:
    """Share of the last ``years`` non-null years with a strictly positive value (at least three)."""
    back = Window.partitionBy("entity").orderBy(F.desc("fy"))
    rows = facts.where(F.col(value).isNotNull()).withColumn("back", F.row_number().over(back)).where(
        F.col("back") <= years)
    folded = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > 0).alias("up"))
    return folded.select("entity", rounded(share_positive(F.col("up"), F.col("n")), 1).alias("fcf_consistency"))


def annual_values(values, headers):
    """Array expression: the values whose header does not mention TTM (first header labels the row)."""
    labelled = F.zip_with(values, F.slice(headers, F.lit(2), F.size(values)), lambda v, h: F.struct(
        v.alias("v"), h.alias("h")))
    return F.transform(F.filter(labelled, lambda p: ~F.coalesce(F.upper(p["h"]).contains("TTM"), F.lit(False))),
                       lambda p: p["v"])


def quarterly_growth(quarters: DataFrame, value: str) -> DataFrame:
    """Trailing-year and single-quarter growth on a gapless (entity, quarter ordinal, value) table, latest quarter."""
    q = Window.partitionBy("entity").orderBy("quarter")
    last = Window.partitionBy("entity").orderBy(F.desc("quarter"))
    rows = (
        quarters.withColumn("ttm", F.when(
            F.count(value).over(q.rowsBetween(-3, 0)) == 4, F.sum(value).over(q.rowsBetween(-3, 0))))
        .withColumn("prior_ttm", F.lag("ttm", 4).over(q))
        .withColumn("year_ago", F.lag(value, 4).over(q))
        .withColumn("back", F.row_number().over(last))
        .where(F.col("back") == 1)
    )
    return rows.select(
        "entity", "quarter", "ttm",
        rounded(yoy_growth(F.col("ttm"), F.col("prior_ttm")) * 100.0).alias("ttm_growth"),
        rounded(yoy_growth(F.col(value), F.col("year_ago")) * 100.0, 1).alias("quarter_growth"))


def balance_ratios(facts: DataFrame) -> DataFrame:
    """Balance-sheet and cash-flow ratios of the latest year and the year before.

    Expects entity, fy, sales, pat, borrowings, equity, current_assets, current_liabilities,
    fixed_assets, total_assets, cfo, cfi, market_cap.
    """
    w = Window.partitionBy("entity").orderBy("fy")
    back = Window.partitionBy("entity").orderBy(F.desc("fy"))

    def positive_ratio(a: str, b: str):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    rows = (
        facts.withColumn("debt_to_equity", rounded(positive_ratio("borrowings", "equity")))
        .withColumn("current_ratio", rounded(positive_ratio("current_assets", "current_liabilities")))
        .withColumn("asset_turnover", rounded(positive_ratio("sales", "total_assets")))
        .withColumn("roa", rounded(positive_ratio("pat", "total_assets") * 100.0))
        .withColumn("fcf", F.col("cfo") + F.col("cfi"))
    )
    for name in ("debt_to_equity", "current_ratio", "asset_turnover", "roa"):
        rows = rows.withColumn(f"{name}_fy1", F.lag(name).over(w))
    rows = rows.withColumn("gross_block_fy3", F.lag("fixed_assets", 3).over(w)).withColumn(
        "back", F.row_number().over(back)).where(F.col("back") == 1)
    return rows.select(
        "entity", "fy", "debt_to_equity", F.col("debt_to_equity_fy1").alias("de_fy1"), "current_ratio",
        "current_ratio_fy1", "asset_turnover", "asset_turnover_fy1", "roa", "roa_fy1",
        F.col("fixed_assets").alias("gross_block_fy0"), "gross_block_fy3", "fcf",
        F.when(F.col("market_cap") > 0, rounded(F.col("fcf") / F.col("market_cap") * 100.0)).alias("fcf_yield"),
        rounded(ratio(F.col("cfo"), F.col("pat"))).alias("cfo_pat_ratio"))
