"""Forward returns of past recommendations and what they add up to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.numeric import rounded
from ratewell.operators.asof import nearest_day_join
from ratewell.operators.ordered import BLOCK_ROWS, cumulative_counts, value_at


def nearest_price(targets: DataFrame, bars: DataFrame, tolerance: int = 5) -> DataFrame:
    """Distinct targets (ticker, target_date) with the close nearest to the date, later dates first at equal distance.

    Targets without a close within ``tolerance`` days have a null price and date.
    """
    closes = bars.where(F.col("close").isNotNull()).select("ticker", "date", F.col("close").alias("price"))
    wanted = targets.select("ticker", "target_date").distinct()
    return nearest_day_join(wanted, closes, ["ticker"], "target_date", "date", ["price"], tolerance).select(
        "ticker", "target_date", "price", F.col("near_day").alias("price_date"))


def forward_returns(recs: DataFrame, bars: DataFrame, horizons: Mapping[str, int] = S.BACKTEST_HORIZONS,
                    tolerance: int = 5) -> DataFrame:
    """One row per recommendation with an entry price, and its percent return per horizon.

    Horizons are trading days, turned into int(1.5 x days) calendar days.  A recommendation is one row per date it
    asks a price for, on the time line of its ticker; the entry row carries its columns, so nothing is joined back.
    All runs are handled in one job; recs need unique (run_date, ticker).
    """
    own = F.struct(*recs.columns)
    legs = F.array(F.struct(F.lit("entry").alias("leg"), F.lit(0).alias("days"), own.alias("rec")), *[
        F.struct(F.lit(name).alias("leg"), F.lit(int(days * 1.5)).alias("days"),
                 F.lit(None).cast(recs.select(own.alias("r")).schema["r"].dataType).alias("rec"))
        for name, days in horizons.items()])
    targets = recs.select("run_date", "ticker", F.explode(legs).alias("l")).select(
        "run_date", "ticker", "l.leg", "l.rec", F.date_add("run_date", F.col("l.days")).alias("target_date"))
    closes = bars.where(F.col("close").isNotNull()).select("ticker", "date", F.col("close").alias("price"))
    priced = nearest_day_join(targets, closes, ["ticker"], "target_date", "date", ["price"], tolerance)

    def price(leg: str):
        return F.max(F.when(F.col("leg") == leg, F.col("price")))

    folded = priced.groupBy("run_date", "ticker").agg(
        F.max_by("rec", F.when(F.col("leg") == "entry", F.lit(1))).alias("rec"), price("entry").alias("entry_price"),
        *[price(h).alias(f"exit_price_{h}") for h in horizons])
    entry = F.col("entry_price")
    return folded.where(entry > 0).select(*[F.col(f"rec.{c}").alias(c) for c in recs.columns], "entry_price", *[
        F.when(F.col(f"exit_price_{h}") > 0, rounded((F.col(f"exit_price_{h}") / entry - 1.0) * 100.0)).alias(
            f"return_{h}") for h in horizons])


def returns_long(returns: DataFrame, horizons: Mapping[str, int] = S.BACKTEST_HORIZONS) -> DataFrame:
    return returns.select("run_date", "ticker", F.explode(F.array(*[
        F.struct(F.lit(h).alias("period"), F.col(f"return_{h}").alias("ret")) for h in horizons])).alias("r")).select(
        "run_date", "ticker", "r.period", "r.ret").where(F.col("ret").isNotNull())


def backtest_stats(returns: DataFrame, groups: tuple[str, ...] = ("run_date", "period"), large: bool | None = None,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per run and period: count, mean, median, extremes, population deviation, hit rate, profit factor.

    Returns have two decimals, so sums are taken over whole hundredths.  A group without losers has
    no profit factor (null).
    """
    x, cnt = F.col("ret"), F.col("cnt")
    whole = F.round(x * 100).cast("long")
    middle = F.lit(0.5) * (F.col("n") - 1)
    # everything follows from the distinct returns and how often each occurs
    counts = cumulative_counts(returns, groups, "ret", large, block_rows)
    moments = counts.groupBy(*groups).agg(
        F.sum("cnt").alias("n_stocks"), F.sum(whole * cnt).alias("total"),
        F.sum(whole.cast("decimal(18,0)") * whole * cnt).alias("squares"), F.max(x).alias("best"), F.min(x).alias("worst"),
        F.coalesce(F.sum(F.when(x > 0, cnt)), F.lit(0)).alias("winners"),
        F.coalesce(F.sum(F.when(x <= 0, cnt)), F.lit(0)).alias("losers"),
        F.sum(F.when(x > 0, whole * cnt)).alias("gains"), F.sum(F.when(x < 0, whole * cnt)).alias("losses"),
        value_at(F.floor(middle), "ret").alias("low"), value_at(F.ceil(middle), "ret").alias("high"))
    n = F.col("n_stocks")
    mean = F.col("total") / n / 100.0
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares").cast("double") / n / 10000.0 - mean * mean))
    return moments.select(
        *groups, "n_stocks", rounded(mean).alias("mean_return"),
        rounded((F.col("low") + F.col("high")) / 2.0).alias("median_return"),
        rounded(F.col("best")).alias("best_return"), rounded(F.col("worst")).alias("worst_return"),
        rounded(spread).alias("std_dev"), rounded(F.col("winners") / n * 100.0, 1).alias("hit_rate"), "winners",
        "losers",
        F.when(F.col("best") > F.col("worst"), rounded(mean / spread)).otherwise(0.0).alias("sharpe_like"),
        F.when(F.col("losses") < 0, rounded(F.coalesce("gains", F.lit(0)) / -F.col("losses"))).alias("profit_factor"))


def extreme_picks(returns: DataFrame, column: str = "return_3M", limit: int = 5) -> DataFrame:
    """The best and worst ``limit`` picks of every run by one horizon's return."""
    top = Window.partitionBy("run_date").orderBy(F.desc(column), "ticker")
    bottom = Window.partitionBy("run_date").orderBy(F.asc(column), F.desc("ticker"))
    rows = returns.where(F.col(column).isNotNull())

    def cut(window, side):
        return rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= limit).select(
            "run_date", F.lit(side).alias("side"), "position", "ticker", F.col(column).alias("ret"))

    return cut(top, "top").unionByName(cut(bottom, "bottom"))


def recommendation_outcomes(history: DataFrame, prices: DataFrame, run_date, horizon: int = S.OUTCOME_HORIZON_DAYS,
                            alert: float = S.BUY_HIT_RATE_ALERT) -> DataFrame:
    """One row: matured calls (``horizon`` calendar days old), mean return, buy hit rate and alert."""
    day = F.lit(run_date).cast("date")
    matured = history.where((F.datediff(day, F.col("run_date")) >= horizon) & (F.col("close_price") > 0)).join(
        prices.select("ticker", F.col("close_price").alias("end_price")).where(F.col("end_price").isNotNull()),
        "ticker").withColumn("ret", (F.col("end_price") / F.col("close_price") - 1.0) * 100.0)
    buy = F.col("recommendation") == "Buy Candidate"
    folded = matured.agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(buy).alias("buy_calls"), F.avg("ret").alias("mean"),
        F.count_if(buy & (F.col("ret") > 0)).alias("hits"))
    rate = F.when(F.col("buy_calls") > 0, F.col("hits") / F.col("buy_calls"))
    return folded.select(
        F.when(F.col("n_calls") > 0, "ok").otherwise("insufficient_matured_calls").alias("status"), "n_calls",
        "buy_calls", rounded(F.col("mean")).alias("avg_return_pct_all_calls"), rounded(rate, 3).alias("buy_hit_rate"),
        F.coalesce(rate < alert, F.lit(False)).alias("recalibration_alert"))


def label_changes(current: DataFrame, prior: DataFrame, run_date) -> DataFrame:
    """Tickers whose status differs from the prior run; absent ones were 'New'."""
    before = prior.select("ticker", F.col("investability_status").alias("prior_status"),
                          F.col("opportunity_score").alias("prior_score"))
    return current.join(before, "ticker", "left").withColumn(
        "prior_status", F.coalesce("prior_status", F.lit("New"))).where(
        F.col("prior_status") != F.coalesce("investability_status", F.lit(""))).select(
        "ticker", "name", F.lit(run_date).cast("string").alias("run_date"), "prior_status",
        F.col("investability_status").alias("new_status"), "prior_score", F.col("opportunity_score").alias("new_score"))


def run_changes(history: DataFrame) -> DataFrame:
    """Label changes of every run of a history (run_date, ticker, name, investability_status, opportunity_score) against the run before.

    A ticker that the run before doesn't have is 'New', also when an earlier run had it.  Every row is laid beside the
    same ticker's row of the next run by an equality join on the run's number.
    """
    runs = history.select("run_date").distinct().withColumn("run", F.row_number().over(Window.orderBy("run_date")))
    numbered = history.join(F.broadcast(runs), "run_date")  # one row per run
    before = numbered.select((F.col("run") + 1).alias("run"), "ticker", F.col("investability_status").alias("prior_status"),
                             F.col("opportunity_score").alias("prior_score"))
    return numbered.join(before, ["run", "ticker"], "left").withColumn("prior_status", F.coalesce("prior_status", F.lit("New"))).where(
        F.col("prior_status") != F.coalesce("investability_status", F.lit(""))).select(
        "ticker", "name", "run_date", "prior_status", F.col("investability_status").alias("new_status"), "prior_score",
        F.col("opportunity_score").alias("new_score"))
