"""Indicators over daily bars (ticker, date, open, high, low, close, volume, traded_value).

A ticker's series holds at most one row per session, so windows over it are bounded by the calendar.
All windows share one partitioning and one sort; rows are then folded to one row per ticker with
conditional aggregates on ``back``, the number of sessions before the latest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.functions.bands import rsi_score
from ratewell.functions.formulas import (
    cagr, distance_from, drawdown_recovery, dual_momentum, price_return, volume_delivery_score)
from ratewell.functions.numeric import clamp, ratio, rounded

RSI_PERIOD = 14


def keep_last_bar(bars: DataFrame, arrival: str) -> DataFrame:
    """One bar per (ticker, date): the one that arrived last."""
    rest = [c for c in bars.columns if c not in ("ticker", "date", arrival)]
    return bars.groupBy("ticker", "date").agg(
        F.max_by(F.struct(*rest), F.struct(arrival, *rest)).alias("bar")).select("ticker", "date", "bar.*")


def last_sessions(bars: DataFrame, run_date: str | None = None, sessions: int = 1300) -> DataFrame:
    """Bars of the newest ``sessions`` trading dates up to ``run_date``."""
    if run_date is not None:
        bars = bars.where(F.col("date") <= F.lit(run_date).cast("date"))
    dates = bars.select("date").distinct().orderBy(F.desc("date")).limit(sessions)
    # at most ``sessions`` dates, so broadcasting them is bounded; prunes date partitions at run time
    return bars.join(F.broadcast(dates), "date", "left_semi")


def numbered(bars: DataFrame) -> DataFrame:
    """Add seq (1..n), n, back (0 = latest), the previous close and the true range; needs complete OHLC rows."""
    series = Window.partitionBy("ticker").orderBy("date")
    previous = F.lag("close").over(series)
    return (
        bars.where(F.col("close").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull())
        .withColumn("seq", F.row_number().over(series))
        .withColumn("prev_close", previous)
        .withColumn("prev_high", F.lag("high").over(series))
        .withColumn("prev_low", F.lag("low").over(series))
        .withColumn("close_20_ago", F.lag("close", 20).over(series))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
        .withColumn("back", F.col("n") - F.col("seq"))
        .withColumn("true_range", F.when(F.col("prev_close").isNotNull(), F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")),
            F.abs(F.col("low") - F.col("prev_close")))))
    )


def close_back(sessions: int) -> Column:
    """Aggregate: the close ``sessions`` sessions before the latest, null on shorter series."""
    return F.max(F.when(F.col("back") == sessions, F.col("close")))


def mean_back(column: str, sessions: int) -> Column:
    """Aggregate: mean over the latest ``sessions`` rows, null on shorter series."""
    return F.when(F.max("n") >= sessions, F.avg(F.when(F.col("back") < sessions, F.col(column))))


def with_held(rows: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_back`` (0 = latest bar that has the column) and ``<column>_n`` (bars that have it)."""
    upto = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        rows = rows.withColumn(f"{c}_n", F.count(c).over(Window.partitionBy("ticker"))).withColumn(
            f"{c}_back", F.when(F.col(c).isNotNull(), F.col(f"{c}_n") - F.count(c).over(upto)))
    return rows


def mean_held(column: str, sessions: int, least: int) -> Column:
    """Aggregate: mean over the latest ``sessions`` bars that have the column, null if fewer than ``least`` have it."""
    return F.when(F.max(f"{column}_n") >= least, F.avg(F.when(F.col(f"{column}_back") < sessions, F.col(column))))


def wilder_sum(gain: Column) -> Column:
    """Aggregate: final Wilder average of per-bar ``gain`` (14 periods, simple-mean seed), in closed form."""
    decay = F.lit((RSI_PERIOD - 1) / RSI_PERIOD)
    age = F.when(F.col("seq") <= RSI_PERIOD + 1, F.col("n") - RSI_PERIOD - 1).otherwise(F.col("back"))
    return F.sum(F.when(F.col("seq") > 1, gain * F.pow(decay, age) / RSI_PERIOD))


def price_metrics(bars: DataFrame) -> DataFrame:
    """One row per ticker: latest close, returns, range recovery, RSI state, average distances, ATR squeeze, volume, turnover."""
    change = F.col("close") - F.col("prev_close")
    folded = with_held(numbered(bars), "volume", "traded_value").groupBy("ticker").agg(
        F.max("n").alias("n"),
        close_back(0).alias("last"),
        close_back(252).alias("close_252"),
        close_back(126).alias("close_126"),
        close_back(1260).alias("close_1260"),
        F.max(F.when(F.col("back") < 252, F.col("high"))).alias("high_52w"),
        F.min(F.when(F.col("back") < 252, F.col("low"))).alias("low_52w"),
        mean_back("close", 50).alias("sma_50"),
        mean_back("close", 200).alias("sma_200"),
        F.avg(F.when(F.col("back") < 20, F.col("true_range"))).alias("atr_20"),
        F.avg(F.when(F.col("back") < 60, F.col("true_range"))).alias("atr_60"),
        mean_held("volume", 20, 60).alias("volume_20"),
        mean_held("volume", 60, 60).alias("volume_60"),
        mean_held("traded_value", 30, 30).alias("turnover_30"),
        wilder_sum(F.greatest(change, F.lit(0.0))).alias("avg_gain"),
        wilder_sum(F.greatest(-change, F.lit(0.0))).alias("avg_loss"),
    )
    rsi = F.when(F.col("n") >= RSI_PERIOD + 1, F.when(F.col("avg_loss") == 0, 100.0).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("avg_gain") / F.col("avg_loss"))))
    recovery = F.when(F.col("n") >= 252, rounded(drawdown_recovery(F.col("last"), F.col("high_52w"), F.col("low_52w"))))
    squeeze = F.when(F.col("n") >= 61, clamp((F.lit(1.0) - ratio(F.col("atr_20"), F.col("atr_60"))) * 100.0, 0, 100))
    return folded.select(
        "ticker",
        rounded(F.col("last")).alias("close_price"),
        rounded(price_return(F.col("last"), F.col("close_252")) * 100.0).alias("return_1y"),
        rounded(price_return(F.col("last"), F.col("close_126")) * 100.0).alias("return_6m"),
        rounded(cagr(F.col("last"), F.col("close_1260"), 5) * 100.0).alias("cagr_5y"),
        recovery.alias("drawdown_recovery"),
        recovery.alias("drawdown_normalization"),
        rsi.alias("rsi_14"),
        rsi_score(rsi).alias("rsi_state"),
        rounded(distance_from(F.col("last"), F.col("sma_200"))).alias("price_vs_200dma"),
        rounded(distance_from(F.col("last"), F.col("sma_50"))).alias("price_vs_50dma"),
        rounded(squeeze).alias("volatility_compression"),
        F.when(F.col("volume_60") > 0, rounded(F.col("volume_20") / F.col("volume_60"), 4)).alias("volume"),
        rounded(F.col("turnover_30") / 1e7).alias("avg_daily_turnover_cr"),
    )


def index_series(bars: DataFrame, name: str = "ALL") -> DataFrame:
    """Equal-weight index: mean close per date over all tickers."""
    return bars.groupBy("date").agg(F.avg("close").alias("close")).withColumn("index_name", F.lit(name))


def index_returns(index_bars: DataFrame, lags: dict[str, int] | None = None) -> DataFrame:
    """Latest close and returns at fixed session offsets, per index."""
    lags = lags or {"return_1m": 21, "return_3m": 65, "return_6m": 129, "return_1y": 251}
    series = numbered(index_bars.select(
        F.col("index_name").alias("ticker"), "date", F.col("close").alias("open"), F.col("close").alias("high"),
        F.col("close").alias("low"), "close"))
    return series.groupBy(F.col("ticker").alias("index_name")).agg(
        F.max("n").alias("sessions"), rounded(close_back(0)).alias("latest_close"),
        *[rounded((close_back(0) / close_back(lag) - 1.0) * 100.0).alias(name) for name, lag in lags.items()])


def _with_directional_index(rows: DataFrame, segment: int = 512) -> DataFrame:
    """Add the per-bar directional index (``dx``, from the 14th true range on) and its sign (``up``).

    A Wilder average is a linear recurrence: over any run of bars the state maps to state x decay^length + own part.
    Series are cut into segments; within one the own part is a running sum of inflated terms, deflated again, which
    stays finite.  The segments before a bar's own are composed in order, so the state is carried through series of
    any length, flat stretches included.
    """
    p, growth = RSI_PERIOD, RSI_PERIOD / (RSI_PERIOD - 1)
    series = Window.partitionBy("ticker")
    inside = series.partitionBy("ticker", "__segment").orderBy("date")
    up, down = F.col("high") - F.col("prev_high"), F.col("prev_low") - F.col("low")
    terms = {
        "true_range": F.col("true_range"),
        "plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "minus": F.when((down > up) & (down > 0), down).otherwise(0.0)}
    rows = rows.withColumn("j", F.col("seq") - 2).withColumn("__segment", F.floor(F.greatest("j", F.lit(0)) / segment))
    place = F.col("j") - F.col("__segment") * segment
    inflate = F.when(F.col("j") >= 0, F.pow(F.lit(growth), F.greatest(place, F.lit(p - 1) - F.col("__segment") * segment)) / p)
    deflate = F.pow(F.lit(1 / growth), place)
    rows = rows.withColumns({f"__{k}": F.coalesce(F.sum(x * inflate).over(inside.rowsBetween(Window.unboundedPreceding, 0)) * deflate, F.lit(0.0)) for k, x in terms.items()})
    # full segments only have followers; the list grows by one entry a segment
    closing = F.when(place == segment - 1, F.struct(*[F.col(f"__{k}").alias(k) for k in terms]))
    before = F.collect_list(closing).over(series.orderBy("__segment").rangeBetween(Window.unboundedPreceding, -1))
    whole, none = F.lit((1 / growth) ** segment), F.struct(*[F.lit(0.0).alias(k) for k in terms])
    carried = F.when((place == 0) | (F.col("j") < 0), F.aggregate("__before", none, lambda state, own: F.struct(*[(state[k] * whole + own[k]).alias(k) for k in terms])))
    rows = rows.withColumn("__before", before).withColumn("__carried", carried).withColumn(
        "__carried", F.first("__carried", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    state = {k: F.col(f"__{k}") + F.coalesce(F.col(f"__carried.{k}"), F.lit(0.0)) * deflate / growth for k in terms}
    base = F.when(state["true_range"] == 0, F.lit(1e-10)).otherwise(state["true_range"])
    plus, minus = state["plus"] / base * 100.0, state["minus"] / base * 100.0
    total = plus + minus
    dx = F.abs(plus - minus) / F.when(total == 0, F.lit(1e-10)).otherwise(total) * 100.0
    return rows.withColumn("dx", F.when(F.col("j") >= p - 1, dx)).withColumn("up", state["plus"] > state["minus"]).drop(
        "__before", "__carried", "__segment", *[f"__{k}" for k in terms])


def _trend_strength() -> Column:
    """Aggregate: direction-signed Wilder average of the directional index around 50."""
    p = RSI_PERIOD
    t, last = F.col("j") - (p - 1), F.col("n") - 2 - (p - 1)
    adx = F.sum(F.col("dx") * F.pow(F.lit((p - 1) / p), F.when(t < p, last - (p - 1)).otherwise(last - t)) / p)
    rising = F.max(F.when(F.col("back") == 0, F.col("up")))
    return F.lit(50.0) + adx * F.when(rising, 0.5).otherwise(-0.5)


def momentum_metrics(bars: DataFrame, index_bars: DataFrame, lookback: int = 252, index_name: str = "ALL",
                     segment: int = 512) -> DataFrame:
    """Dual momentum, momentum quality, trend strength, mean-reversion risk and breakout score per ticker.

    ``index_bars`` may hold several indices; ``index_name`` is the one to compare with.
    """
    series = Window.partitionBy("ticker").orderBy("date")
    recent = F.col("back") < lookback
    span = F.least(F.col("n"), F.lit(lookback))
    position = span - 1 - F.col("back")
    log_close = F.when(recent, F.ln("close"))
    rows = (
        _with_directional_index(numbered(bars), segment)
        .withColumn("peak", F.max(F.when(recent, F.col("close"))).over(
            series.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("pos", F.when(recent, position.cast("double")))
        .withColumn("log_close", log_close)
        .withColumn("weight", F.when(recent & (position >= 20), position / span))
    )
    folded = rows.groupBy("ticker").agg(
        F.max("n").alias("n"),
        close_back(0).alias("last"), close_back(129).alias("close_129"), close_back(251).alias("close_251"),
        F.sum(F.when(F.col("close") / F.col("close_20_ago") - 1.0 > 0, F.col("weight")).otherwise(
            F.when(F.col("weight").isNotNull(), 0.0))).alias("rising"),
        F.sum("weight").alias("weights"),
        F.max(F.when(recent, (F.col("peak") - F.col("close")) / F.col("peak"))).alias("max_drawdown"),
        F.regr_slope("log_close", "pos").alias("slope"),
        F.regr_intercept("log_close", "pos").alias("intercept"),
        F.regr_syy("log_close", "pos").alias("syy"), F.regr_sxy("log_close", "pos").alias("sxy"),
        F.regr_count("log_close", "pos").alias("n_fit"),
        F.max(F.when(recent, F.col("close"))).alias("top"), F.min(F.when(recent, F.col("close"))).alias("bottom"),
        F.avg(F.when(F.col("back") < 20, F.col("volume"))).alias("volume_20"),
        mean_back("volume", 60).alias("volume_60"),
        _trend_strength().alias("trend"),
    )
    enough = F.col("n") >= min(lookback, 60)
    quality = rounded(clamp(
        F.col("rising") / F.col("weights")
        * F.greatest(F.lit(0.0), F.lit(1.0) - F.col("max_drawdown") * 2.0) * 100.0, 0, 100))
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n_fit")))
    residual = F.ln("last") - (F.col("slope") * (F.col("n_fit") - 1) + F.col("intercept"))
    reversion = F.when(spread == 0, 50.0).otherwise(rounded(clamp(F.lit(50.0) - residual / spread * 25.0, 0, 100)))
    vol_factor = F.when(F.col("volume_60") > 0, clamp(F.col("volume_20") / F.col("volume_60"), 0.5, 2.0)).otherwise(1.0)
    breakout = F.when(F.col("top") == F.col("bottom"), 50.0).otherwise(rounded(clamp(
        (F.col("last") - F.col("bottom")) / (F.col("top") - F.col("bottom")) * 80.0
        + F.when(F.col("last") >= F.col("top") * 0.95, vol_factor * 10.0).otherwise(0.0), 0, 100)))

    index = numbered(index_bars.where(F.col("index_name") == index_name).select(
        F.col("index_name").alias("ticker"), "date", F.col("close").alias("high"), F.col("close").alias("low"),
        "close")).agg(
        ((close_back(0) / close_back(129) - 1.0) * 100.0).alias("r6"),
        ((close_back(0) / close_back(251) - 1.0) * 100.0).alias("r12"))
    return (
        folded.withColumn("index", index.select(F.struct("r6", "r12").alias("v")).scalar())
        .select(
            "ticker",
            dual_momentum(
                F.when(F.col("close_129") > 0, (F.col("last") / F.col("close_129") - 1.0) * 100.0),
                F.when(F.col("close_251") > 0, (F.col("last") / F.col("close_251") - 1.0) * 100.0),
                F.col("index.r6"), F.col("index.r12")).alias("dual_momentum"),
            F.when(enough, quality).alias("momentum_quality"),
            F.when(F.col("n") >= 2 * RSI_PERIOD + 1, rounded(clamp(F.col("trend"), 0, 100))).alias("trend_strength"),
            F.when(enough, reversion).alias("mean_reversion_risk"),
            F.when(enough, breakout).alias("breakout_score"),
        )
    )


def relative_strength_turn(bars: DataFrame, index_bars: DataFrame, short: int = 5, long: int = 10,
                           index_name: str = "ALL") -> DataFrame:
    """Slope of the price/index ratio over the latest ``short`` sessions minus the ``long`` before; joined by date.

    ``index_bars`` may hold several indices; ``index_name`` is the one to compare with.
    """
    need = short + long + 2
    both = bars.select("ticker", "date", "close", "high", "low").join(
        index_bars.where(F.col("index_name") == index_name).select("date", F.col("close").alias("index_close")), "date")
    rows = numbered(both).withColumn("strength", ratio(F.col("close"), F.col("index_close"))).withColumn(
        "x", (F.lit(need) - 1 - F.col("back")).cast("double"))
    late, early = F.col("back") < short, (F.col("back") >= short) & (F.col("back") < short + long)
    folded = rows.groupBy("ticker").agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("back") < need, F.abs("index_close"))).alias("least_index"),
        F.regr_slope(F.when(late, F.col("strength")), F.when(late, F.col("x"))).alias("recent"),
        F.regr_slope(F.when(early, F.col("strength")), F.when(early, F.col("x"))).alias("prior"))
    return folded.select("ticker", F.when(
        (F.col("n") >= need) & (F.col("least_index") > 0), F.col("recent") - F.col("prior")).alias("rs_turn"))


def delivery_metrics(delivery: DataFrame) -> DataFrame:
    """Mean delivery percentage of the latest 20 and 60 records per symbol, and the confirmation score."""
    latest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = delivery.where(F.col("delivery_pct").isNotNull()).withColumn("back", F.row_number().over(latest) - 1)
    folded = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions_available"),
        F.avg(F.when(F.col("back") < 20, F.col("delivery_pct"))).alias("mean_20"),
        F.avg(F.when(F.col("back") < 60, F.col("delivery_pct"))).alias("mean_60"))
    mean_20 = F.when(F.col("sessions_available") >= 5, F.col("mean_20"))
    mean_60 = F.when(F.col("sessions_available") >= 10, F.col("mean_60"))
    return folded.select(
        "symbol", rounded(mean_20).alias("delivery_pct_20d_avg"), rounded(mean_60).alias("delivery_pct_60d_avg"),
        F.when(mean_60 > 0, rounded(volume_delivery_score(mean_20, mean_60))).alias("volume_delivery"),
        "sessions_available")
