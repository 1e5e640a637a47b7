"""Point-in-time lookups, survivorship and look-ahead checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.bands import survivorship_severity
from ratewell.functions.numeric import rounded
from ratewell.operators.ordered import BLOCK_ROWS, is_large, with_block, written


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def snapshot(facts: DataFrame, as_of, keys: Sequence[str] = ("ticker", "metric"),
             latest: Sequence[str] = ("filing_date", "period_end_date", "ingest_id")) -> DataFrame:
    """Latest fact per key filed on or before ``as_of``; later duplicates win by ingest order.

    One grouped maximum, combined before the shuffle: no window, no sort of the key's history.
    """
    rest = [c for c in facts.columns if c not in keys]
    return facts.where(F.col("filing_date") <= as_date(as_of)).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*latest)).alias("f")).select(*keys, "f.*")


def as_of_join(requests: DataFrame, facts: DataFrame, keys: Sequence[str], request_time: str, fact_time: str,
               payload: Sequence[str], tie: Sequence[str] = (), large: bool | None = None,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each request row with the payload of the latest fact of its key at or before the request time.

    Facts and requests are laid on one time line per key and the last fact is carried forward, so a
    key with many of both never pairs them.  For large inputs a key's time line is cut into blocks;
    the last fact of each block is carried into the following ones.
    """
    keys = list(keys)
    own = [c for c in requests.columns if c not in keys]
    fact_rows = facts.select(
        *keys, F.col(fact_time).cast("timestamp").alias("__t"), F.lit(0).alias("__kind"),
        F.struct(*(tie or [F.lit(0).alias("none")])).alias("__tie"),
        F.struct(*payload).alias("__fact"))
    request_rows = requests.select(
        *keys, F.col(request_time).cast("timestamp").alias("__t"), F.lit(1).alias("__kind"),
        F.lit(None).cast(fact_rows.schema["__tie"].dataType).alias("__tie"),
        F.lit(None).cast(fact_rows.schema["__fact"].dataType).alias("__fact"),
        F.struct(*own).alias("__own"))
    line = fact_rows.unionByName(request_rows, allowMissingColumns=True)
    order = ["__t", "__kind", "__tie"]
    if large is None:
        large = is_large(line, block_rows)
    if not large:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = line.withColumn("__found", F.last("__fact", ignorenulls=True).over(upto))
    else:
        line = written(line, "timeline")  # read by four branches below
        blocked = with_block(line, keys, F.struct(*order), block_rows).drop("__key")
        upto = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        closing = blocked.groupBy(*keys, "__block").agg(F.max_by(
            "__fact", F.when(F.col("__kind") == 0, F.struct(*order))).alias("__close"))
        earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carried = closing.select(
            *keys, "__block", F.last("__close", ignorenulls=True).over(earlier).alias("__carried"))
        found = blocked.withColumn("__last", F.last("__fact", ignorenulls=True).over(upto)).join(
            carried, [*keys, "__block"], "left").withColumn("__found", F.coalesce("__last", "__carried"))
    return found.where(F.col("__kind") == 1).select(
        *keys, *[F.col(f"__own.{c}").alias(c) for c in own], *[F.col(f"__found.{c}").alias(c) for c in payload])


def nearest_day_join(requests: DataFrame, facts: DataFrame, keys: Sequence[str], request_day: str, fact_day: str,
                     payload: Sequence[str], tolerance: int, range_days: int = 1024) -> DataFrame:
    """Each request row with the payload of its key's fact nearest in days, and that fact's date as ``near_day``.

    Facts more than ``tolerance`` days away don't count; of two equally near ones the later is taken.  Requests
    without one keep null payload and day; so do requests whose key or day is null.  Facts need a day each.

    Facts and requests lie on one time line per key, cut into ranges of ``range_days`` days.  A fact near a border
    lies in both ranges, so every request sees all it may be given, and a key's line is no single task.  One sort
    serves both directions: the last fact up to the day and the first from it on, within the tolerance.
    """
    keys = list(keys)
    own = [c for c in requests.columns if c not in keys]

    def day(column: str) -> Column:
        return F.unix_date(F.col(column).cast("date"))

    def part(days: Column) -> Column:
        return F.floor(days / range_days).cast("int")

    seen_from = F.sequence(part(day(fact_day) - tolerance), part(day(fact_day) + tolerance))
    fact_rows = facts.where(F.col(fact_day).isNotNull()).select(
        *keys, F.explode(seen_from).alias("__range"), day(fact_day).alias("__day"),
        F.struct(F.col(fact_day).cast("date").alias("near_day"), *payload).alias("__fact"))
    request_rows = requests.select(*keys, part(day(request_day)).alias("__range"), day(request_day).alias("__day"),
                                   F.struct(*own).alias("__own"))
    line = Window.partitionBy(*keys, "__range").orderBy("__day")
    found = fact_rows.unionByName(request_rows, allowMissingColumns=True).select(
        "*", F.last("__fact", ignorenulls=True).over(line.rangeBetween(-tolerance, 0)).alias("__past"),
        F.first("__fact", ignorenulls=True).over(line.rangeBetween(0, tolerance)).alias("__next"))
    known = [F.col(k).isNotNull() for k in keys]
    back = F.datediff(F.date_from_unix_date("__day"), F.col("__past.near_day"))
    ahead = F.datediff(F.col("__next.near_day"), F.date_from_unix_date("__day"))
    near = F.when((F.col("__next").isNotNull()) & (F.col("__past").isNull() | (ahead <= back)), F.col("__next")).otherwise(F.col("__past"))
    return found.where(F.col("__own").isNotNull()).withColumn("__near", F.when(reduce(and_, known), near)).select(
        *keys, *[F.col(f"__own.{c}").alias(c) for c in own], "__near.near_day", *[F.col(f"__near.{c}").alias(c) for c in payload])


def look_ahead_audit(facts: DataFrame, requested: DataFrame, as_of) -> DataFrame:
    """Status of each requested (ticker, metric) by its latest filing overall.

    A latest filing after ``as_of`` is a violation even when an older valid one exists.
    """
    latest = facts.groupBy("ticker", "metric").agg(F.max_by(
        F.struct("filing_date", "is_proxy", "source"),
        F.struct("filing_date", "ingest_id")).alias("f"))
    day = as_date(as_of)
    joined = requested.join(latest, ["ticker", "metric"], "left")
    return joined.select(
        "ticker", "metric",
        F.when(F.col("f").isNull(), "MISSING").when(F.col("f.filing_date") > day, "LOOK_AHEAD_VIOLATION")
        .when(F.col("f.is_proxy"), "PROXY_WARNING").otherwise("OK").alias("status"),
        F.col("f.filing_date").alias("filing_date"), F.coalesce("f.is_proxy", F.lit(False)).alias("is_proxy"),
        F.col("f.source").alias("source"))


def universe_as_of(active: DataFrame, delisted: DataFrame, as_of) -> DataFrame:
    """Active tickers plus those listed by ``as_of`` and delisted strictly after it."""
    day = as_date(as_of)
    alive = delisted.where((F.col("list_date") <= day) & (F.col("delist_date") > day))
    extra = alive.join(active.select("ticker"), "ticker", "left_anti").select(
        "ticker", F.lit("later_delisted").alias("status"), "delist_date", F.col("reason").alias("delist_reason"),
        "last_price")
    return active.select("ticker", F.lit("active").alias("status")).unionByName(extra, allowMissingColumns=True)


def survivorship(active: DataFrame, delisted: DataFrame, as_of) -> DataFrame:
    """One row: survivors, later failures, their share and its severity."""
    counts = universe_as_of(active, delisted, as_of).agg(
        F.count_if(F.col("status") == "active").alias("n_surviving"),
        F.count_if(F.col("status") == "later_delisted").alias("n_later_failed"))
    total = F.col("n_surviving") + F.col("n_later_failed")
    return counts.select(
        F.lit(as_of).cast("string").alias("as_of_date"), "n_surviving", "n_later_failed", total.alias("total_universe"),
        F.when(total > 0, rounded(F.col("n_later_failed") / total * 100.0, 1)).otherwise(0.0).alias("pct_missing"),
    ).withColumn("bias_severity", survivorship_severity(F.col("pct_missing")))


def tag_periods(runs: DataFrame, end: str = "end_date") -> DataFrame:
    """Which data period each run ends in, whether it may be used, and the message."""
    last = F.date_format(F.col(end), "yyyy-MM-dd")
    return runs.withColumn("period", F.when(last >= S.HOLDOUT_START, "holdout").when(
        last >= S.VALIDATION_START, "validation").otherwise("development")).withColumn(
        "allowed", F.col("period") != "holdout").withColumn(
        "period_message",
        F.when(F.col("period") == "holdout", F.concat(
            F.lit("VETO: Backtest end_date "), last,
            F.lit(f" enters the holdout period (locked from {S.HOLDOUT_START}).")))
        .when(F.col("period") == "validation", F.lit(
            f"WARNING: Backtest runs into the validation period ({S.VALIDATION_START} to {S.HOLDOUT_START})."))
        .otherwise(F.lit(f"OK: Backtest confined to development period (before {S.VALIDATION_START}).")))


def weight_change_audit(changes: DataFrame) -> DataFrame:
    """Totals of a weight-change log: in and out of the holdout period, budget left, contamination."""
    in_holdout = F.substring("timestamp", 1, 10) >= S.HOLDOUT_START
    return changes.agg(
        F.count(F.lit(1)).alias("total_changes"),
        F.count_if(~in_holdout).alias("changes_in_dev_validation"),
        F.count_if(in_holdout).alias("changes_in_holdout"),
    ).select(
        "*", F.greatest(F.lit(0), F.lit(S.CHANGE_BUDGET) - F.col("changes_in_dev_validation")).alias("budget_remaining"),
        (F.col("changes_in_holdout") > 0).alias("holdout_contaminated"))


def bias_report(survival: DataFrame, runs: DataFrame) -> DataFrame:
    """Blockers and warnings of the survivorship and period checks, one row per finding."""
    severity = F.col("bias_severity")
    survival_rows = survival.select(
        F.lit("survivorship").alias("check"),
        F.when(severity.isin("High", "Severe"), "blocker").when(severity == "Moderate", "warning").otherwise(
            "ok").alias("level"),
        F.format_string("SURVIVORSHIP [%s]: %d delisted names (%.1f%% of the %s universe) missing.", severity,
                        F.col("n_later_failed"), F.col("pct_missing"), F.col("as_of_date")).alias("message"))
    period_rows = tag_periods(runs).groupBy("period", "allowed").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("period:"), "period").alias("check"),
        F.when(~F.col("allowed"), "blocker").when(F.col("period") == "validation", "warning").otherwise("ok").alias(
            "level"),
        F.format_string("%d runs end in the %s period.", F.col("n"), F.col("period")).alias("message"))
    return survival_rows.unionByName(period_rows)
