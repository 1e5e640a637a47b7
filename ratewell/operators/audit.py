"""Digests of tables, checks of the scoring configuration, health of sources and the bias audit of a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, TimestampNTZType, TimestampType

from ratewell import settings as S
from ratewell.functions.bands import survivorship_severity
from ratewell.functions.numeric import rounded
from ratewell.operators.asof import tag_periods, weight_change_audit


# --- digests ---------------------------------------------------------------------------------
def _plain(value: Column, kind: DataType) -> Column:
    """Text of a cell that any engine writes alike: whole millionths for fractions, a date and time without zone."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.floor(value.cast("double") * 1e6 + 0.5).cast("string")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(value, lambda x: F.coalesce(_plain(x, kind.elementType), F.lit("\\N"))), ",")
    return value.cast("string")


def row_hash(df: DataFrame) -> Column:
    """60 bits of the md5 of a row's cells; null cells differ from every text."""
    cells = [F.coalesce(_plain(F.col(f"`{f.name}`"), f.dataType), F.lit("\\N")) for f in df.schema]
    return F.conv(F.left(F.md5(F.concat_ws("\x1f", *cells)), F.lit(15)), 16, 10).cast("decimal(20,0)")


def table_digest(df: DataFrame, name: str, key: str) -> DataFrame:
    """One row: table, n_rows, digest, first_key, last_key.

    The digest is the sum of the row hashes: it knows no order or partitioning, counts repeated rows, and those of
    parts add up to that of the whole.  An empty table has the digest 0.
    """
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row_hash(df)), F.lit(0)).cast("decimal(38,0)").alias("digest"),
                  F.min(key).cast("string").alias("first_key"), F.max(key).cast("string").alias("last_key")).select(
        F.lit(name).alias("table_name"), "n_rows", F.col("digest").cast("string").alias("digest"), "first_key", "last_key")


def weights_digest(weights: DataFrame) -> DataFrame:
    """One row with the ``digest`` of a (template, card, metric, weight) table, whatever the order of its rows."""
    return table_digest(weights.select("template", "card", "metric", "weight"), "weights", "template").select("digest")


# --- configuration ---------------------------------------------------------------------------
def config_check(weights: DataFrame, changes: DataFrame) -> DataFrame:
    """One row (ok, message): is the weights table the one the newest change of the log says?"""
    last = changes.agg(F.max_by("new_config_hash", "timestamp").alias("approved"))
    ok = F.col("approved").isNull() | (F.col("approved") == F.col("digest"))
    return weights_digest(weights).crossJoin(F.broadcast(last)).select(  # one row each
        ok.alias("ok"),
        F.when(F.col("approved").isNull(), "No weight change log found. Assuming initial setup.")
        .when(ok, F.format_string("Config matches last approved state (%s).", "approved"))
        .otherwise(F.format_string("CONFIG MISMATCH: Current config hash (%s) != last approved (%s).", "digest", "approved")).alias("message"))


def metric_references(weights: DataFrame, directions: DataFrame, sources: DataFrame) -> DataFrame:
    """Metrics that a card weighs and that have no direction or no source, with what they lack."""
    named = weights.groupBy("metric").agg(F.count(F.lit(1)).alias("n_uses"))
    missing = [(directions, "direction"), (sources, "source")]
    for table, what in missing:
        named = named.join(table.select("metric").distinct().withColumn(f"__{what}", F.lit(True)), "metric", "left")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"__{what}").isNull(), what) for _, what in missing]))
    return named.withColumn("lacks", F.array_join(lacks, ", ")).where("lacks <> ''").select("metric", "n_uses", "lacks")


# --- sources ---------------------------------------------------------------------------------
def source_health(found: DataFrame, run_date, expected: Mapping[str, tuple[int, bool]]) -> DataFrame:
    """State of every expected source: ``expected`` says how old it may be and whether the run can do without it.

    ``found`` has source, n_files, n_rows, latest_date.  A source that isn't found is ``missing``, one without rows
    ``empty``, one too old ``stale``.  ``level`` is error for required sources that are not ok, else warning.
    """
    spark = found.sparkSession
    wanted = spark.createDataFrame([(s, age, need) for s, (age, need) in expected.items()], "source string, max_age int, required boolean")
    age = F.datediff(F.lit(run_date).cast("date"), F.col("latest_date"))
    status = (F.when(F.col("n_files").isNull(), "missing").when(F.col("n_rows") == 0, "empty")
              .when(age <= F.col("max_age"), "ok").otherwise("stale"))
    return wanted.join(found, "source", "left").withColumn("status", status).select(
        "source", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "latest_date", age.alias("age_days"), "status",
        F.when(F.col("status") == "ok", "ok").when(F.col("required"), "error").otherwise("warning").alias("level"))


def overall_health(health: DataFrame) -> DataFrame:
    """One row: overall status (the worst level) and how many sources have each status."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "stale", "empty", "missing")]
    worst = F.when(F.max(F.col("level") == "error"), "error").when(F.max(F.col("level") == "warning"), "warning").otherwise("ok")
    return health.agg(worst.alias("overall_status"), *counts)


# --- survivorship over time ------------------------------------------------------------------
def survivorship_series(entities: DataFrame) -> DataFrame:
    """Universe of every month end and the share of it that failed later: a sweep over entries and exits.

    ``entities`` has one row per entity with list_date and delist_date (null: still there).  An entity counts from the
    end of the month it is listed in to the end of the month before it is delisted.  Each entity gives an entry and an exit at
    most; these are added up by month, so the running totals go over calendar months and not over entities.
    """
    def month(day: str) -> Column:
        return F.last_day(F.col(day))

    failed = F.col("delist_date").isNotNull()
    steps = F.array_compact(F.array(
        F.struct(month("list_date").alias("month_end"), F.lit(1).alias("step")),
        F.when(failed, F.struct(month("delist_date").alias("month_end"), F.lit(-1).alias("step")))))
    moves = entities.where(F.col("list_date").isNotNull()).select(failed.alias("failed"), F.explode(steps).alias("s")).groupBy("s.month_end").agg(
        F.sum(F.when(~F.col("failed"), F.col("s.step"))).alias("surviving"), F.sum(F.when(F.col("failed"), F.col("s.step"))).alias("failing"))
    span = moves.agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    months = span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(
        F.last_day("m").alias("month_end"))
    so_far = Window.orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    totals = months.join(moves, "month_end", "left").select(
        "month_end", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(n) for c, n in (("surviving", "n_surviving"), ("failing", "n_later_failed"))])
    total = F.col("n_surviving") + F.col("n_later_failed")
    return totals.select("month_end", "n_surviving", "n_later_failed", total.alias("total_universe"),
                         F.when(total > 0, rounded(F.col("n_later_failed") / total * 100.0, 1)).otherwise(0.0).alias("pct_missing")).withColumn(
        "bias_severity", survivorship_severity(F.col("pct_missing")))


# --- bias audit ------------------------------------------------------------------------------
def bias_audit(survival: DataFrame, runs: DataFrame, weights: DataFrame, changes: DataFrame, mode: str = "backtest") -> DataFrame:
    """Findings (check, level, message) of all guards, and one row ``all_clear``: ok without a blocker.

    Checks are survivorship, the period every run ends in (skipped in ``live`` mode), whether the weights are those of
    the last approved change, and the change log itself.
    """
    if mode not in ("live", "backtest"):
        raise ValueError("mode must be 'live' or 'backtest'")
    severity = F.col("bias_severity")
    found = survival.select(
        F.lit("survivorship").alias("check"),
        F.when(severity.isin("High", "Severe"), "blocker").when(severity == "Moderate", "warning").otherwise("ok").alias("level"),
        F.format_string("SURVIVORSHIP [%s]: %d delisted names (%.1f%% of the %s universe) missing.", severity,
                        F.col("n_later_failed"), F.col("pct_missing"), F.col("as_of_date")).alias("message"))
    if mode == "live":
        periods = survival.select(F.lit("period").alias("check"), F.lit("ok").alias("level"),
                                  F.lit("LIVE MODE: holdout/date-range snooping guard skipped.").alias("message"))
    else:
        periods = tag_periods(runs).groupBy("period", "allowed").agg(F.count(F.lit(1)).alias("n")).select(
            F.concat(F.lit("period:"), "period").alias("check"),
            F.when(~F.col("allowed"), "blocker").when(F.col("period") == "validation", "warning").otherwise("ok").alias("level"),
            F.format_string("%d runs end in the %s period.", F.col("n"), F.col("period")).alias("message"))
    config = config_check(weights, changes).select(
        F.lit("config").alias("check"), F.when(F.col("ok"), "ok").otherwise("blocker").alias("level"),
        F.when(F.col("ok"), F.col("message")).otherwise(F.concat(F.lit("CONFIG INTEGRITY: "), "message")).alias("message"))
    log = weight_change_audit(changes).select(
        F.lit("weight_log").alias("check"), F.when(F.col("holdout_contaminated"), "warning").otherwise("ok").alias("level"),
        F.format_string("%d weight changes, %d of them in the holdout period, %d of %d left.", F.col("total_changes"),
                        F.col("changes_in_holdout"), F.col("budget_remaining"), F.lit(S.CHANGE_BUDGET)).alias("message"))
    findings = found.unionByName(periods).unionByName(config).unionByName(log)
    blockers = findings.agg(F.count_if(F.col("level") == "blocker").alias("n"))
    return findings.unionByName(blockers.select(
        F.lit("all_clear").alias("check"), F.when(F.col("n") == 0, "ok").otherwise("blocker").alias("level"),
        F.format_string("%d blockers", "n").alias("message")))
