"""Digests, references, health, survivorship over time and the bias audit on small cases."""

import datetime as dt
import random

from ratewell import settings as S
from ratewell.operators import audit as A

WEIGHTS = "template string, card string, metric string, pos int, weight double"


def test_digest_knows_no_order_and_adds_up(spark):
    rows = [(i, None if i % 7 == 0 else f"x{i % 3}", i / 3) for i in range(100)] + [(5, "x2", 5 / 3)] * 2
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, t string, v double")

    def digest(d):
        return int(A.table_digest(d, "d", "k").first().digest)

    assert digest(df) == digest(df.repartition(7)) == digest(df.where("k < 40")) + digest(df.where("k >= 40"))
    assert digest(df) != digest(df.distinct()) and digest(df.where("false")) == 0
    assert digest(spark.sql("select 'a' k, null b")) != digest(spark.sql("select 'a' k, '' b"))
    row = A.table_digest(df, "d", "k").first()
    assert (row.table_name, row.n_rows, row.first_key, row.last_key) == ("d", 102, "0", "99")


def test_config_is_checked_against_the_newest_change(spark):
    weights = spark.createDataFrame(S.weight_rows(), WEIGHTS)
    own = A.weights_digest(weights).scalar()
    digest = spark.range(1).select(own).first()[0]
    log = "timestamp string, new_config_hash string"
    assert A.config_check(weights, spark.createDataFrame([], log)).first().ok
    assert A.config_check(weights.repartition(3), spark.createDataFrame([("2024-02", digest), ("2024-01", "old")], log)).first().ok
    changed = A.config_check(weights, spark.createDataFrame([("2024-02", "other"), ("2024-01", digest)], log)).first()
    assert not changed.ok and changed.message.startswith("CONFIG MISMATCH") and "other" in changed.message


def test_references_and_health(spark):
    names = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "metric string")
    got = A.metric_references(names, names.where("metric <> 'b'"), names.where("metric = 'a'")).collect()
    assert sorted(map(tuple, got)) == [("b", 2, "direction, source"), ("c", 1, "source")]
    found = spark.createDataFrame([("prices", 3, 10, dt.date(2024, 1, 30)), ("deals", 1, 0, None), ("index", 1, 5, dt.date(2023, 1, 1))],
                                  "source string, n_files long, n_rows long, latest_date date")
    expected = {"prices": (3, True), "deals": (3, True), "index": (3, False), "holdings": (90, False)}
    health = A.source_health(found, "2024-01-31", expected)
    assert {r.source: (r.status, r.level) for r in health.collect()} == {
        "prices": ("ok", "ok"), "deals": ("empty", "error"), "index": ("stale", "warning"), "holdings": ("missing", "warning")}
    assert tuple(A.overall_health(health).first()) == ("error", 1, 1, 1, 1)
    assert A.overall_health(health.where("level <> 'error'")).first().overall_status == "warning"


def test_survivorship_of_every_month(spark):
    chance = random.Random(2)
    life = []
    for _ in range(300):
        start = dt.date(2000, 1, 1) + dt.timedelta(chance.randrange(900))
        life.append((start, start + dt.timedelta(chance.randrange(600)) if chance.random() < 0.5 else None))
    rows = A.survivorship_series(spark.createDataFrame([*life, (None, dt.date(2000, 5, 5))], "list_date date, delist_date date")).collect()
    for r in rows:
        alive = [d for a, d in life if a <= r.month_end and (d is None or d > r.month_end)]
        assert (r.n_surviving, r.n_later_failed) == (alive.count(None), len(alive) - alive.count(None))
    assert [r.month_end for r in rows] == sorted(r.month_end for r in rows) and len(rows) > 30
    assert A.survivorship_series(spark.createDataFrame([], "list_date date, delist_date date")).count() == 0


def test_audit_is_clear_only_without_blockers(spark):
    weights = spark.createDataFrame(S.weight_rows(), WEIGHTS)
    survival = spark.createDataFrame([("2020-01-01", 90, 10, 100, 10.0, "High")], "as_of_date string, n_surviving long, n_later_failed long, total_universe long, pct_missing double, bias_severity string")
    runs = spark.createDataFrame([(1, dt.date(2021, 1, 1)), (2, dt.date(2025, 1, 1))], "run_id int, end_date date")
    log = spark.createDataFrame([("2024-06-01", "x")], "timestamp string, new_config_hash string")

    def levels(*args):
        return {r.check: r.level for r in A.bias_audit(*args).collect()}

    assert levels(survival, runs, weights, log) == {
        "survivorship": "blocker", "period:holdout": "blocker", "period:development": "ok", "config": "blocker", "weight_log": "warning", "all_clear": "blocker"}
    fine = survival.replace("High", "Low")
    assert levels(fine, runs, weights, log.where("false"), "live") == {"survivorship": "ok", "period": "ok", "config": "ok", "weight_log": "ok", "all_clear": "ok"}
