"""Nearest facts on a time line, and session files, against plain versions."""

import datetime as dt
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ratewell.operators.asof import nearest_day_join
from ratewell.operators.backtest import forward_returns, run_changes
from ratewell.sources import files as L
from ratewell.sources import sinks
from ratewell.sources.dated import read_dated, write_dated

DAY = dt.date(1969, 12, 20)


@pytest.mark.parametrize("range_days,tolerance", [(1024, 5), (3, 5), (7, 0), (4, 2)])
def test_nearest_day_over_borders(spark, range_days, tolerance):
    """Ranges shorter than the tolerance, days before 1970, null keys and days: the same rows as by definition."""
    chance = random.Random(range_days)
    facts = [(k, DAY + dt.timedelta(d), chance.random()) for k in "ab" for d in range(60) if chance.random() < 0.3] + [("a", None, 1.0), (None, DAY, 2.0)]
    asked = [(chance.choice("abc"), DAY + dt.timedelta(chance.randrange(-8, 68)), i) for i in range(200)] + [(None, DAY, 500), ("a", None, 501)]
    got = nearest_day_join(spark.createDataFrame(asked, "k string, day date, id int"), spark.createDataFrame(facts, "k string, d date, v double"),
                           ["k"], "day", "d", ["v"], tolerance, range_days)
    assert got.columns == ["k", "day", "id", "near_day", "v"]
    want = {}
    for k, day, i in asked:
        near = [(abs((d - day).days), -(d - day).days, d, v) for f, d, v in facts if f == k and k and d and day and abs((d - day).days) <= tolerance]
        want[i] = min(near)[2:] if near else (None, None)
    assert {r.id: (r.near_day, r.v) for r in got.collect()} == want


def test_forward_returns_ask_once_per_horizon(spark):
    bars = spark.createDataFrame([("A", DAY, 10.0), ("A", DAY + dt.timedelta(34), 12.0), ("B", DAY, 0.0)], "ticker string, date date, close double")
    recs = spark.createDataFrame([(DAY, "A", 1), (DAY, "B", 2), (DAY, "C", 3)], "run_date date, ticker string, score int")
    out = forward_returns(recs, bars)
    assert [(r.ticker, r.score, r.entry_price, r.return_1M, r.return_3M) for r in out.collect()] == [("A", 1, 10.0, 20.0, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "Join" not in plan  # the dates a row asks for, and closes near a border


def _head(n):
    return "TradDt,TckrSymb,SctySrs,ClsPric\n" + "".join(f"2024-01-0{n},T{i},EQ,{i}.5\n" for i in range(3))


def test_old_files_are_never_opened(spark, tmp_path):
    for n in range(1, 6):
        with zipfile.ZipFile(tmp_path / f"BhavCopy_NSE_CM_0_0_0_2024010{n}_F_0000.csv.zip", "w") as z:
            z.writestr("x.csv", _head(n))
    for n in (1, 2):
        (tmp_path / f"BhavCopy_NSE_CM_0_0_0_2024010{n}_F_0000.csv.zip").write_bytes(b"broken")
    assert {str(r.date) for r in L.read_daily_bars(spark, str(tmp_path), "2024-01-04", sessions=2).collect()} == {"2024-01-03", "2024-01-04"}
    columns = {"close": ["ClsPric"], "none": ["Missing"]}
    rows = read_dated(spark, str(tmp_path), "bars", columns, since="2024-01-03")
    assert rows.where("session > date '2024-01-03' and close <> '1.5'").count() == 4 and rows.count() == 9
    assert rows.where("session in (date '2024-01-05')").select("row_number", "close", "none").collect()[2][:] == (2, "2.5", None)
    with pytest.raises(Exception, match="zip"):
        read_dated(spark, str(tmp_path), "bars", columns).count()


def test_written_files_read_back(spark, tmp_path):
    rows = spark.range(5000).select(F.date_add(F.lit("2024-02-27").cast("date"), (F.col("id") % 4).cast("int")).alias("session"),
                                    F.concat(F.lit("a,\"b"), F.col("id").cast("string")).alias("SYMBOL"), (F.col("id") / 7).alias("DELIV_PER"))
    for separator, name in ((",", "sec_del_eq_%d%m%Y.csv"), ("|", "sec_del_eq_%d%m%Y.zip")):
        path = str(tmp_path / name[-3:])
        write_dated(rows, path, name, separator)
        write_dated(rows, path, name, separator)
        names = sorted(p.name for p in (tmp_path / name[-3:]).iterdir())
        assert names == sorted(dt.date(2024, 2, d).strftime(name) if d < 30 else dt.date(2024, 3, 1).strftime(name) for d in (27, 28, 29, 30))
        if name.endswith("csv"):
            back = read_dated(spark, path, "delivery", {"SYMBOL": ["symbol"], "DELIV_PER": ["deliv per"]})
            same = back.select("session", "SYMBOL", F.col("DELIV_PER").cast("double").alias("DELIV_PER"))
            assert same.exceptAll(rows).count() == 0 and back.count() == 5000
    with pytest.raises(Exception, match="no session"):
        write_dated(spark.sql("select cast(null as date) as session, 'a' as SYMBOL"), str(tmp_path / "n"), "MTO_%d%m%Y.DAT")


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([("A", "a", "Investable", 1.0), ("B", "b", "Watchlist", 2.0)], "ticker string, name string, investability_status string, opportunity_score double")
    for day, part in (("2024-01-01", rows), ("2024-02-01", rows.where("ticker = 'A'")), ("2024-03-01", rows), ("2024-01-01", rows)):
        sinks.append_history(part, path, day)
    history = spark.read.parquet(path)
    assert history.count() == 5
    got = sorted((r.ticker, str(r.run_date), r.prior_status) for r in run_changes(history).collect())
    assert got == [("A", "2024-01-01", "New"), ("B", "2024-01-01", "New"), ("B", "2024-03-01", "New")]


def test_unreadable_documents_are_kept_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ticker": "A", "score": "x", "extra": [1]}')
    (tmp_path / "b.json").write_text('{"ticker": ')
    (tmp_path / "c.json").write_text(" ")
    docs = L.read_entity_documents(spark, str(tmp_path), "ticker string, score double")
    assert [tuple(r) for r in docs.collect()] == [("A", None)]
    assert sorted((r.file.rsplit("/", 1)[1], r.n_chars) for r in L.unreadable_documents(spark, str(tmp_path)).collect()) == [("b.json", 11), ("c.json", 1)]
    deals = spark.createDataFrame([('{"BULK_DEALS_DATA": [{"symbol": "a", "buySell": "buy", "quantityTraded": 5}], "BLOCK_DEALS_DATA": [{"symbol": "b"}]}',), ('{"BLOCK',), (None,), ("{}",)], "payload string")
    assert sorted((r.symbol, r.deal_type, r.quantity) for r in L.large_deals(deals).collect()) == [("A", "bulk", 5.0), ("B", "block", 0.0)]
    assert L.unreadable_payloads(deals).count() == 1
