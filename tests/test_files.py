"""File formats, writers and incremental runs on files made here."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from ratewell.operators.backtest import label_changes
from ratewell.sources import files as L
from ratewell.sources import sinks
from ratewell.streaming import incremental as I


def _zip(path, member, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.md", "x")
        z.writestr(member, text)


def test_daily_bars_from_archives(spark, tmp_path):
    head = "TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal\n"
    _zip(tmp_path / "BhavCopy_NSE_CM_0_0_0_20240301_F_0000.csv.zip", "a.csv",
         head + "2024-03-01,abc,EQ,1,2,0.5,1.5,1,\"1,000\",1500\n2024-03-01,ABC,EQ,1,2,0.5,1.6,1,1000,1500\n2024-03-01,ABC,BE,9,9,9,9,9,9,9\n")
    _zip(tmp_path / "BhavCopy_NSE_CM_0_0_0_20240304_F_0000.csv.zip", "b.csv", head + "2024-03-04,ABC,EQ,1,2,0.5,-,1,1,1\n2024-03-04,XYZ,EQ,3,3,3,3,3,3,3\n")
    _zip(tmp_path / "cm05MAR2024bhav.csv.zip", "c.csv", "SYMBOL,SERIES,DATE1,CLOSE_PRICE\nABC, EQ ,2024-03-05,7\n")
    _zip(tmp_path / "BhavCopy_NSE_CM_0_0_0_20240306_F_0000.csv.zip", "d.csv", head + "2024-03-06,ABC,EQ,1,2,0.5,9,1,1,1\n")
    (tmp_path / "notes.csv").write_text("SYMBOL\nZZZ\n")
    bars = L.read_daily_bars(spark, str(tmp_path), "2024-03-05")
    got = {(r.ticker, str(r.date)): (r.close, r.volume) for r in bars.collect()}
    assert got == {("ABC", "2024-03-01"): (1.6, 1000.0), ("ABC", "2024-03-04"): (None, 1.0), ("XYZ", "2024-03-04"): (3.0, 3.0),
                   ("ABC", "2024-03-05"): (7.0, None)}
    wanted = spark.createDataFrame([("XYZ",)], "ticker string")
    assert [r.ticker for r in L.read_daily_bars(spark, str(tmp_path), tickers=wanted).collect()] == ["XYZ"]
    assert {str(r.date) for r in L.read_daily_bars(spark, str(tmp_path), "2024-03-05", sessions=1).collect()} == {"2024-03-05"}


def test_delivery_in_any_separator(spark, tmp_path):
    (tmp_path / "sec_del_eq_01032024.csv").write_text("SYMBOL,SERIES,DELIV_PER\nabc,EQ,40.5\nABC,BE,1\n")
    (tmp_path / "MTO_04032024.DAT").write_text("SYMBOL|SERIES|TRADED_QTY|DELIVERABLE_QTY\nABC|EQ|200|50\nZERO|EQ|0|5\n")
    _zip(tmp_path / "sec_del_eq_05032024.zip", "x.txt", "SYMBOL\tSERIES\tDELIV_PER\nABC\tEQ\t-\nQQQ\tEQ\t10\n")
    got = {(r.symbol, str(r.date)): r.delivery_pct for r in L.read_delivery(spark, str(tmp_path), "2024-03-31").collect()}
    assert got == {("ABC", "2024-03-01"): 40.5, ("ABC", "2024-03-04"): 25.0, ("QQQ", "2024-03-05"): 10.0}


def test_index_closes(spark, tmp_path):
    (tmp_path / "ind_close_all_12Mar2026.csv").write_text("Index Name,Closing Index Value\nNifty 500,\"1,000.5\"\nOther,2\n")
    got = [(r.index_name, r.date, r.close) for r in L.read_index_closes(spark, str(tmp_path)).collect()]
    assert got == [("nifty500", dt.date(2026, 3, 12), 1000.5)]


def test_holdings_and_manifest(spark, tmp_path):
    (tmp_path / "shareholding_2024-03-31.csv").write_text("symbol,fii_holding_pct,mf_holding_pct\nabc,10.5%,nan\n")
    row = L.read_holdings(spark, str(tmp_path)).first()
    assert (row.symbol, row.as_of, row.fii_holding_pct, row.mf_holding_pct) == ("ABC", dt.date(2024, 3, 31), 10.5, None)
    entry = L.manifest(spark, str(tmp_path)).first()
    assert entry.file == "shareholding_2024-03-31.csv" and len(entry.hash) == 12


def test_entity_documents_skip_broken_files(spark, tmp_path):
    (tmp_path / "stock_A.json").write_text(json.dumps({"ticker": "A", "cards": {"growth": {"score": 5.0}}}, indent=2))
    (tmp_path / "stock_B.json").write_text("{ broken")
    docs = L.read_entity_documents(spark, str(tmp_path), "ticker string, cards struct<growth:struct<score:double>>")
    assert [(r.ticker, r.cards.growth.score) for r in docs.where("ticker is not null").collect()] == [("A", 5.0)]


def test_html_ratios_and_tables(spark):
    html = ('<ul id="top-ratios"><li class="x"><span class="name">Stock P/E</span><span class="nowrap number">22.5</span></li>'
            '<li><span class="name">Price</span> ₹ <span class="number">1,200</span></li></ul>'
            "<table><thead><tr><th></th><th>2023</th></tr></thead><tbody><tr><td>Sales +</td><td>1,000</td><td>2 000</td></tr>"
            "<tr><td></td><td>9</td></tr></tbody></table>")
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.label, r.value) for r in L.list_values(pages).orderBy("pos").collect()] == [("Stock P/E", 22.5), ("Price", 1200.0)]
    assert [(r.label, r.cells) for r in L.table_rows(pages).collect()] == [("Sales", ["1000", "2 000"])]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "symbol string, v int")
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "symbol"], order=["symbol"])
    back = L.read_text_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["v", "symbol"] and [r.symbol for r in back.collect()] == ["a", "b"]
    sinks.write_csv(df.where("v > 9"), str(tmp_path / "e"))
    assert L.read_text_csv(spark, str(tmp_path / "e")).columns == ["symbol", "v"]
    for day in ("2024-01-01", "2024-01-02"):
        sinks.append_history(df, str(tmp_path / "h"), day)
    assert spark.read.parquet(str(tmp_path / "h")).groupBy("run_date").count().count() == 2
    docs = df.select("symbol", F.struct("symbol", "v").alias("document"))
    sinks.write_documents(docs, str(tmp_path / "d"), "2024-01-02")
    assert spark.read.json(str(tmp_path / "d")).count() == 2


def test_identical_runs_have_no_label_changes(spark):
    run = spark.createDataFrame([("A", "a", "Investable", 70.0)], "ticker string, name string, investability_status string, opportunity_score double")
    assert label_changes(run, run, "2024-01-01").count() == 0
    assert label_changes(run, run.where("false"), "2024-01-01").first().prior_status == "New"


def _feed(spark, folder, rows):
    spark.createDataFrame(rows, "key long, ts timestamp, value double, id long").coalesce(1).write.mode("append").parquet(folder)


def test_streams_continue_over_runs(spark, tmp_path):
    """Late ticks revise their day, late days the alert of the day after; compaction changes nothing."""
    source = str(tmp_path / "in")
    day = dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc)

    def at(days, hours=0):
        return day + dt.timedelta(days=days, hours=hours)

    def ticks():
        return spark.readStream.schema("key long, ts timestamp, value double, id long").parquet(source)

    def labelled():
        return ticks().withColumn("label", F.when(F.col("value") > 30, "High").otherwise("Low"))

    folder, label_folder = str(tmp_path / "bars"), str(tmp_path / "labels")

    def bars():
        return {(r.key, str(r.date)): (r.open, r.high, r.low, r.close, r.ticks) for r in I.daily_bars(ticks(), folder).collect()}

    def alerts():
        return {(r.key, str(r.run_date)): (r.prior_label, r.new_label) for r in I.label_alerts(labelled(), label_folder).collect()}

    _feed(spark, source, [(1, day, 10.0, 1), (1, at(0, 1), 50.0, 2), (2, day, 5.0, 3), (1, at(100), 9.0, 4)])
    assert bars()[1, "2024-01-01"] == (10.0, 50.0, 10.0, 50.0, 2)
    assert alerts() == {(1, "2024-01-01"): ("New", "High"), (2, "2024-01-01"): ("New", "Low"), (1, "2024-04-10"): ("High", "Low")}
    I.compact(spark, folder)
    I.compact(spark, folder)
    _feed(spark, source, [(1, at(0, 2), 20.0, 5), (2, at(1), 6.0, 6), (1, at(0, -1), 7.0, 7), (1, at(-60), 40.0, 8)])
    want = {(1, "2024-01-01"): (7.0, 50.0, 7.0, 20.0, 4), (2, "2024-01-01"): (5.0,) * 4 + (1,), (2, "2024-01-02"): (6.0,) * 4 + (1,),
            (1, "2024-04-10"): (9.0,) * 4 + (1,), (1, "2023-11-02"): (40.0,) * 4 + (1,)}
    assert bars() == want
    I.compact(spark, folder)
    assert {(r.key, str(r.date)): (r.open, r.high, r.low, r.close, r.ticks) for r in I.bars_so_far(spark, folder).collect()} == want
    assert len(list((tmp_path / "bars" / "compacted").iterdir())) == 1
    # the first day is Low now and after a High one; the alert of April no longer holds
    assert alerts() == {(1, "2023-11-02"): ("New", "High"), (1, "2024-01-01"): ("High", "Low"), (2, "2024-01-01"): ("New", "Low")}


def test_entity_documents_in_few_folders(spark, tmp_path):
    """A file per entity without a folder for each; writing again leaves the same files."""
    docs = spark.range(1000).select(F.concat(F.lit("e"), "id", F.lit(".json")).alias("name"), F.to_json(F.struct(F.col("id").alias("n"))).alias("text"))
    for _ in range(2):
        assert sinks.write_entity_documents(docs.repartition(4), str(tmp_path), "name", "text") == 1000
    found = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert len(found) == 1000 and len(list(tmp_path.iterdir())) <= 256
    assert sorted(r.n for r in L.read_entity_documents(spark, str(tmp_path), "n bigint").collect()) == list(range(1000))
    assert L.unreadable_documents(spark, str(tmp_path)).count() == 0


def test_label_alerts_are_reduced_before_they_are_kept(spark, tmp_path):
    """A micro-batch leaves a row per key and day, whatever ticks it had; compaction changes no alert."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "labels")
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    _feed(spark, source, [(k, day + dt.timedelta(days=d, minutes=m), float(60 * (d % 2)), m) for k in range(3) for d in range(4) for m in range(50)])

    def alerts():
        ticks = spark.readStream.schema("key long, ts timestamp, value double, id long").parquet(source)
        return sorted(map(tuple, I.label_alerts(ticks.withColumn("label", F.when(F.col("value") > 30, "High").otherwise("Low")), folder).collect()))

    first = alerts()
    assert len(first) == 12 and spark.read.parquet(f"{folder}/results").count() == 12
    I.compact(spark, folder, I.merged_labels)
    assert alerts() == first
