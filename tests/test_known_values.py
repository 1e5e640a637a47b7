"""Exact values the scoring rules are known to give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions import formulas as M
from ratewell.functions.numeric import clamp, rounded
from ratewell.functions.taxonomy import template_code
from ratewell.functions.text import clean_symbol, parse_date, parse_events, parse_number, parse_stage
from ratewell.operators import bars as B
from ratewell.operators import quality as K
from ratewell.operators.cards import score_maps, with_cards
from ratewell.operators.overlays import portfolio_plan
from ratewell.operators.schema import prefixed
from ratewell.plans.rating import rate_universe, score_universe
from ratewell.plans.universe import apply_classification, load_universe, missing_classification, prepare_universe, universe_frame


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lit(x):
    return F.lit(x).cast("double")


def export(spark, *rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n, "") for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


BASE = {"NSE Symbol": "aaa", "Name": "Alpha", "Macro Sector": "Technology", "Sector": "Technology", "Industry": "Software",
        "Basic Industry": "Computers - Software & Consulting"}


def test_unrated_distress(spark):
    assert one(spark, M.distress_risk(lit(1.2), lit(2.5), F.lit(None).cast("int"))) == 25.0
    assert one(spark, M.distress_risk(lit(None), lit(None), F.lit(None).cast("int"))) == 0.0
    assert one(spark, M.distress_risk(lit(6), lit(0.5), F.lit(8))) == 100.0


def test_intrinsic_value_gap(spark):
    row = load_universe(export(spark, BASE | {
        "EPS FY0": "10", "EPS FY1": "11", "EPS FY2": "9", "EPS TTM": "10", "Book Value Per Share": "40",
        "Current Price": "100", "Intrinsic Value": "500"})).first()
    assert round(row.iv_gap, 2) == -20.0 and row.iv_gap == row.discount_to_iv


def test_roe_adjusted_pb(spark):
    bank = BASE | {"Sector": "Financial Services", "Macro Sector": "Financial Services", "Industry": "Banking",
                   "Basic Industry": "Private Sector Bank", "Price to Book value": "2.0", "ROE": "16"}
    row = load_universe(export(spark, bank)).first()
    assert (row.template, row.roe_adj_pb) == ("B", 0.125) and row.fair_value_gap is not None
    row = load_universe(export(spark, BASE | {"Price to Book value": "3.0", "ROE": "15"})).first()
    assert (row.template, row.roe_adj_pb, row.fair_value_gap) == ("A", 0.2, None)


def test_prefixed_aliases(spark):
    row = load_universe(export(spark, BASE | {
        "fund__P/E": "22.5", "fund__Margin Trend": "1.25", "fund__FCF Consistency": "80%", "fund__Growth Stability": "72"})).first()
    assert (row.pe_percentile, row.margin_trend, row.fcf_consistency, row.growth_stability) == (22.5, 1.25, 80.0, 72.0)
    twice = prefixed(prefixed(spark.createDataFrame([("a", 1)], "k string, `fund__x` int"), "k"), "k")
    assert twice.columns == ["k", "fund__x"]


def test_fund_like_rows_and_last_duplicate(spark):
    rows = export(spark, BASE | {"Name": "Sample Banking ETF", "NSE Symbol": "ETF1", "n": "1"}, BASE | {"P/E": "1", "n": "2"},
                  BASE | {"P/E": "2", "n": "3"}, {"NSE Symbol": " ", "n": "4"})
    got = load_universe(rows, arrival="n").collect()
    assert [(r.ticker, r.pe_percentile) for r in got] == [("AAA", 2.0)]


def test_taxonomy_defaults(spark):
    row = load_universe(export(spark, {"NSE Symbol": "X", "Industry": "Steel", "Basic Industry": "diversified"})).first()
    assert (row.name, row.sector, row.industry, row.basic_industry) == ("X", "Diversified", "Steel", "Steel")


@pytest.mark.parametrize("labels,code", [
    (("Financial Services", "Financial Services", "Banking", "Private Sector Bank"), "B"),
    (("Financial Services", "Financial Services", "Non Banking Financial Company (NBFC)", "Finance"), "C"),
    (("Financial Services", "Financial Services", "Investment Company", "Finance"), "A"),
    (("Financial Services", "Financial Services", "Other Financial Services", "Finance"), "C"),
    (("", "", "", ""), "A")])
def test_template_routing(spark, labels, code):
    assert one(spark, template_code(*[F.lit(x) for x in labels])) == code


def test_cagr_and_growth_need_positive_values(spark):
    assert one(spark, M.cagr(lit(-4.18), lit(2.28), 3)) is None
    assert one(spark, M.yoy_growth(lit(5), lit(0)), M.price_return(lit(5), lit(0))) == (None, None)


def test_nulls_pass_through_clamps(spark):
    assert one(spark, clamp(lit(None), 0, 100), rounded(lit(None)), M.funding_risk(lit(None)), M.capital_risk(lit(None))) == (
        None, None, None, None)
    assert round(one(spark, M.provision_risk(lit(None))), 1) == 33.3
    assert one(spark, M.piotroski(lit(1), lit(1), lit(None), lit(None), *[lit(None)] * 8)) is None
    assert one(spark, M.piotroski(lit(1), lit(1), lit(0), lit(2), *[lit(None)] * 8)) == 100.0


def test_parsing(spark):
    values = ["1,234.5%", "₹ 12 Cr", "nan", "-", "", "1d", "NaN", "Infinity", "1e3", "-.5", "abc"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(parse_number(F.col("x"))).collect()]
    assert got == [1234.5, 12.0, None, None, None, None, None, None, 1000.0, -0.5, None]
    assert one(spark, parse_date(F.lit("05MAR2024")), parse_date(F.lit("20240305")), parse_date(F.lit("x"))) == (
        dt.date(2024, 3, 5), dt.date(2024, 3, 5), None)
    assert one(spark, parse_stage(F.lit("Stage 2")), parse_stage(F.lit("?"))) == (2, 1)
    assert one(spark, parse_events(F.lit("a, b ; c;"))) == ["a, b", "c"]
    assert one(spark, clean_symbol(F.lit(" tcs.ns ")), clean_symbol(F.lit("None"))) == ("TCS", "")


def test_governance_and_disqualifiers(spark):
    events = F.array(F.lit("agm_delayed"), F.lit("nse_action_suspension"), F.lit("unknown"))
    assert one(spark, M.governance_risk(events)) == 100.0
    null = lit(None)
    messages = one(spark, M.disqualifiers(F.lit(3), F.lit(0), lit(0.5), F.lit(8), lit(75), lit(16), null, lit(9), null, null,
                                          lit(0.2), events))
    assert messages == [
        "ASM Stage 3 active", "Interest Coverage 0.50x < 1.0", "Credit Rating in Default category (grade 8)",
        "Promoter Pledge 75.0% > 60%", "GNPA 16.0% > 15%", "CAR 9.0% < 10%", "Daily Turnover ₹0.20Cr < ₹0.25Cr",
        "Governance disqualifier: ['nse_action_suspension']"]


def test_weights_sum_to_one(spark):
    schema = "template string, card string, metric string, pos int, weight double"
    good = spark.createDataFrame(S.weight_rows(), schema)
    assert K.check_weights(good).count() == 0
    bad = good.where("not (template = 'A' and card = 'growth')").withColumn("weight", F.expr("if(metric = 'nim', 0.5D, weight)"))
    assert {(r.template, r.card, r.problem) for r in K.check_weights(bad).collect()} == {
        ("A", "growth", "card missing"), ("B", "profitability", "weights sum to 1.300000"),
        ("C", "profitability", "weights sum to 1.300000")}


def bars_fixture(spark, days=130):
    first = dt.date(2025, 8, 1)
    return spark.createDataFrame(
        [("AAA", first + dt.timedelta(i), 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1000.0 + i, 1e7 + 1000 * i) for i in range(days)],
        "ticker string, date date, open double, high double, low double, close double, volume double, traded_value double")


def test_bars_override_export_values(spark):
    row = load_universe(export(spark, BASE | {"6 Month Return": "999", "Price vs 50 DMA": "999", "Current Price": "1",
                                              "1 Year Return": "55"}), bars_fixture(spark)).first()
    assert row.close_price == 229.0 and row.return_6m == round((229 / 103 - 1) * 100, 2) and row.price_vs_50dma != 999
    assert row.return_1y == 55.0  # too few bars: the export value stays


def test_short_series_give_nulls(spark):
    row = B.price_metrics(bars_fixture(spark, 14)).first()
    assert row.close_price == 113.0
    assert [row[c] for c in ("return_1y", "return_6m", "rsi_state", "price_vs_50dma", "volatility_compression", "volume")] == [None] * 6
    rising = B.price_metrics(bars_fixture(spark, 70)).first()
    assert rising.rsi_14 == 100.0 and rising.rsi_state == 5.0


def _stock(ticker, pe, growth, **more):
    raw = {"P/E": pe, "Sales growth": growth, "Price to Book value": "3", "FCF Yield": "4", "IV Gap": "10", "ROE": "15",
           "Dividend Yield": "2", "Sales growth 3Years": growth, "Profit growth 3Years": "10", "Profit growth": "9",
           "Peer Growth Rank": "50", "Growth Stability": "70", "ROCE 3Years": "20", "OPM": "18", "CFO/PAT": "1.1",
           "Margin Trend": "1", "ROA": "9", "FCF Consistency": "80", "1 Year Return": "12", "6 Month Return": "6",
           "Relative Strength": "60", "Drawdown Recovery": "70", "Forward Growth": "11", "RSI": "55", "Price vs 200 DMA": "3",
           "Price vs 50 DMA": "1", "Delivery Score": "50", "RS Turn": "0.1", "Volatility Compression": "20",
           "Pledged percentage": "5", "Beneish M Score": "-3", "Avg Daily Turnover Cr": "60", "Debt to equity": "0.4",
           "Interest Coverage": "8", "Credit Rating Grade": "2"}
    return BASE | {"NSE Symbol": ticker, "Name": ticker} | raw | more


def test_rating_run_on_three_stocks(spark):
    rows = rate_universe(load_universe(export(spark, _stock("AAA", "24", "2"), _stock("BBB", "28", "1"), _stock("CCC", "30", "0.5"))))
    got = {r.ticker: r for r in rows.collect()}
    assert set(got) == {"AAA", "BBB", "CCC"}
    for r in got.values():
        assert r.peer_level == "Sector" and r.n_peers == 2
        assert r.selection_score is not None and r.expected_downside_pct is not None and r.staged_entry_plan
        assert r.sector_rank in (1, 2, 3) and r.market_mode in ("bull", "neutral", "bear")
        assert r.recommendation in ("Buy Candidate", "Watchlist", "Avoid")
    assert got["AAA"].scores["pe_percentile"] == 100.0 and got["CCC"].scores["pe_percentile"] == 0.0
    assert sorted(r.sector_rank for r in got.values()) == [1, 2, 3]


def test_either_valuation_band_is_evidence(spark):
    """Seven points for a price-to-earnings or a price-to-book band, once."""
    from pyspark.sql import functions as F

    thin = {"P/E": "-", "FCF Yield": "-"}
    rows = load_universe(export(spark, *[_stock(t, "24", "2", **thin) for t in ("AAA", "BBB", "CCC", "DDD")]))
    rows = rows.withColumn("hist_val_band", F.when(F.col("ticker").isin("BBB", "DDD"), 78.0)).withColumn(
        "hist_pb_band", F.when(F.col("ticker").isin("CCC", "DDD"), 60.0))
    got = {r.ticker: (r.valuation_confidence_score, r.card_valuation.coverage) for r in rate_universe(rows).collect()}
    assert len({c for _, c in got.values()}) == 1 and got["AAA"][0] < 93
    assert [round(got[t][0] - got["AAA"][0], 6) for t in ("BBB", "CCC", "DDD")] == [7, 7, 7]


@pytest.mark.parametrize("more,severe", [
    ({"ASM Stage": "1"}, False), ({"ASM Stage": "3"}, True), ({"GSM Stage": "1"}, True),
    ({"Pledged percentage": "75"}, True), ({"Pledged percentage": "20", "Promoter Pledge Risk": "75"}, False)])
def test_hard_exclusions(spark, more, severe):
    rows = load_universe(export(spark, _stock("AAA", "24", "2", **more), _stock("BBB", "28", "1"), _stock("CCC", "30", "0.5")))
    card = with_cards(score_universe(rows, False)).where("ticker = 'AAA'").first().card_red_flags
    assert (card.label == "Severe" and card.score == 15.0) == severe
    assert card.rankable


def test_single_entity_is_neutral(spark):
    row = score_universe(load_universe(export(spark, BASE | {"P/E": "10"})), False).first()
    assert row.scores["pe_percentile"] == 50.0 and row.n_peers == 0


@pytest.mark.parametrize("card,present,rankable", [
    # weights add up to .65 on paper; in configured order one sum lands on the threshold, the other just below
    ("performance", ("return_1y", "return_6m", "cagr_5y", "drawdown_recovery"), True),
    ("entry_point", ("discount_to_iv", "price_vs_200dma", "price_vs_50dma", "rs_turn"), False)])
def test_coverage_at_the_threshold(spark, card, present, rankable):
    total = seen = 0.0
    for metric, weight in S.CARD_WEIGHTS["A"][card].items():
        total += weight
        seen += weight if metric in present else 0.0
    assert (seen / total >= S.CARD_COVERAGE_MIN) == rankable
    rows = spark.createDataFrame([("A", m, 60.0) for m in present], "ticker string, metric string, score double")
    base = load_universe(export(spark, BASE | {"NSE Symbol": "A"})).join(score_maps(rows), "ticker")
    assert with_cards(base).first()[f"card_{card}"].rankable is rankable


def test_sparse_and_generic_universes_are_blocked(spark):
    gates = {"min_universe": 2, "min_core_pct": 8.0, "min_core_cards": 3, "min_classified_pct": 90.0}
    text = " ".join(K.input_quality(load_universe(export(spark, BASE)), gates).first().blockers)
    assert "Universe too small" in text and "Core coverage too low" in text and "Classification" not in text
    text = " ".join(K.input_quality(load_universe(export(spark, {"NSE Symbol": "X"})), gates).first().blockers)
    assert "Classification coverage too low" in text


def test_unsupported_template_is_withdrawn(spark):
    rows = load_universe(export(spark, _stock("AAA", "24", "2"), _stock("BBB", "28", "1"), BASE | {
        "NSE Symbol": "BNK", "Industry": "Banking", "Basic Industry": "Private Sector Bank"}))
    quality = K.template_quality(rows)
    state = {r.template: (r.active, r.supported) for r in quality.collect()}
    assert state == {"A": (True, True), "B": (True, False), "C": (False, False)}
    got = {r.ticker: r for r in K.apply_template_support(rate_universe(rows), quality).collect()}
    assert got["BNK"].recommendation == "Unsupported" and got["BNK"].investability_status == "Unsupported Data"
    assert got["AAA"].template_supported and got["AAA"].recommendation != "Unsupported"


def test_universe_series_filter_and_classification(spark):
    eod = spark.createDataFrame([("RELIANCE", "EQ", "Reliance", 1), ("TESTBE", "BE", "Test", 2), ("reliance", "EQ", "copy", 3)],
                                "SYMBOL string, SERIES string, `NAME OF COMPANY` string, n int")
    assert [r["Name"] for r in universe_frame(eod, "n").collect()] == ["Reliance"]
    both = universe_frame(eod, "n", include_all_series=True)
    assert both.count() == 2
    master = spark.createDataFrame([("RELIANCE", "Energy", "Oil", "Refineries", 1)],
                                   "Symbol string, Sector string, Industry string, `Basic Industry` string, n int")
    filled = apply_classification(both, master, "n")
    assert {r.column_name: r.filled_pct for r in K.taxonomy_coverage(filled, ["Sector", "Macro Sector"]).collect()} == {
        "Sector": 50.0, "Macro Sector": 0.0}
    assert [r[0] for r in missing_classification(filled).collect()] == ["TESTBE"]
    assert prepare_universe(eod, None, "n").columns[:3] == ["NSE Symbol", "Name", "Macro Sector"]


def test_portfolio_constraints(spark):
    rows = spark.createDataFrame(
        [(f"T{i:03d}", f"S{i % 4 if i % 3 else 0}", "Buy Candidate", "High" if i % 5 else "Low", float(100 - i)) for i in range(80)],
        "ticker string, sector string, recommendation string, confidence string, selection_score double")
    plan = portfolio_plan(rows).collect()
    # greedy pick, one name after the other
    weight, used, want = min(100 / 18, 8.0), {}, []
    for r in sorted(rows.where("confidence <> 'Low'").collect(), key=lambda r: -r.selection_score):
        if len(want) < 18 and used.get(r.sector, 0.0) + weight <= 28.0 + 1e-9:
            used[r.sector] = used.get(r.sector, 0.0) + weight
            want.append(r.ticker)
    assert [r.ticker for r in plan] == want
    assert sum(r.suggested_weight_pct for r in plan) <= 100.1 and all(r.suggested_weight_pct <= 8.0 for r in plan)


def test_direction_flip_mirrors_scores(spark):
    from ratewell.operators.peers import peer_percentile, with_peer_level

    e = with_peer_level(spark.createDataFrame([(i, "b", "i", "s") for i in range(12)], "ticker long, basic_industry string, industry string, sector string"))
    plus = spark.createDataFrame([(i, "m", float(i * i)) for i in range(12)], "ticker long, metric string, value double")
    minus = plus.withColumn("value", -F.col("value"))
    a = {r.ticker: r.score for r in peer_percentile(e, plus, []).collect()}
    b = {r.ticker: r.score for r in peer_percentile(e, minus, ["m"]).collect()}
    assert a == b and all(0 <= v <= 100 for v in a.values())
    empty = plus.unionByName(spark.createDataFrame([(3, "m", None)], "ticker long, metric string, value double"))
    assert {r.ticker: r.score for r in peer_percentile(e, empty, []).collect()} == a
