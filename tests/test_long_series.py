"""Indicators over series of any length, with gaps and flat stretches, against the plain recursions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ratewell.operators import bars as B

START = dt.date(1980, 1, 1)
BARS = "ticker string, date date, open double, high double, low double, close double, volume double, traded_value double"


def walk(seed, n, flat=()):
    chance, close, rows = random.Random(seed), 100.0, []
    for i in range(n):
        if not any(a <= i < b for a, b in flat):
            close = max(1.0, close * (1 + chance.gauss(0, 0.02)))
            high, low = close * (1 + chance.random() * 0.02), close * (1 - chance.random() * 0.02)
        else:
            high = low = close
        rows.append((START + dt.timedelta(i), high, low, close))
    return rows


def adx(rows, p=14):
    """Trend strength by Wilder's recursions as they are written."""
    true, plus, minus = [], [], []
    for (_, _, _, c0), (_, h0, l0, _), (_, h, l, _) in zip(rows, rows, rows[1:]):
        up, down = h - h0, l0 - l
        true.append(max(h - l, abs(h - c0), abs(l - c0)))
        plus.append(up if up > down and up > 0 else 0.0)
        minus.append(down if down > up and down > 0 else 0.0)

    def smooth(x):
        state = [sum(x[:p]) / p]
        for v in x[p:]:
            state.append((state[-1] * (p - 1) + v) / p)
        return state

    a, u, d = map(smooth, (true, plus, minus))
    dx = []
    for x, y, z in zip(a, u, d):
        base = x if x else 1e-10
        y, z = y / base * 100, z / base * 100
        dx.append(abs(y - z) / ((y + z) or 1e-10) * 100)
    return min(100, max(0, 50 + smooth(dx)[-1] * (0.5 if u[-1] > d[-1] else -0.5)))


@pytest.mark.parametrize("segment", [16, 512])
def test_trend_strength_of_ten_thousand_bars(spark, segment):
    series = {"long": walk(1, 10_000), "flat": walk(2, 3000, flat=[(700, 2100)]), "still": walk(3, 900, flat=[(0, 900)]), "short": walk(4, 29), "few": walk(5, 28),
              "edge": walk(6, 513), "late": walk(7, 1100, flat=[(500, 1100)])}
    bars = spark.createDataFrame([(t, d, c, h, l, c, 1.0, 1.0) for t, rows in series.items() for d, h, l, c in rows], BARS)
    index = B.index_series(bars)
    got = {r.ticker: r.trend_strength for r in B.momentum_metrics(bars, index, segment=segment).collect()}
    assert got["few"] is None
    for ticker, rows in series.items():
        if ticker != "few":
            assert got[ticker] == pytest.approx(adx(rows), abs=0.0051), ticker


def test_volume_needs_sixty_volumes(spark):
    """Missing volumes are passed over: the means go over bars that have one, and 60 (30) of those are needed."""
    chance = random.Random(9)
    rows = [(t, START + dt.timedelta(i), 9.0, 10.0, 8.0, 9.0 + i / 100, None if chance.random() < gap else float(i), None if chance.random() < gap else 1e7 * i)
            for t, n, gap in (("full", 130, 0), ("gaps", 130, 0.3), ("few", 70, 0.3)) for i in range(n)]
    got = {r.ticker: r for r in B.price_metrics(spark.createDataFrame(rows, BARS)).collect()}
    for t in ("full", "gaps", "few"):
        volumes, values = ([r[k] for r in rows if r[0] == t and r[k] is not None] for k in (6, 7))
        want = sum(volumes[-20:]) / 20 / (sum(volumes[-60:]) / 60) if len(volumes) >= 60 else None
        assert got[t].volume == (pytest.approx(want, abs=5.1e-5) if want else None)
        assert got[t].avg_daily_turnover_cr == pytest.approx(sum(values[-30:]) / 30 / 1e7, abs=0.0051)


def test_one_of_several_indices(spark):
    rows = walk(11, 300)
    bars = spark.createDataFrame([("A", d, c, h, l, c, 1.0, 1.0) for d, h, l, c in rows], BARS)
    one = B.index_series(bars)
    both = one.unionByName(B.index_series(bars.withColumn("close", F.col("close") * F.rand(3)), "OTHER"))
    assert B.momentum_metrics(bars, both).collect() == B.momentum_metrics(bars, one).collect()
    assert B.relative_strength_turn(bars, both).collect() == B.relative_strength_turn(bars, one).collect()
    assert B.momentum_metrics(bars, both, index_name="OTHER").first().dual_momentum != B.momentum_metrics(bars, one).first().dual_momentum


def test_bars_and_their_windows_share_one_shuffle(spark, tmp_path):
    """Lines are dealt out by ticker once; what reads bars once writes none; big tables get more tasks."""
    from ratewell.catalog.metrics import bars_once
    from ratewell.operators.ordered import spread
    from ratewell.sources import tables as T

    folder = "/root/testdata/sf0.001"
    plan = B.price_metrics(T.daily_bars(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1 and plan.count("Exchange") == 1
    assert not bars_once(spark, str(tmp_path.joinpath("x").symlink_to(folder) or tmp_path / "x")).inputFiles()[0].count("/bars-")
    assert spread(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10
