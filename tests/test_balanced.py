"""The block plans for big groups give the results of brute force, with one group and one value holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.operators.asof import as_of_join
from ratewell.operators.ordered import (
    GRID, _below, cumulative_counts, exact_quantiles, match_groups, ordinal_ranks, upper_median, with_block, with_range)
from ratewell.operators.peers import first_peers, peer_percentile, with_peer_level

BLOCK = 16


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for i in range(400):
        group = "hot" if rng.random() < 0.6 else f"g{rng.integers(0, 12)}"
        value = 5.0 if rng.random() < 0.4 else float(np.round(rng.normal() * 10, 1))
        out.append((f"T{i:04d}", group, value))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_cumulative_counts(spark, rows, large):
    df = spark.createDataFrame(rows, "ticker string, g string, v double")
    got = {(r.g, r.v): (r.cnt, r.below, r.upto, r.n) for r in cumulative_counts(df, ["g"], "v", large, BLOCK).collect()}
    for (g, v), (cnt, below, upto, n) in got.items():
        values = np.array([x[2] for x in rows if x[1] == g])
        assert (cnt, below, upto, n) == ((values == v).sum(), (values < v).sum(), (values <= v).sum(), len(values))
    assert len(got) == len({(x[1], x[2]) for x in rows})


@pytest.mark.parametrize("large", [False, True])
def test_quantiles_and_upper_median(spark, rows, large):
    df = spark.createDataFrame(rows, "ticker string, g string, v double")
    for r in exact_quantiles(df, ["g"], "v", {"p3": 0.03, "p50": 0.5}, large, BLOCK).collect():
        values = [x[2] for x in rows if x[1] == r.g]
        assert r.p3 == pytest.approx(np.percentile(values, 3)) and r.p50 == pytest.approx(np.median(values))
    for r in upper_median(df, ["g"], "v", "m", large, BLOCK).collect():
        values = sorted(x[2] for x in rows if x[1] == r.g)
        assert r.m == values[len(values) // 2]


@pytest.mark.parametrize("large", [False, True])
def test_ordinal_ranks(spark, rows, large):
    df = spark.createDataFrame(rows, "ticker string, g string, v double")
    ranked = ordinal_ranks(df, ["g"], F.struct((-F.col("v")).alias("k"), "ticker"), "r", "n", large, BLOCK).collect()
    for r in ranked:
        order = sorted((-x[2], x[0]) for x in rows if x[1] == r.g)
        assert r.r == order.index((-r.v, r.ticker)) + 1 and r.n == len(order)
    assert len(ranked) == len(rows)


def test_match_groups_keeps_every_row(spark, rows):
    df = spark.createDataFrame(rows, "ticker string, g string, v double")
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.max("v").alias("top"))
    plain = match_groups(df, sizes, ["g"], "size", ["ticker"], False).orderBy("ticker").collect()
    spread = match_groups(df, sizes, ["g"], "size", ["ticker"], True, BLOCK).orderBy("ticker").collect()
    assert plain == spread and len(plain) == len(rows)


def _brute_scores(entities, values, lower):
    out = {}
    for t, basic, industry, sector in entities:
        for level, label in (("basic", basic), ("industry", industry), ("sector", sector)):
            at = {"basic": 1, "industry": 2, "sector": 3}[level]
            group = [e[0] for e in entities if e[at] == label]
            if level == "sector" or len(group) >= {"basic": S.PEER_MIN_BASIC_INDUSTRY, "industry": S.PEER_MIN_INDUSTRY}[level]:
                break
        if values.get(t) is None:
            continue
        peers = [values[p] for p in group if p != t and values.get(p) is not None]
        if not peers:
            out[t] = 50.0
            continue
        arr = np.array([*peers, values[t]])
        arr = np.clip(arr, np.percentile(arr, 3), np.percentile(arr, 97))
        hit = arr[:-1] >= arr[-1] if lower else arr[:-1] <= arr[-1]
        out[t] = float(np.mean(hit) * 100)
    return out


@pytest.fixture(scope="module")
def entities():
    rng = np.random.default_rng(3)
    out = []
    for i in range(300):
        hot = rng.random() < 0.4
        sector = "S0" if hot else f"S{rng.integers(0, 4)}"
        industry = f"{sector}/I0" if hot else f"{sector}/I{rng.integers(0, 12)}"
        basic = f"{industry}/B0" if hot else f"{industry}/B{rng.integers(0, 3)}"
        out.append((f"T{i:04d}", basic, industry, sector))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_peer_percentile(spark, entities, large):
    rng = np.random.default_rng(11)
    up = {e[0]: None if rng.random() < 0.1 else (0.0 if rng.random() < 0.5 else float(rng.normal())) for e in entities}
    down = {e[0]: float(np.round(rng.normal(), 1)) for e in entities}
    frame = spark.createDataFrame(entities, "ticker string, basic_industry string, industry string, sector string")
    metrics = spark.createDataFrame(
        [(t, "up", v) for t, v in up.items()] + [(t, "down", v) for t, v in down.items()],
        "ticker string, metric string, value double")
    levelled = with_peer_level(frame, large=large, block_rows=BLOCK)
    assert {r.peer_level for r in levelled.select("peer_level").distinct().collect()} == {"Basic Industry", "Industry", "Sector"}
    got = {(r.ticker, r.metric): r.score
           for r in peer_percentile(levelled, metrics, ["down"], large=large, block_rows=BLOCK).collect()}
    want = {(t, "up"): s for t, s in _brute_scores(entities, up, False).items()}
    want |= {(t, "down"): s for t, s in _brute_scores(entities, down, True).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 0.00501 for k in want)


@pytest.mark.parametrize("large", [False, True])
def test_first_peers(spark, entities, large):
    frame = spark.createDataFrame(entities, "ticker string, basic_industry string, industry string, sector string")
    levelled = with_peer_level(frame, large=large, block_rows=BLOCK)
    for r in first_peers(levelled, 10, large, BLOCK).collect():
        at = {"Basic Industry": 1, "Industry": 2, "Sector": 3}[r.peer_level]
        group = sorted(e[0] for e in entities if e[at] == r.peer_value and e[0] != r.ticker)
        assert r.peers == group[:10] and r.n_peers == len(group)


@pytest.mark.parametrize("large", [False, True])
def test_as_of_join(spark, large):
    rng = np.random.default_rng(5)
    day = np.datetime64("2024-01-01")

    def make(n):
        return [("hot" if rng.random() < 0.6 else f"k{rng.integers(0, 5)}", (day + int(rng.integers(0, 200))).item(), i) for i in range(n)]

    facts, asked = make(300), make(120)
    got = as_of_join(
        spark.createDataFrame(asked, "k string, d date, id long"), spark.createDataFrame(facts, "k string, f date, fid long"),
        ["k"], "d", "f", ["fid", "f"], ["fid"], large, BLOCK).collect()
    assert len(got) == len(asked)
    for r in got:
        known = [(f, i) for k, f, i in facts if k == r.k and f <= r.d]
        assert r.fid == (max(known)[1] if known else None)
        assert r.f is None or r.f <= r.d


def test_rating_run_is_the_same_in_blocks(spark):
    import os

    from ratewell.plans.rating import leaderboard, rate_universe
    from ratewell.plans.universe import load_universe
    from ratewell.sources import tables as T
    from ratewell.sources.export import supplier_export

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables not present")
    universe = load_universe(supplier_export(spark, folder), T.daily_bars(spark, folder))
    whole = leaderboard(rate_universe(universe)).collect()
    blocks = leaderboard(rate_universe(universe, block_rows=BLOCK)).collect()
    assert len(whole) > 50 and whole == blocks


def test_borders_are_searched_not_listed(spark):
    """A group of many blocks: a bounded number of borders, found by halving, and blocks that follow the key."""
    df = spark.range(5000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 5000).cast("double").alias("v"))
    ranged, blocked = with_range(df, ["g"], "v", 2), with_block(df, ["g"], F.struct("v"), 2)
    for found in (ranged, blocked):
        assert "filter(" not in found._jdf.queryExecution().analyzed().toString()
        blocks = [r.b for r in found.orderBy("v").select(F.col("__block").alias("b")).collect()]
        assert blocks == sorted(blocks) and 500 < len(set(blocks)) <= GRID
    edges = spark.sql("select array(1d, 3d, 5d) as b, explode(array(0d, 1d, 2d, 3d, 5d, 6d)) as v").union(
        spark.sql("select cast(null as array<double>), 2d"))
    assert [r.n for r in edges.select(_below("b", F.col("v")).alias("n")).collect()] == [0, 0, 1, 1, 2, 3, 0]
