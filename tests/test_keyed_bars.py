"""Bars by supplier key give the rows that bars by ticker give, and only whole numbers are dealt out and sorted."""

import re

import pytest

from ratewell.catalog.metrics import momentum_metrics, price_metrics
from ratewell.catalog.rating import loaded
from ratewell.operators import bars as B
from ratewell.sources import tables as T

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r.ticker)


def test_keys_give_the_rows_of_tickers(spark):
    by_name, by_key = T.daily_bars(spark, FOLDER), T.keyed_bars(spark, FOLDER)
    assert dict(by_key.dtypes)["ticker"] == "bigint" and T.named(by_key).dtypes == by_name.dtypes
    assert sorted(T.named(by_key).collect()) == sorted(by_name.collect())
    assert rows_of(T.named(B.price_metrics(by_key))) == rows_of(B.price_metrics(by_name))
    index = B.index_series(by_name).localCheckpoint()  # one mean for both, whatever the order of adding
    assert rows_of(T.named(B.momentum_metrics(by_key, index))) == rows_of(B.momentum_metrics(by_name, index))


@pytest.mark.parametrize("query,texts", [(price_metrics, 0), (loaded, 0), (momentum_metrics, 2)])
def test_windows_sort_numbers(spark, query, texts):
    """No window over bars sorts by a text, those over the index (its name, one series) aside: tickers begin alike."""
    plan = query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Window \[.*?\], \[ticker#\d+(L?)\b", plan)
    assert "L" in keys and keys.count("") == texts
