"""Walk-forward optimisation and rolling portfolios: one pass over the bars, windows that don't look ahead."""

import datetime
import random
import re

import pandas as pd
import pytest

from tallyloom.operators import walkforward as WF
from tallyloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
DAY = datetime.date(2020, 1, 1)


def series(spark, tickers, n, seed=1):
    rng, rows = random.Random(seed), []
    for t in tickers:
        close = 100.0
        for k in range(n):
            close *= 1 + rng.gauss(0.0004, 0.02)
            rows.append((t, DAY + datetime.timedelta(days=k), close, 1))
    return spark.createDataFrame(rows, "ticker string, ts date, close double, volume long"), pd.DataFrame(rows, columns=["ticker", "ts", "close", "volume"])


@pytest.mark.parametrize("name", ["bt_09_parameter_sweep", "bt_10_random_search", "bt_12_walk_forward_windows", "bt_12_walk_forward_summary"])
def test_a_grid_is_one_scan_of_the_bars(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan|Scan parquet", plan)) == 1


def test_windows_by_plain_loops(spark):
    bars, rows = series(spark, ["a", "b"], 503)
    pairs = [(2, 5), (3, 12)]
    found = {(r["ticker"], r["segment"]): r for r in WF.optimised_windows(bars, pairs, windows=4, share=0.6).collect()}
    assert len(found) == 8

    def returns(close, fast, slow):
        mean = lambda n: close.rolling(n).mean()
        side = (mean(fast) > mean(slow)).astype(float) - (mean(fast) < mean(slow)).astype(float)
        return (side.shift() * close.pct_change()).fillna(0.0)

    ratio = lambda x: x.mean() / x.std() * 252**0.5
    for ticker, own in rows.groupby("ticker"):
        close = own.close.reset_index(drop=True)
        for k in range(4):
            part = close[k * 125 : (k + 1) * 125].reset_index(drop=True)
            train, test = part[:75], part[75:].reset_index(drop=True)
            best = max(pairs, key=lambda p: ratio(returns(train, *p)))
            r = found[ticker, k + 1]
            assert (r["fast"], r["slow"]) == best
            assert r["is_sharpe"] == pytest.approx(ratio(returns(train, *best))) and r["oos_sharpe"] == pytest.approx(ratio(returns(test, *best)))
            assert r["oos_return"] == pytest.approx((1 + returns(test, *best)).prod() - 1)
    assert WF.optimised_windows(bars.limit(0), pairs).count() == 0
    assert WF.optimised_windows(bars, pairs, windows=20).count() == 0  # under 50 bars to train on


def test_calendar():
    assert WF.month_end(2023, 2) == datetime.date(2023, 2, 28) and WF.month_end(0, 2024 * 12 + 2) == datetime.date(2024, 2, 29)
    days = WF.calendar(datetime.date(2024, 5, 17), 2)
    assert [d for d in days if d[1] in (0, 11)] == [(1, 0, datetime.date(2022, 6, 30)), (1, 11, datetime.date(2023, 5, 31))]
    days = WF.calendar(datetime.date(2024, 6, 1), 2)
    assert [d[2] for d in days][::11] == [datetime.date(2022, 6, 30), datetime.date(2023, 5, 31), datetime.date(2024, 4, 30)]
    assert WF.calendar(datetime.date(2024, 5, 17), 1) == []


def test_portfolio_does_not_look_ahead_and_pays_fees(spark):
    tickers = ["a.ST", "b", "c", "d", "e.ST"]
    bars, rows = series(spark, tickers, 1200, seed=3)
    got = {(r["window"], r["period"]): r for r in WF.rolling_portfolio(bars, years=1 + 1, top=2).collect()}
    assert got
    wide = rows.pivot(index="ts", columns="ticker", values="close")
    (window, period), r = sorted(got.items())[3]
    later = got[window, period + 1]["day"]
    before = wide[[d < r["day"] for d in wide.index]]
    parts = {"r12": before.iloc[-1] / before.iloc[-252] - 1, "r6": before.iloc[-1] / before.iloc[-126] - 1, "r3": before.iloc[-1] / before.iloc[-63] - 1, "from_high": before.iloc[-1] / before.tail(252).max() - 1}
    score = 50 + sum(w * parts[n].rank(pct=True) * 100 for n, w in WF.WEIGHTS.items())
    best = score.sort_values(ascending=False).index[:2]
    now = wide[[d <= r["day"] for d in wide.index]]
    vol = now.pct_change().tail(126).std() * 252**0.5
    gain = wide.loc[later] / wide.loc[r["day"]] - 1
    fee = pd.Series({t: 0.0025 if t.endswith(".ST") else 0.0055 for t in tickers})
    weight = 1 / vol[best] / (1 / vol[best]).sum()
    assert r["port_return"] == pytest.approx(((gain - fee)[best] * weight).sum()) and r["bench_return"] == pytest.approx(gain.mean())
    one = WF.portfolio_windows(WF.rolling_portfolio(bars, years=2, top=2)).orderBy("window").first()
    mine = [v["port_return"] for k, v in sorted(got.items()) if k[0] == one["window"]]
    product = 1.0
    for x in mine:
        product *= 1 + x
    assert one["port_return"] == pytest.approx(product - 1 - 0.015 / 12 * len(mine))
    assert WF.rolling_portfolio(bars.limit(0)).count() == 0
