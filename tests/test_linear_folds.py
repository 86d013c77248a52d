"""Folds over long series: time in proportion to their length, values as in a plain loop."""

import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.operators import folds


def bars(spark, n):
    wave = 100 + 10 * F.sin(F.col("id") / 7) + F.col("id") % 5
    x = spark.range(n).select(F.lit("a").alias("ticker"), F.col("id").alias("ts"), wave.alias("close"))
    return x.withColumns({"high": F.col("close") + 1 + F.col("ts") % 3, "low": F.col("close") - 1 - F.col("ts") % 2})


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
def test_means_agree_with_a_loop_at_any_length(spark, n):
    df = bars(spark, n)
    got = [(r["fast"], r["slow"]) for r in S.ewm(df, "close", {"fast": 0.5, "slow": 0.01}).orderBy("ts").collect()]
    want, now = [], None
    for r in df.orderBy("ts").collect():
        now = [r["close"]] * 2 if now is None else [now[0] * 0.5 + r["close"] * 0.5, now[1] * 0.99 + r["close"] * 0.01]
        want.append(tuple(now))
    assert got == [pytest.approx(w) for w in want]


def test_a_million_bars_take_time_in_proportion(spark):
    def took(n):
        began = time.perf_counter()
        out = S.ewm(bars(spark, n), "close", {"mean": 0.1}).agg(F.count("mean").alias("n"), F.avg("mean").alias("m")).first()
        assert out["n"] == n and 90 < out["m"] < 115
        return time.perf_counter() - began

    took(1000)
    small = took(100_000)
    assert took(1_000_000) < 60 * max(small, 0.5)


def test_stops_agree_with_a_loop(spark):
    df = bars(spark, 400)
    rows = df.orderBy("ts").collect()
    stop = extreme = None
    pace, direction, want = 0.02, 1.0, []
    for r in rows:
        if stop is None:
            stop, extreme, pace, direction = r["low"], r["high"], 0.02, 1.0
        else:
            long = direction > 0
            moved = stop + pace * (extreme - stop)
            hit = r["low"] < moved if long else r["high"] > moved
            further = r["high"] > extreme if long else r["low"] < extreme
            stop = extreme if hit else moved
            if hit:
                extreme, pace, direction = (r["low"] if long else r["high"]), 0.02, -direction
            elif further:
                extreme, pace = (r["high"] if long else r["low"]), min(pace + 0.02, 0.2)
        want.append((stop, direction))
    got = [(r["stop"], r["direction"]) for r in folds.parabolic(df).orderBy("ts").collect()]
    assert got == [(pytest.approx(s), d) for s, d in want] and {d for _, d in want} == {1.0, -1.0}


def test_bands_agree_with_a_loop(spark):
    df = bars(spark, 300)
    rows = df.orderBy("ts").collect()
    want, ranges, upper, lower, before, direction = [], [], None, None, None, 1.0
    close = None
    for r in rows:
        tr = max([r["high"] - r["low"]] + ([] if close is None else [abs(r["high"] - close), abs(r["low"] - close)]))
        close = r["close"]
        ranges.append(tr)
        if len(ranges) < 10:
            continue
        atr = sum(ranges[-10:]) / 10
        top, bottom = (r["high"] + r["low"]) / 2 + 3 * atr, (r["high"] + r["low"]) / 2 - 3 * atr
        new_upper = top if upper is None or top < upper or before > upper else upper
        new_lower = bottom if lower is None or bottom > lower or before < lower else lower
        direction = 1.0 if r["close"] > (new_upper if upper is None else upper) else -1.0 if r["close"] < (new_lower if lower is None else lower) else direction
        upper, lower, before = new_upper, new_lower, r["close"]
        want.append(direction)
    assert [r["direction"] for r in folds.supertrend(df).orderBy("ts").collect()] == want
