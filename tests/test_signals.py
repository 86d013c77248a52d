"""Alerts, sizes, numbers and searches on small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import search, signals
from tallyloom.sources import sinks


def test_alerts_fire_once_and_unknown_values_never(spark):
    names = ["above", "below", "crosses_ma50", "crosses_ma200", "rsi_above_70", "rsi_below_30", "change_pct", "volume_spike", "unheard_of"]
    alerts = spark.createDataFrame([(n, "t", n, {"above": 10.0, "below": 5.0, "change_pct": 3.0, "volume_spike": 2.0}.get(n)) for n in names], "alert_id string, ticker string, condition string, target double")
    ticks = [("t", 1, None, 0.0, 0.0, 90.0, 9.0, 9.0, 1.0), ("t", 2, 10.0, 0.5, 0.005, 50.0, -3.0, 1.0, 0.0), ("t", 3, 12.0, -0.009, None, 71.0, 4.0, 4.0, 2.0), ("t", 4, 5.0, 0.0, 0.0, 29.0, None, 9.0, 1.0), ("u", 1, 5.0, 0.0, 0.0, 29.0, 9.0, 9.0, 1.0)]
    ticks = spark.createDataFrame(ticks, "ticker string, at int, close double, price_vs_ma50 double, price_vs_ma200 double, rsi_14 double, change_pct double, volume double, avg_volume double")
    got = {r["alert_id"]: (r["triggered_at"], r["triggered_price"]) for r in signals.one_shot(alerts, ticks, "at").collect()}
    assert got == {"above": (2, 10.0), "below": (4, 5.0), "crosses_ma50": (3, 12.0), "crosses_ma200": (2, 10.0), "rsi_above_70": (3, 12.0), "rsi_below_30": (4, 5.0), "change_pct": (2, 10.0), "volume_spike": (3, 12.0)}


def test_swedish_numbers(spark):
    rows = [("1 234,56",), ("-7,5",), ("−1 000",), ("",), ("kr",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(sinks.swedish_number("c")).collect()]
    assert got == [1234.56, -7.5, -1000.0, None, None, None]


def test_sizes(spark):
    row = spark.range(1).select(
        signals.kelly_fraction(F.lit(0.5), F.lit(1.5)), signals.kelly_fraction(F.lit(0.9), F.lit(3.0)), signals.kelly_fraction(F.lit(0.5), F.lit(0.0)),
        signals.shares_for(F.lit(0.1), F.lit(33.0), 1000.0), signals.shares_for(F.lit(0.1), F.lit(0.0), 1000.0), signals.shares_by_risk(F.lit(10.0), F.lit(None).cast("double"), 1000.0),
    ).first()
    assert list(row) == [pytest.approx(0.5 * (0.5 - 0.5 / 1.5)), 0.25, 0.02, 3, 1, 50]


def test_genetic_search_never_loses_its_best():
    space, asked = [list(range(10)), list(range(10))], []

    def values(people):
        asked.extend(people)
        return {p: -float((p[0] - 7) ** 2 + (p[1] - 3) ** 2) for p in people}

    found = search.genetic(values, space, size=12, generations=30, patience=30, valid=lambda p: p[0] != p[1])
    assert all(b[2] >= a[2] for a, b in itertools.pairwise(found)) and found[-1][1] == (7, 3)
    assert len(asked) == len(set(asked)) and all(a != b for a, b in asked)
    assert found == search.genetic(values, space, size=12, generations=30, patience=30, valid=lambda p: p[0] != p[1])
    assert len(search.genetic(values, [[1], [2]], size=3, patience=3, generations=20)) == 4
