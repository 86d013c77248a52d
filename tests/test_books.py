"""Paper trades, recommendations, shuffles, polls and queues against loops."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import book, polls, rolling

START = datetime.date(2024, 1, 1)


def brute_trade(bars, capital):
    """bars: (day, price, atr), the first being the entry."""
    cost = bars[0][1] * 1.0015
    first = shares = capital / cost
    stop, take, partial, high, trail, top_ups, halved, banked = cost * 0.9, cost * 1.25, cost * 1.12, cost, None, 0, False, 0.0
    for day, p, atr in bars[1:]:
        if (day - bars[0][0]).days > 84:
            break
        gain, out, acted = p / cost - 1, None, False
        dynamic = max(p - 2 * atr, cost * 0.8) if atr and atr > 0 else cost * 0.88
        if p <= stop:
            out = "stop"
        elif p <= dynamic:
            out = "dynamic stop"
        elif not halved and p >= take:
            out = "take profit"
        elif not halved and p >= partial:
            banked, shares, halved, stop = (p - cost) * shares / 2, shares / 2, True, cost * 0.9
        else:
            if gain >= 0.08 and p > high:
                high, trail = p, p * 0.92
            if gain >= 0.08 and trail is not None and p <= trail:
                out = "trailing stop"
            elif gain <= -0.08 and top_ups < 2:
                more = capital * 1.5 / p
                cost = (cost * first + p * more) / (shares + more)
                shares, stop, top_ups = shares + more, cost * 0.9, top_ups + 1
        if out is None and (day - bars[0][0]).days >= 56:
            out = "time"
        if out:
            return out, day, top_ups, halved, pytest.approx((p - cost) * shares + banked), pytest.approx(p * 0.9985)
    return "OPEN", None, top_ups, halved, None, None


def test_paper_trades(spark):
    rng, rows = random.Random(5), []
    for k in range(60):
        price, step = 100.0, rng.choice([0.01, 0.02, 0.04])
        for d in range(120):
            if rng.random() < 0.7:
                price *= 1 + rng.gauss(rng.choice([0, 0.004]), step) + (0.3 if rng.random() < 0.01 else 0)
                rows.append((f"t{k}", START + datetime.timedelta(days=d), price, rng.choice([None, 0.0, 1.0, 8.0])))
    entry = F.col("day").isin([START + datetime.timedelta(days=d) for d in (0, 3, 30, 80, 119)])
    bars = spark.createDataFrame(rows, "ticker string, day date, close double, atr double").withColumn("starts", entry)
    got = {(r["ticker"], r["bought"]): r for r in book.paper_trades(bars, "starts", 1000.0).collect()}
    starts = [k for k, r in enumerate(rows) if (r[1] - START).days in (0, 3, 30, 80, 119)]
    assert len(got) == len(starts)
    for k in starts:
        r = got[rows[k][:2]]
        expected = brute_trade([x[1:] for x in rows[k:] if x[0] == rows[k][0]], 1000.0)
        assert (r["reason"], r["sold_on"], r["top_ups"], r["halved"], r["pnl"], r["sold_at"]) == expected, rows[k][:2]
    kinds = Counter(r["reason"] for r in got.values())
    assert set(kinds) == {"OPEN", "stop", "take profit", "trailing stop", "time"}  # the hard stop always comes before the dynamic one
    assert {r["top_ups"] for r in got.values()} >= {0, 1} and {r["halved"] for r in got.values()} == {True, False}


def test_recommendations(spark):
    scored = [("a", 9.0, 1, 10.0, 80.0, 0.0, 1.0), ("b", 8.0, 2, 10.0, None, None, 2.0), *[(f"f{k}", 5.0, 3 + k, 1.0, 50.0, 0.0, 1.0) for k in range(2)], ("c", 4.0, 5, 10.0, 50.0, -0.2, 1.0), ("d", 3.0, 7, 10.0, 50.0, None, 1.0), ("e", 2.0, 10, 10.0, 50.0, 0.0, 1.0), *[(f"g{k}", 1.0, k, 1.0, 50.0, 0.0, 1.0) for k in (6, 8, 9)]]
    scored = spark.createDataFrame(scored, "ticker string, score double, rank int, current_price double, rsi_14 double, return_3m double, atr double")
    held = spark.createDataFrame([(t, 2.0, 8.0) for t in "abcdez"], "ticker string, shares double, avg_cost double")
    got = {r["ticker"]: r for r in book.recommendations(held, scored).collect()}
    assert {t: r["advice"] for t, r in got.items()} == {"a": "HOLD", "b": "BUY", "c": "WATCH", "d": "WATCH", "e": "REDUCE", "z": "UNKNOWN"}
    assert got["b"]["stop"] == 5.0 and got["a"]["stop"] is None and got["z"]["pnl"] is None
    assert got["b"]["weight"] == pytest.approx(0.3 * 0.1 + 0.7 / 6) and got["b"]["amount"] == pytest.approx(100 * got["b"]["weight"])
    assert book.recommendations(held.limit(0), scored).count() == 0


def test_shuffles_keep_values_and_unused_features_are_worth_nothing(spark):
    rng = random.Random(2)
    data = [(k, rng.random(), rng.random(), rng.random() / 10) for k in range(400)]
    rows = spark.createDataFrame([(k, a, b, 3 * a + e) for k, a, b, e in data], "k long, a double, b double, actual double")
    moved = rolling.shuffled(rows, "a", ["k"], 2, 4).collect()
    for turn in (1, 2):
        assert sorted(r["a"] for r in moved if r["turn"] == turn) == sorted(x[1] for x in data)
        assert sum(r["a"] == data[r["k"]][1] for r in moved if r["turn"] == turn) == 0
    assert [r["a"] for r in moved if r["turn"] == 1] != [r["a"] for r in moved if r["turn"] == 2]
    predict = lambda df: df.withColumn("guess", 3 * F.col("a"))
    got = {r["feature"]: r["importance"] for r in rolling.permutation_importance(rows, predict, ["a", "b"], ["k"], 2, 4).collect()}
    base = sum(e * e for *_, e in data) / len(data)
    by_turn = [sum((3 * r["a"] - r["actual"]) ** 2 for r in moved if r["turn"] == turn) / len(data) for turn in (1, 2)]
    assert got["b"] == pytest.approx(0) and got["a"] == pytest.approx((sum(by_turn) / 2 - base) / base)
    line = rolling.partial_dependence(rows, predict, ["a", "b"], "a").collect()
    assert len(line) == 50 and all(r["guess"] == pytest.approx(3 * r["at"]) for r in line)


def test_windows_of_dates(spark):
    months = [datetime.date(2000 + k // 12, k % 12 + 1, 1) for k in range(20)]
    got = {(months.index(r["month"]), r["fold"], r["role"]) for r in rolling.windows(spark.createDataFrame([(m,) for m in months for _ in range(2)], "month date"), 6, 3).collect()}
    expected = {(i, k, "train" if i < 3 * k + 6 else "test") for k in range(7) for i in range(20) if 3 * k <= i < 3 * k + 9}
    assert got == expected


def test_queue_leaves_old_and_banned(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    tried = [("a", at(1), False), ("a", at(2), True), ("a", at(9), False), ("a", at(10), False), ("b", at(1), False), ("c", at(9), False), ("d", at(9), True), *[("e", at(10), False)] * 5]
    tried = spark.createDataFrame(tried, "ticker string, ts timestamp, ok boolean")
    got = polls.retry_queue(tried, spark.createDataFrame([("C",), (None,)], "ticker string"), F.max("ts")).collect()
    assert {(r["ticker"], r["passes"], r["exhausted"]) for r in got} == {("a", 2, False), ("e", 5, True)}


def test_meta_labels_learn_from_earlier_buys_alone(spark):
    rng = random.Random(4)
    day = lambda k: START + datetime.timedelta(days=k)
    # the rule turns round on day 366: a model of the first fold can't know, that of the second can
    rows = [(f"t{k}", day(d), rng.choice([50.0, 90.0, 100.0]), rng.choice([None, 0.0, 1.0])) for d in range(0, 730, 3) for k in range(3)]
    known = [(t, d, int(bool(f)) if d < day(366) else int(not f)) for t, d, _, f in rows if rng.random() < 0.9]
    primary, labels = spark.createDataFrame(rows, "ticker string, ts date, rank double, f double"), spark.createDataFrame(known, "ticker string, ts date, label int")
    got = rolling.meta_scores(primary, labels, ["f"], "2024-07-01", 2, months=6, trees=3).collect()
    place = {(t, d): (r, f) for t, d, r, f in rows}
    expected = {(t, d) for t, d, _ in known if place[t, d][0] >= 90 and datetime.date(2024, 7, 1) <= d < datetime.date(2025, 7, 1)}
    assert {(r["ticker"], r["ts"]) for r in got} == expected and {r["fold"] for r in got} == {0, 1}
    assert all((r["probability"] > 0.5) == (place[r["ticker"], r["ts"]][1] == 1.0) for r in got)
    assert rolling.meta_scores(primary, labels.where("label = 1"), ["f"], "2024-07-01", 2).count() == 0
