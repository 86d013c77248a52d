"""Combinatorial folds, weighted models and their paths."""

import datetime
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import validation as V

START = datetime.date(2020, 1, 1)


def panel(spark, months=40, tickers=25, seed=1, noise=0.0):
    rng, rows = random.Random(seed), []
    for m in range(months):
        day = (START + datetime.timedelta(days=31 * m)).replace(day=1)
        for t in range(tickers):
            x = rng.random()
            rows.append((day, t, t % 3, x, 0.5 * x + m / 100 + rng.gauss(0, noise), None if rng.random() < 0.1 else x))
    return spark.createDataFrame(rows, "month date, ticker long, sector long, x double, actual double, holes double"), rows


def test_roles_by_plain_loops(spark):
    df, rows = panel(spark, 23, 11)
    got = {}
    for r in V.combinatorial_folds(df, blocks=5, tests=2, purge=7, embargo=0.02).collect():
        got[r["combination"], r["position"]] = (r["role"], r["block"], r["path"])
    n, size = len(rows), len(rows) // 5
    wait = max(1, math.floor(n * 0.02))
    seen = dict.fromkeys(range(5), 0)
    assert len(got) == n * 10
    for number, chosen in enumerate(combinations(range(5), 2)):
        ends = {b: (size * b, n if b == 4 else size * (b + 1)) for b in chosen}
        for k in range(n):
            block = min(4, k // size)
            if block in chosen:
                want = ("test", block, seen[block])
            elif any(a - 7 <= k < a for a, _ in ends.values()):
                want = ("purged", block, None)
            elif any(z <= k < z + wait for _, z in ends.values()):
                want = ("embargo", block, None)
            else:
                want = ("train", block, None)
            assert got[number, k] == want
        for b in chosen:
            seen[b] += 1


def test_positions_follow_months_then_tickers(spark):
    df, rows = panel(spark, 7, 9)
    got = sorted((r["position"], r["month"], r["ticker"], r["total"]) for r in V.positions(df.repartition(5)).collect())
    assert [(m, t) for _, m, t, _ in got] == sorted((r[0], r[1]) for r in rows) and [p for p, *_ in got] == list(range(63)) and {n for *_, n in got} == {63}


def test_every_path_tests_every_row_once_and_finds_what_was_planted(spark):
    df, rows = panel(spark)
    tested = V.out_of_sample(df, ["x"], blocks=6, tests=2, fit=V.weighted_line)
    ways = tested.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("month", "ticker").alias("d")).collect()
    assert {(r["n"], r["d"]) for r in ways} == {(len(rows), len(rows))} and len(ways) == 5
    for r in V.path_scores(tested).collect():
        assert r["ic"] > 0.9999 and r["hit_rate"] > 0.9 and r["months"] == 40  # months that a cut divides have two lines
    boosted = V.path_scores(V.out_of_sample(df, ["x", "holes"], blocks=3, tests=1)).collect()
    assert len(boosted) == 1 and boosted[0]["ic"] > 0.8
    assert V.out_of_sample(df.limit(50), ["x"], fit=V.weighted_line).count() == 0  # too few rows


def test_weights_halve_with_age_and_count(spark):
    df, _ = panel(spark, 40, 2)
    rows = V.training_rows(df).collect()
    last = max(r["month"] for r in rows)
    for r in rows:
        assert r["weight"] == pytest.approx(0.5 ** ((last - r["month"]).days / 365.25 / 2.0))
    assert sum(r["target_cs"] for r in rows) == pytest.approx(0.0, abs=1e-9)
    # a line through two kinds of rows leans to the heavier one
    pair = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0), (0.0, 1.0, 9.0), (1.0, 0.0, 9.0)], "x double, target_cs double, weight double")
    slope = {r["x"]: r["guess"] for r in V.weighted_line(pair, ["x"])(pair).collect()}
    assert slope[1.0] - slope[0.0] == pytest.approx(-0.8)


def test_models_of_groups(spark):
    df, _ = panel(spark, 40, 25)
    got = {r["sector"]: r for r in V.group_scores(df, ["x"], "sector", least=330, fit=V.weighted_line).collect()}
    assert set(got) == {0} and got[0]["ic"] == pytest.approx(1.0) and 8 <= got[0]["months"] <= 9
    assert V.group_scores(df, ["x"], "sector", least=10_000, fit=V.weighted_line).count() == 0
