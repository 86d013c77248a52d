"""Pairwise gradients against all pairs, cuts, and rankings of planted data."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ranker as K
from tallyloom.operators import validation as V

START = datetime.date(2020, 1, 1)


def month(m):
    return (START + datetime.timedelta(days=31 * m)).replace(day=1)


def planted(spark, months=30, tickers=40, seed=2):
    """The outcome follows a hump of x, which a line can't see, and a jump of outliers, which squares would chase."""
    rng, rows = random.Random(seed), []
    for m in range(months):
        for t in range(tickers):
            x, z = rng.random(), rng.random()
            rows.append((month(m), t, x, z, 1 - 4 * (x - 0.5) ** 2 + rng.gauss(0, 0.03), 1.0))
    return spark.createDataFrame(rows, "month date, ticker long, x double, z double, actual double, weight double")


def test_gradients_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(month(m), rng.randrange(5), rng.choice([-1.0, 0.0, 0.25, 2.0])) for m in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "month date, grade int, score double")
    got = {(r["month"], r["grade"], r["score"]): (r["g"], r["h"]) for r in K.gradients(df).collect()}
    assert set(got) == set(rows)
    for mine in set(rows):
        g = h = 0.0
        for other in rows:
            if other[0] == mine[0] and other[1] != mine[1]:
                high, low = (mine, other) if mine[1] > other[1] else (other, mine)
                rho = 1 / (1 + math.exp(high[2] - low[2]))
                g += rho if high is mine else -rho
                h += rho * (1 - rho)
        assert got[mine] == (pytest.approx(g), pytest.approx(h))


def test_grades_and_bins(spark):
    df = spark.createDataFrame([(month(0), t, float(t % 7)) for t in range(20)] + [(month(1), t, 1.0) for t in range(4)], "month date, ticker long, actual double")
    got = K.graded(df).groupBy("month", "grade").count().collect()
    assert {r["month"] for r in got} == {month(0)} and sorted(r["grade"] for r in got) == [0, 1, 2, 3, 4] and {r["count"] for r in got} <= {3, 4, 5}
    values = spark.createDataFrame([(None,), (0.0,), (1.0,), (1.5,), (9.0,)], "x double")
    assert [r[0] for r in values.select(K.bin_of("x", [1.0, 2.0])).collect()] == [0, 1, 1, 2, 3]
    assert K.best_cut([("x", 1, 5.0, 2.0), ("x", 2, -5.0, 2.0), ("z", 1, 0.1, 2.0), ("z", 2, -0.1, 2.0)], 1.0, 1.0)[1:] == ("x", 1)
    assert K.best_cut([("x", 1, 5.0, 0.2), ("x", 2, -5.0, 2.0)], 1.0, 1.0) is None


def test_ndcg_by_plain_loops(spark):
    rng = random.Random(5)
    rows = [(month(m), t, rng.randrange(5), round(rng.random(), 1)) for m in range(2) for t in range(15)]
    df = spark.createDataFrame(rows, "month date, ticker long, grade int, score double")
    got = {r["month"]: r["ndcg"] for r in K.ndcg(df, "score", 10).collect()}
    for m in got:
        own = [r for r in rows if r[0] == m]
        total = lambda order: sum((2 ** r[2] - 1) / math.log2(k + 2) for k, r in enumerate(order[:10]))
        assert got[m] == pytest.approx(total(sorted(own, key=lambda r: (-r[3], r[1]))) / total(sorted(own, key=lambda r: -r[2])))


def test_ranker_beats_a_line_on_a_hump(spark):
    df = planted(spark)
    found = K.walk_forward(df, ["x", "z"], first=18, test=6, regress=lambda rows: V.weighted_line(rows.withColumn("target_cs", F.col("actual")), ["x"]), rounds=3).collect()
    assert [r["fold"] for r in found] == [0, 1]
    for r in found:
        assert r["ndcg"] > 0.8 > 0.6 > r["regression_ndcg"] and r["ic"] > 0.8 and r["spread"] > 0.5 and r["n_test"] == 240
    model = K.fit(K.graded(df), ["x", "z"], rounds=2)
    assert len(model.trees) == 2 and all(name == "x" for name, _ in [t.splits[1] for t in model.trees])
    flat = K.fit(K.graded(df).withColumn("x", F.lit(1.0)), ["x"], rounds=2)
    assert flat.trees == []  # nothing to cut
