"""The deflated Sharpe ratio against brute force; it depends on the number of trials."""

import math
import random
from statistics import NormalDist, mean, stdev
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import registry

NORMAL = NormalDist()


def brute(values, trials):
    n, m = len(values), mean(values)
    sr = m / stdev(values)
    moment = lambda k: mean((v - m) ** k for v in values)
    skew, kurt = moment(3) / moment(2) ** 1.5, moment(4) / moment(2) ** 2
    k, g = max(2, trials), 0.5772156649
    best = (1 - g) * NORMAL.inv_cdf(1 - 1 / k) + g * NORMAL.inv_cdf(1 - 1 / (k * math.e))
    first = NORMAL.cdf((sr * math.sqrt(n - 1) - best) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr**2)) if sr > 0 else 0.0
    error = math.sqrt((1 + sr**2 / 2 - skew * sr + (kurt - 3) / 4 * sr**2) / (n - 1))
    return first, NORMAL.cdf(sr / error - NORMAL.inv_cdf(1 - 0.5 / trials))


@pytest.mark.parametrize("trials", [1, 3, 60])
def test_deflated_sharpe(spark, trials):
    rng = random.Random(trials)
    groups = {i: [rng.gauss(0.2 - 0.3 * (i == 2), 1) for _ in range(60)] for i in range(trials)}
    panel = spark.createDataFrame([(i, v) for i, vs in groups.items() for v in vs], "sector_id long, actual double")
    rows = registry.operations.ml_08_deflated_sharpe(SimpleNamespace(panel=panel)).collect()
    assert {r["sector_id"]: r["trials"] for r in rows} == dict.fromkeys(groups, trials)
    for r in rows:
        assert (r["probability"], r["simple"]) == pytest.approx(brute(groups[r["sector_id"]], trials), abs=1e-6)


def test_normal_quantile(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.7, 0.98, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").coalesce(1).select(registry.operations.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NORMAL.inv_cdf(x) for x in p], abs=1e-7)
