"""Boosted trees are fitted on cells of bins: as many rows as the bins allow, and the trees that all rows would give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import validation as V
from tallyloom.operators.evaluation import rank_ic


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(11)
    made = []
    for n in range(6000):
        x, z = dice.randint(0, 9), dice.choice([None, 0.0, 1.0, 2.0])
        made.append((datetime.date(2020, 1 + n % 12, 1), n, float(x), z, (x - 4) ** 2 / 10 + (z or 0.0) + dice.gauss(0, 0.3), 0.5 + n % 4))
    return spark.createDataFrame(made, "month date, ticker long, x double, z double, target_cs double, weight double").repartition(4).cache()


def test_trees_are_those_of_all_rows_and_see_cells_alone(spark, rows, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, *a: seen.append(data.count()) or fit(self, data, *a))
    found = {r["ticker"]: r["guess"] for r in V.boosted(rows, ["x", "z"])(rows).collect()}
    assert seen == [30]  # ten values by three, the missing ones as zeros
    filled = VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(rows.fillna(0.0, ["x", "z"]))
    model = GBTRegressor(featuresCol="f", labelCol="target_cs", weightCol="weight", predictionCol="guess", maxIter=4, maxDepth=3, maxBins=16, seed=42)
    want = {r["ticker"]: r["guess"] for r in fit(model, filled).transform(filled).collect()}
    assert len(found) == 6000 and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_scores_by_counts_of_guesses_are_rank_correlations(spark, rows):
    tested = rows.select("month", "ticker", "target_cs", F.round(F.col("x") / 3).alias("guess"), (F.col("ticker") % 3).cast("int").alias("path"))
    tested = tested.where("path < 2 or month = '2020-03-01'").withColumn("guess", F.when(F.month("month") == 3, 1.0).otherwise(F.col("guess")))
    found = {r["path"]: r for r in V.path_scores(tested).collect()}
    for path in range(3):
        own = tested.where(F.col("path") == path)
        ic = [r["ic"] for r in rank_ic(own.select("month", F.col("guess").alias("pred"), F.col("target_cs").alias("actual"))).collect()]
        signs = [(r["guess"] > 0) == (r["target_cs"] > 0) for r in own.collect()]
        if not ic:
            assert found[path]["months"] is None and found[path]["ic"] is None
            continue
        assert found[path]["months"] == len(ic) and found[path]["rows"] == len(signs)
        assert abs(found[path]["ic"] - sum(ic) / len(ic)) < 1e-9 and abs(found[path]["hit_rate"] - sum(signs) / len(signs)) < 1e-12
