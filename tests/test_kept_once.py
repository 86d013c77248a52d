"""Combinations take their rows from one kept copy of the panel, not from a copy each."""

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import validation as V


def test_combinations_share_one_copy_and_test_the_same_rows(spark):
    rows = [(datetime.date(2020 + m // 12, 1 + m % 12, 1), t, float(t * 7 % 11), float((t * 5 + m) % 13) / 20, float(t % 3)) for m in range(24) for t in range(30)]
    panel = spark.createDataFrame(rows, "month date, ticker long, pred double, actual double, other double")
    found = V.out_of_sample(panel, ["pred"], fit=V.weighted_line)
    assert "Generate" not in found._jdf.queryExecution().toString()  # no copies of the rows by combination
    folds = V.combinatorial_folds(V.training_rows(panel)).where("role = 'test'")
    key = ["month", "ticker", "combination", "block", "path"]
    assert found.select(*key).exceptAll(folds.select(*key)).count() == 0 == folds.select(*key).exceptAll(found.select(*key)).count()
    for n, ticker in ((0, 3), (14, 7)):  # two of the models, over the exploded folds
        line = V.weighted_line(V.combinatorial_folds(V.training_rows(panel)).where(f"role = 'train' and combination = {n}"), ["pred"])
        want = line(folds.where((F.col("combination") == n) & (F.col("ticker") == ticker))).first()["guess"]
        assert abs(found.where((F.col("combination") == n) & (F.col("ticker") == ticker)).first()["guess"] - want) < 1e-9
