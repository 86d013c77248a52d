"""Queries that must take all rows, not some ids or months."""

from types import SimpleNamespace

import pandas as pd
import pytest

from tallyloom.plans import registry
from tallyloom.plans.registry import QUERIES
from tallyloom.sources.catalog import Tables

DATA = "/root/testdata/sf0.001"


def test_previous_scores_of_all_months(spark):
    snapshots = Tables(spark, DATA).snapshots.select("ticker", "snapshot_date", "score_total").toPandas()
    was = {(r.ticker.upper(), pd.Timestamp(r.snapshot_date)): r.score_total for r in snapshots.itertuples()}
    expected = {}
    for r in snapshots.itertuples():
        at = pd.Timestamp(r.snapshot_date)
        old = was.get((r.ticker.upper(), at - pd.DateOffset(months=1)))
        expected[(r.ticker, at)] = None if old is None else pytest.approx(r.score_total - old)
    rows = QUERIES["jn_07_08_previous_scores"](spark, DATA).collect()
    got = {(r["ticker"], pd.Timestamp(r["snapshot_date"])): r["delta"] for r in rows}
    assert len(rows) == len(snapshots) and got == expected and len({at.month for _, at in got}) > 1


def test_drift_takes_all_rows_and_keys_of_one_side(spark):
    ledger = spark.createDataFrame([(2, 1.0, 30.0), (3, 2.0, 20.0), (5, 1.0, 30.0)], "ticker long, shares double, price double")
    supplier = spark.createDataFrame([(1,), (2,), (3,), (4,)], "s_suppkey long")
    rows = registry.portfolio.jn_20_pf_12_drift(SimpleNamespace(ledger=ledger, supplier=supplier)).collect()
    assert {r["ticker"]: (r["drift"], r["action"]) for r in rows} == {1: (-0.25, "BUY"), 2: (-0.075, "BUY"), 3: (0.275, "SELL"), 4: (-0.25, "BUY"), 5: (0.3, "SELL")}
