"""Small frames with known results, and invariants."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions import stats as T
from tallyloom.operators import cleaning as C
from tallyloom.operators import factors as X
from tallyloom.operators import ledger as L
from tallyloom.operators import strategies as G
from tallyloom.sources.catalog import Tables

DATA = "/root/testdata/sf0.001"


def test_pct_rank_is_that_of_pandas(spark):
    values = [3.0, 1.0, None, 3.0, 2.0, 5.0, None, 1.0, 1.0]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    up = [r[0] for r in rows.select("i", T.pct_rank("v", ["g"]).alias("p")).orderBy("i").select("p").collect()]
    down = [r[0] for r in rows.select("i", T.pct_rank("v", ["g"], descending=True).alias("p")).orderBy("i").select("p").collect()]
    s = pd.Series(values, dtype=float)
    for mine, theirs in ((up, s.rank(pct=True) * 100), (down, s.rank(pct=True, ascending=False) * 100)):
        assert [None if pd.isna(x) else pytest.approx(x) for x in theirs] == mine


def test_equal_values_share_one_rank(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 6, "g string, v double")
    assert rows.select(T.pct_rank("v", ["g"]).alias("p")).distinct().count() == 1


def test_clip_keeps_nulls(spark):
    rows = spark.createDataFrame([(None,), (-5.0,), (0.5,), (9.0,)], "v double")
    assert [r[0] for r in rows.select(T.clip("v", 0.0, 1.0)).collect()] == [None, 0.0, 0.5, 1.0]


@pytest.mark.parametrize("n", [5, 7, 11, 13, 23])
def test_quantile_bucket_is_that_of_pandas(spark, n):
    mine = [r[0] for r in spark.range(1, n + 1).select(T.quantile_bucket(F.col("id"), F.lit(n), 5)).collect()]
    assert mine == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False).tolist()


def bars(spark, closes):
    return spark.createDataFrame([("x", i, c, c, c, c, 1) for i, c in enumerate(closes)], "ticker string, ts int, open double, high double, low double, close double, volume long")


def last_rsi(spark, closes):
    return S.with_changes(bars(spark, closes)).select("ts", S.rsi_simple().alias("r")).orderBy(F.col("ts").desc()).first()["r"]


def test_rsi_edges(spark):
    assert last_rsi(spark, [10.0] * 20) == 50
    assert last_rsi(spark, [10.0 + i for i in range(20)]) == 100
    assert last_rsi(spark, [50.0 - i for i in range(20)]) < 1
    assert last_rsi(spark, [10.0, 11.0]) is None


def test_ewm_is_that_of_pandas(spark):
    closes = [5.0, 7.0, 6.0, 9.0, 4.0, 8.0]
    mine = [r["e"] for r in S.ewm(bars(spark, closes), "close", {"e": 0.3}).orderBy("ts").collect()]
    assert mine == pytest.approx(pd.Series(closes).ewm(alpha=0.3, adjust=False).mean().tolist())


def test_barrier_known_outcome(spark):
    up_first = [100.0, 103.0, 111.0, 90.0]
    down_first = [100.0, 94.0, 120.0]
    assert G.triple_barrier(bars(spark, up_first)).orderBy("ts").first()["label"] == 1
    assert G.triple_barrier(bars(spark, down_first)).orderBy("ts").first()["label"] == 0


def test_asof_joins(spark):
    right = spark.createDataFrame([("x", 1, 1.0), ("x", 5, 5.0)], "ticker string, ts int, v double")
    left = spark.createDataFrame([("x", 0), ("x", 1), ("x", 3), ("x", 6)], "ticker string, ts int")
    assert [r["v"] for r in S.asof_backward(left, right, "ticker", "ts", "v").orderBy("ts").collect()] == [None, 1.0, 1.0, 5.0]
    assert [r["v"] for r in S.asof_forward(left, right, "ticker", "ts", "v").orderBy("ts").collect()] == [1.0, 1.0, 5.0, None]


def test_first_in_first_out(spark):
    rows = [("x", 1, 1, "BUY", 10.0, 5.0), ("x", 2, 2, "BUY", 10.0, 8.0), ("x", 3, 3, "SELL", 15.0, 9.0)]
    ledger = spark.createDataFrame(rows, "ticker string, day int, seq int, kind string, shares double, price double")
    held = L.holdings(ledger).first()
    assert (held["shares"], held["avg_cost"], held["first_buy"]) == (5.0, 8.0, 2)
    assert L.realised(ledger).first()["pnl"] == 10 * 4 + 5 * 1


def test_weights_sum_to_one():
    for regime in X.REGIME_DELTAS:
        base = X.regime_weights(regime)
        assert sum(base.values()) == pytest.approx(1)
        for sector in X.SECTOR_DELTAS:
            w = X.sector_weights(sector, base)
            assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0


def test_scores_within_bounds(spark):
    out = X.scored(C.with_groups(Tables(spark, DATA).xsection))
    low, high, n = out.agg(F.min("score_total"), F.max("score_total"), F.count("*")).first()
    assert 0 <= low <= high <= 100 and n == 200


def test_empty_and_all_missing_cross_sections(spark):
    x = C.with_groups(Tables(spark, DATA).xsection)
    assert C.signals(X.scored(x.limit(0))).count() == 0
    blank = x.withColumns({f.name: F.lit(None).cast(f.dataType) for f in x.schema if f.dataType.typeName() == "double"})
    assert C.signals(X.scored(blank)).count() > 0


def test_rules_reject_unknown_operators(spark):
    with pytest.raises(ValueError):
        C.rule_filter(spark.range(1), ["id ~ 3"])
