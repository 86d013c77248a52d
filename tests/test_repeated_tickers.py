"""Rows whose tickers repeat, as they do from a million parts on, keep their own ranks."""

import datetime

from pyspark.sql import functions as F

from tallyloom.functions.stats import rank_metrics
from tallyloom.operators import factors as X
from tallyloom.operators import fundamentals as A
from tallyloom.plans.registry import QUERIES
from tallyloom.sources.catalog import Tables

DAY = datetime.datetime(2024, 1, 1)


def tables(spark, path):
    """Twelve parts, two of them of one ticker: 100000 and 1000000, cut to six digits."""
    keys = [100000, 1000000, *range(1, 11)]
    lines = [(k, k, 1, 1, 1.0 + k % 7, 100.0 + k % 91 + n, 0.05, 0.02, "N", "O", DAY - datetime.timedelta(days=200 * n)) for k in keys for n in range(4)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    parts = [(k, f"part {k}", "b", "t", 1, 900.0 + k % 10) for k in keys]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return keys


def test_equal_tickers_keep_their_rows_and_ranks(spark, tmp_path):
    keys = tables(spark, tmp_path)
    t = Tables(spark, str(tmp_path))
    found = QUERIES["scr_02_winsorized_rank"](spark, str(tmp_path)).collect()
    assert len(found) == len(keys) and len({r["ticker"] for r in found}) == len(keys) - 1
    x = t.xsection.where("roe is not null").select("pk", "roe").collect()
    bounds = t.xsection.agg(F.percentile("roe", F.array(F.lit(0.02), F.lit(0.98))).alias("q")).first()["q"]
    held = {r["pk"]: min(max(r["roe"], bounds[0]), bounds[1]) for r in x}
    want = sorted((sum(b < a for b in held.values()) + (sum(b == a for b in held.values()) + 1) / 2) / len(held) * 100 for a in held.values())
    assert [round(v, 5) for v in sorted(r["m_roe"] for r in found if r["m_roe"] is not None)] == [round(v, 5) for v in want]
    own = rank_metrics(t.xsection, X.KEYS, X.BY, {"m_size": (F.col("market_cap"), True, None)})
    assert own.count() == len(keys)
    for scored, score in ((X.scored(t.xsection.withColumn("exchange_group", F.lit("US"))), "score_size"), (A.small_cap_scores(t.smallcap), "sc_liquidity")):
        found = {r[0]: r[1] for r in scored.select("pk", score).collect()}
        assert sorted(found) == sorted(keys) and found[100000] != found[1000000]


def test_early_warning_ranks_equal_tickers_apart(spark, tmp_path):
    keys = tables(spark, tmp_path)
    found = QUERIES["scr_27_28_early_warning"](spark, str(tmp_path)).collect()
    assert len(found) == len(keys) and len({r["early_score"] for r in found if r["ticker"].startswith("T1")}) == 2
