"""Scores of parts whose mean discount stands on a threshold don't depend on the order of their lines."""

import datetime
import math

import pytest

from tallyloom.plans.registry import QUERIES
from tallyloom.sources.catalog import Tables

# percent, five on average; added as doubles in this order they stay three last places under it
ORDER = [3, 6, 8, 5, 4, 0, 3, 7, 4, 2, 4, 5, 6, 8, 7, 8]
DAY = datetime.datetime(2024, 1, 1)


def tables(spark, path, discounts):
    """Lines of each part with the discounts of its key, in their order."""
    lines = [(k, k, 1, 1, 2.0, 100.0 + n, d, 0.02, "N", "O", DAY - datetime.timedelta(days=20 * n)) for k, ds in discounts.items() for n, d in enumerate(ds)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    parts = [(k, f"part {k}", "b", "t", 1, 900.0) for k in discounts]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return str(path)


def mean_margin(ds):
    total = 0.0
    for d in ds:
        total += d
    return (1 - total / len(ds) - 0.9) * 100


@pytest.mark.parametrize("name", ["scr_32_quality_score", "scr_34_candidate_verdict"])
def test_a_margin_on_the_threshold_stays_there(spark, tmp_path, name):
    given, ascending = [p / 100 for p in ORDER], [p / 100 for p in sorted(ORDER)]
    assert mean_margin(given) > 5 > mean_margin(ascending)
    scores = []
    for label, ds in (("given", given), ("ascending", ascending), ("lower", [*ascending[:-1], 0.06])):
        path = tables(spark, tmp_path / label, dict.fromkeys(range(1, 40), ds))
        scores.append({r["ticker"]: r["quality_score"] for r in QUERIES[name](spark, path).collect()})
    assert len(scores[0]) == 39 and scores[0] == scores[1]
    assert any(scores[2][k] > scores[1][k] for k in scores[1])


def test_other_numbers_keep_the_plain_mean(spark, tmp_path):
    odd = {1: [1 / 3, 0.1], 2: [None, 0.04, 0.08], 3: [None, None], 4: [math.nan, 0.05], 5: [math.inf, 0.05], 6: [1e300, 0.05], 7: [-0.0, 0.0], 8: [1000.5, 0.25], 9: [1e-9, 0.05]}
    t = Tables(spark, tables(spark, tmp_path, odd))
    plain, exact = ({r["pk"]: repr(r["profit_margin"]) for r in df.select("pk", "profit_margin").collect()} for df in (t.smallcap, t.exact("smallcap")))
    assert exact == plain and sorted(exact) == sorted(odd)
