"""Queries over the model panel: labels, information coefficients, buckets, folds, intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import evaluation as E
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

RANKS = "r AS (SELECT month, ticker, pred, actual, rank() OVER (PARTITION BY month ORDER BY pred) + (count(*) OVER (PARTITION BY month, pred) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY month ORDER BY actual) + (count(*) OVER (PARTITION BY month, actual) - 1) / 2.0 AS ra, count(*) OVER (PARTITION BY month) AS n FROM panel)"
IC = f"{RANKS}, ic AS (SELECT month, corr(rp, ra) AS ic FROM r WHERE n >= 5 GROUP BY month HAVING count(DISTINCT rp) > 1 AND count(DISTINCT ra) > 1)"


@query(f"WITH {IC} SELECT month, round(ic, 6) AS ic FROM ic", "panel")
def ml_01_rank_ic(t: Tables):
    return E.rank_ic(t.panel).select("month", r6("ic"))


@query(f"WITH {IC} SELECT count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 6) AS ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 5) AS t FROM ic", "panel")
def ml_04_ic_significance(t: Tables):
    return E.ic_summary(E.rank_ic(t.panel)).select("n", r6("mean"), r6("std"), r6("ir"), F.round("t", 5).alias("t"))


@query(f"WITH {IC} SELECT month, round(avg(ic) OVER (ORDER BY month ROWS 2 PRECEDING), 6) AS ma3, round((ic - avg(ic) OVER ()) / stddev_samp(ic) OVER (), 5) AS z FROM ic", "panel")
def ml_05_ic_decay(t: Tables):
    return E.ic_decay(E.rank_ic(t.panel)).select("month", r6("ma3"), F.round("z", 5).alias("z"))


ROWS = "k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY pred, ticker) AS rn, count(*) OVER (PARTITION BY month) AS n FROM panel)"


@query(f"WITH {ROWS}, b AS (SELECT month, greatest(0, CAST(ceil((rn - 1) * 5 / (n - 1)) AS BIGINT) - 1) AS bucket, avg(actual) AS a FROM k WHERE n >= 5 GROUP BY 1, 2) SELECT bucket, count(*) AS months, round(avg(a), 6) AS mean FROM b GROUP BY bucket", "panel")
def ml_02_bucket_returns(t: Tables):
    return E.bucket_returns(t.panel, 5).select(F.col("bucket").cast("long").alias("bucket"), "months", r6("mean"))


@query(f"WITH {ROWS} SELECT month, round(avg(CASE WHEN rn > n - greatest(1, n // 5) THEN actual END) - avg(CASE WHEN rn <= greatest(1, n // 5) THEN actual END), 6) AS spread FROM k WHERE n >= 5 GROUP BY month", "panel")
def ml_03_quintile_spread(t: Tables):
    return E.quintile_spread(t.panel).select("month", r6("spread"))


@query("SELECT month, ticker, round(actual - avg(actual) OVER (PARTITION BY month), 6) + 0.0 AS target FROM panel", "panel")
def lbl_03_demean(t: Tables):
    return t.panel.select("month", "ticker", r6(F.col("actual") - F.avg("actual").over(Window.partitionBy("month")), "target"))


@query("WITH w AS (SELECT month, ticker, exp(-ln(2) * datediff('day', month, (SELECT max(month) FROM panel)) / 730.0) AS w FROM panel) SELECT month, ticker, round(w / avg(w) OVER (), 5) AS weight FROM w", "panel")
def lbl_05_time_decay(t: Tables):
    return E.decay_weights(t.panel).select("month", "ticker", F.round("weight", 5).alias("weight"))


FOLDS = """f AS (SELECT k, CAST(DATE '1997-01-01' + to_months(CAST(6 * k AS INTEGER)) AS DATE) AS start FROM range(0, 9) t(k)),
s AS (SELECT k, start, CAST(start + INTERVAL 6 MONTH AS DATE) AS stop, CAST(start - INTERVAL 35 DAY AS DATE) AS train_end FROM f)"""


@query(f"WITH {FOLDS} SELECT k AS fold, (SELECT count(*) FROM panel WHERE month < train_end) AS n_train, (SELECT count(*) FROM panel WHERE month >= start AND month < stop) AS n_test FROM s", "panel")
def ml_06_walk_forward_folds(t: Tables):
    """Purged folds: training stops 35 days before the test starts."""
    return E.fold_sizes(t.panel, "1997-01-01", 9).select("fold", "n_train", "n_test")


@query("WITH q AS (SELECT quantile_cont(abs(actual - pred / 100000), 0.9) AS q FROM panel WHERE month < DATE '1998-01-01') SELECT month, ticker, round(pred / 100000 - q, 6) AS low, round(pred / 100000 + q, 6) AS high FROM panel, q WHERE month >= DATE '1998-01-01'", "panel")
def ml_14_conformal(t: Tables):
    p = t.panel.withColumn("guess", F.col("pred") / 100000)
    out = E.conformal(p.where("month < '1998-01-01'"), p.where("month >= '1998-01-01'"), "guess", "actual", 0.1)
    return out.select("month", "ticker", r6("low"), r6("high"))


PCT = lambda c: f"(rank() OVER (PARTITION BY month ORDER BY {c}) + (count(*) OVER (PARTITION BY month, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY month) * 100"


@query(f"SELECT month, ticker, round(abs({PCT('pred')} - {PCT('actual')}), 6) AS uncertainty, abs({PCT('pred')} - {PCT('actual')}) > 20 AS flagged FROM panel", "panel")
def ml_13_model_disagreement(t: Tables):
    return E.disagreement(t.panel, "pred", "actual").select("month", "ticker", r6("uncertainty"), "flagged")


@query(None)
def ml_09_boosted_regressor(t: Tables):
    """Rank IC by month of a boosted-tree model on the months after its training."""
    return E.boosted_ic(t.panel, "1998-01-01").select("month", r6("ic"))
