"""Queries over snapshots by date: joins, staleness, deltas, trends, alerts in batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import snapshots as H
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

DAYS = "DATE '1999-06-01'", "DATE '1999-05-01'"
TODAY = f"today AS (SELECT * FROM snapshots WHERE snapshot_date = {DAYS[0]}), yesterday AS (SELECT * FROM snapshots WHERE snapshot_date = {DAYS[1]})"


def pair(t: Tables):
    s = t.snapshots
    return s.where(f"snapshot_date = {DAYS[0]}"), s.where(f"snapshot_date = {DAYS[1]}")


@query("SELECT ticker, snapshot_date, datediff('day', snapshot_date, DATE '1999-06-10') AS stale_days, score_total FROM (SELECT *, row_number() OVER (PARTITION BY upper(ticker) ORDER BY snapshot_date DESC) AS k FROM snapshots WHERE snapshot_date <= DATE '1999-06-10' AND snapshot_date >= DATE '1999-06-10' - INTERVAL 60 DAY) WHERE k = 1", "snapshots")
def src_03_newest_of_recent(t: Tables):
    return H.newest_recent(t.snapshots, "1999-06-10", 60).select("ticker", "snapshot_date", F.col("stale_days").cast("long").alias("stale_days"), "score_total")


@query("SELECT max(snapshot_date) AS latest, count(DISTINCT snapshot_date) AS n FROM snapshots", "snapshots")
def src_02_latest_snapshot(t: Tables):
    return t.snapshots.agg(F.max("snapshot_date").alias("latest"), F.count_distinct("snapshot_date").alias("n"))


@query("SELECT DISTINCT ticker FROM snapshots", "snapshots")
def src_04_one_column(t: Tables):
    return t.snapshots.select("ticker").distinct()


@query(f"WITH {TODAY} SELECT a.ticker, round(a.score_total - b.score_total, 6) AS delta, coalesce(a.rsi_14 >= 70 AND b.rsi_14 < 70, false) AS crossed_up, coalesce(a.rsi_14 <= 30 AND b.rsi_14 > 30, false) AS crossed_down, coalesce(abs(a.close / nullif(b.close, 0) - 1) >= 0.04, false) AS big_move FROM today a LEFT JOIN yesterday b USING (ticker)", "snapshots")
def jn_01_daily_deltas(t: Tables):
    return H.daily_deltas(*pair(t)).select("ticker", r6("delta"), "crossed_up", "crossed_down", "big_move")


@query(f"WITH {TODAY} SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN b.ticker IS NULL THEN 'new' WHEN a.ticker IS NULL THEN 'gone' WHEN abs(a.score_total - b.score_total) >= 5 THEN 'moved' ELSE 'same' END AS status FROM today a FULL JOIN yesterday b ON a.ticker = b.ticker", "snapshots")
def jn_02_snapshot_diff(t: Tables):
    return H.snapshot_diff(*pair(t)).select("ticker", "status")


TOP = lambda name: f"(SELECT ticker FROM {name} ORDER BY score_total DESC, ticker LIMIT 20)"


@query(f"WITH {TODAY} (SELECT 'entered' AS change, ticker FROM {TOP('today')} WHERE ticker NOT IN {TOP('yesterday')}) UNION ALL (SELECT 'left', ticker FROM {TOP('yesterday')} WHERE ticker NOT IN {TOP('today')})", "snapshots")
def set_04_top_changes(t: Tables):
    return H.top_changes(*pair(t), 20)


@query(f"WITH {TODAY} SELECT ticker, score_total, 0 AS stale FROM today UNION ALL SELECT ticker, score_total, 1 FROM yesterday WHERE ticker NOT IN (SELECT ticker FROM today)", "snapshots")
def jn_09_set_01_staleness_merge(t: Tables):
    return H.staleness_merge(*pair(t)).select("ticker", "score_total", "stale")


@query("SELECT snapshot_date, count(*) AS n, round(max(score_total), 6) AS best, round(avg(score_total), 6) AS mean FROM snapshots GROUP BY snapshot_date", "snapshots")
def agg_09_scan_history(t: Tables):
    return t.snapshots.groupBy("snapshot_date").agg(F.count("*").alias("n"), r6(F.max("score_total"), "best"), r6(F.avg("score_total"), "mean"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot_date DESC) AS k FROM snapshots), s AS (SELECT ticker, list(CAST(score_total AS BIGINT) ORDER BY snapshot_date) AS h FROM k WHERE k <= 10 GROUP BY ticker HAVING count(*) >= 2) SELECT ticker, array_to_string(h, ',') AS history, CASE WHEN h[-1] - h[1] > 5 THEN 'UP' WHEN h[-1] - h[1] < -5 THEN 'DOWN' ELSE 'FLAT' END AS trend FROM s", "snapshots")
def agg_10_score_history(t: Tables):
    return H.score_history(t.snapshots, 10)


@query("WITH n AS (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY snapshot_date) / nullif(close, 0) - 1 AS f FROM snapshots) SELECT entry_signal, count(f) AS n, round(avg(f), 6) AS mean, round(avg(CASE WHEN f IS NULL THEN NULL WHEN f > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM n GROUP BY entry_signal", "snapshots")
def agg_11_signal_outcomes(t: Tables):
    return H.signal_outcomes(t.snapshots).select("entry_signal", "n", r6("mean"), r6("hit_rate"))


@query("WITH d AS (SELECT count(DISTINCT snapshot_date) AS days FROM snapshots), u AS (SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS ticker FROM customer), a AS (SELECT u.ticker, count(DISTINCT s.snapshot_date) AS seen FROM u LEFT JOIN snapshots s USING (ticker) GROUP BY u.ticker) SELECT CASE WHEN seen = 0 THEN 'never' WHEN seen * 1.0 / days < 0.05 THEN 'rare' WHEN seen * 1.0 / days >= 0.2 THEN 'regular' ELSE 'some' END AS band, count(*) AS n FROM a, d GROUP BY 1", "snapshots")
def agg_12_universe_audit(t: Tables):
    universe = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"))
    return H.universe_audit(universe, t.snapshots, rare=0.05, regular=0.2)


@query("WITH d AS (SELECT *, score_total - lag(score_total) OVER (PARTITION BY ticker ORDER BY snapshot_date) AS delta FROM snapshots) SELECT ticker, snapshot_date, delta, CASE WHEN delta IS NULL THEN 'NEW' WHEN delta >= 3 THEN 'UP' WHEN delta <= -3 THEN 'DOWN' ELSE 'FLAT' END AS arrow FROM d", "snapshots")
def win_32_previous_run(t: Tables):
    d = F.col("score_total") - F.lag("score_total").over(Window.partitionBy("ticker").orderBy("snapshot_date"))
    return t.snapshots.withColumn("delta", d).select("ticker", "snapshot_date", "delta", F.when(F.col("delta").isNull(), "NEW").when(F.col("delta") >= 3, "UP").when(F.col("delta") <= -3, "DOWN").otherwise("FLAT").alias("arrow"))


@query("SELECT ticker, snapshot_date FROM (SELECT *, lag(score_total) OVER (PARTITION BY ticker ORDER BY snapshot_date) AS was FROM snapshots) WHERE abs(score_total - was) >= 50", "snapshots")
def stm_05_score_drift(t: Tables):
    was = F.lag("score_total").over(Window.partitionBy("ticker").orderBy("snapshot_date"))
    return t.snapshots.withColumn("was", was).where("abs(score_total - was) >= 50").select("ticker", "snapshot_date")


@query("SELECT ticker, snapshot_date FROM (SELECT *, lag(entry_signal) OVER (PARTITION BY ticker ORDER BY snapshot_date) AS was FROM snapshots) WHERE entry_signal = 'STRONG' AND was IS DISTINCT FROM 'STRONG'", "snapshots")
def stm_04_new_strong_signals(t: Tables):
    return H.fresh_signals(t.snapshots, "STRONG").select("ticker", "snapshot_date")


STRIKES = """WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS ok FROM events GROUP BY 1, 2),
g AS (SELECT *, sum(ok) OVER (PARTITION BY user_id ORDER BY day) AS island FROM o),
s AS (SELECT user_id, day, sum(1 - ok) OVER (PARTITION BY user_id, island ORDER BY day) AS strikes FROM g)
SELECT user_id, max(strikes)::BIGINT AS worst, bool_or(strikes >= 3) AS blacklisted FROM s GROUP BY user_id"""


@query(STRIKES)
def stm_08_strike_counter(t: Tables):
    return H.strikes(t.events)


@query("WITH r AS (SELECT snapshot_date, ticker, close, row_number() OVER (PARTITION BY snapshot_date ORDER BY score_total DESC, ticker) AS k FROM snapshots), f AS (SELECT *, (SELECT min_by(s.close, s.snapshot_date) FROM snapshots s WHERE s.ticker = r.ticker AND s.snapshot_date > r.snapshot_date) AS later FROM r WHERE k <= 10) SELECT snapshot_date, count(later) AS n, round(avg(later / nullif(close, 0) - 1), 6) AS mean_return FROM f GROUP BY snapshot_date", "snapshots")
def bt_20_snapshot_backtest(t: Tables):
    return H.top_n_backtest(t.snapshots, 10).select("snapshot_date", "n", r6("mean_return"))
