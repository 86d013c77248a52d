"""Queries over further indicators, labels, pairs, costs and sector states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import sample_kurtosis, sample_skew
from tallyloom.operators import indicators as N
from tallyloom.operators import strategies as G
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.plans.series import BT, CH, TR, W, ewm_sql, roll
from tallyloom.sources.catalog import Tables

GL = f"gl AS (SELECT ticker, ts, greatest(change, 0) AS up, greatest(-change, 0) AS down FROM ch WHERE change IS NOT NULL), n AS (SELECT *, row_number() OVER ({W}) AS k FROM gl)"


@query(f"WITH RECURSIVE {CH}, {GL}, {ewm_sql('eu', 'up', 1 / 14)}, {ewm_sql('ed', 'down', 1 / 14)} SELECT n.ticker, n.ts, round(CASE WHEN ed.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + eu.y / ed.y) END, 4) AS rsi FROM n JOIN eu USING (ticker, k) JOIN ed USING (ticker, k)", "bars")
def win_07_rsi_ewm(t: Tables):
    return N.rsi_ewm(t.bars).select("ticker", "ts", F.round("rsi", 4).alias("rsi"))


ADX = f"""WITH {TR.replace('SELECT *,', 'SELECT *, high - lag(high) OVER (' + W + ') AS up, lag(low) OVER (' + W + ') - low AS down,')},
d AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus FROM tr),
i AS (SELECT ticker, ts, 100 * ({roll('avg', 'plus', 14)}) / nullif({roll('avg', 'tr', 14)}, 0) AS pdi, 100 * ({roll('avg', 'minus', 14)}) / nullif({roll('avg', 'tr', 14)}, 0) AS mdi FROM d),
x AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM i) SELECT ticker, ts, round({roll('avg', 'dx', 14)}, 4) AS adx FROM x"""


@query(ADX, "bars")
def win_12_adx(t: Tables):
    return N.adx(t.bars).select("ticker", "ts", F.round("adx", 4).alias("adx"))


@query(f"WITH n AS (SELECT *, row_number() OVER ({W}) AS k FROM bars) SELECT a.ticker, a.ts, round(CASE WHEN a.k >= 60 THEN least(0.0, (SELECT min(c.close / (SELECT max(b.close) FROM n b WHERE b.ticker = a.ticker AND b.k BETWEEN a.k - 59 AND c.k) - 1) FROM n c WHERE c.ticker = a.ticker AND c.k BETWEEN a.k - 59 AND a.k)) END, 6) AS max_drawdown FROM n a WHERE a.k % 50 = 0", "bars")
def win_17_window_drawdown(t: Tables):
    x = t.bars.withColumn("k", F.row_number().over(S.ordered())).withColumn("d", N.window_drawdown(60))
    return x.where("k % 50 = 0").select("ticker", "ts", r6("d", "max_drawdown"))


@query(f"WITH {CH}, m AS (SELECT *, close / lag(close, 60) OVER ({W}) - 1 AS momentum FROM bars), o AS (SELECT *, avg(momentum) OVER (PARTITION BY ts) AS others FROM m) SELECT ticker, ts, (CASE WHEN momentum > 0 AND momentum > others THEN 1 ELSE 0 END)::BIGINT AS signal FROM o", "bars")
def str_03_dual_momentum(t: Tables):
    return N.dual_momentum(t.bars).select("ticker", "ts", F.col("signal").cast("long").alias("signal"))


@query(f"WITH m AS (SELECT *, close / lag(close, 20) OVER ({W}) - 1 AS momentum, row_number() OVER ({W}) AS k FROM bars), p AS (SELECT a.ticker, a.ts, a.k, (sum(CASE WHEN b.momentum < a.momentum THEN 1 ELSE 0 END) + (sum(CASE WHEN b.momentum = a.momentum THEN 1 ELSE 0 END) + 1) / 2.0) / 60 AS place FROM m a JOIN m b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 59 AND a.k GROUP BY 1, 2, 3) SELECT ticker, ts, (CASE WHEN k < 80 THEN 0 WHEN place >= 0.8 THEN 1 WHEN place <= 0.2 THEN -1 ELSE 0 END)::BIGINT AS signal FROM p", "bars")
def str_02_momentum_tails(t: Tables):
    return N.momentum_tails(t.bars).select("ticker", "ts", F.col("signal").cast("long").alias("signal"))


@query(ADX.replace("SELECT ticker, ts, round(", "z AS (SELECT ticker, ts, ").replace(", 4) AS adx FROM x", " AS adx FROM x)").replace("FROM i) z AS", "FROM i), z AS") + f", s AS (SELECT ticker, ts, {roll('avg', 'close', 20)} AS f, {roll('avg', 'close', 50)} AS l FROM bars) SELECT ticker, ts, (CASE WHEN adx > 20 AND f > l THEN 1 WHEN adx > 20 AND f < l THEN -1 ELSE 0 END)::BIGINT AS signal FROM s JOIN z USING (ticker, ts)", "bars")
def str_05_trend_with_adx(t: Tables):
    return N.trend_with_adx(t.bars).select("ticker", "ts", F.col("signal").cast("long").alias("signal"))


P = "(ORDER BY ts ROWS 59 PRECEDING)"


@query(f"WITH j AS (SELECT a.ts, a.close AS x, b.close AS y FROM bars a JOIN bars b ON a.ts = b.ts AND a.ticker = '1-URGENT' AND b.ticker = '2-HIGH'), h AS (SELECT *, CASE WHEN count(*) OVER {P} = 60 THEN covar_samp(x, y) OVER {P} / nullif(var_samp(y) OVER {P}, 0) END AS beta FROM j), s AS (SELECT *, x - beta * y AS spread FROM h), z AS (SELECT ts, CASE WHEN count(spread) OVER {P} = 60 THEN (spread - avg(spread) OVER {P}) / nullif(stddev_samp(spread) OVER {P}, 0) END AS z FROM s), e AS (SELECT *, CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 WHEN abs(z) < 0.5 THEN 0 END AS event FROM z) SELECT ts, round(z, 3) AS z, coalesce(last_value(event IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS position FROM e", "bars")
def str_11_pairs(t: Tables):
    return N.pair_spread(t.bars, "1-URGENT", "2-HIGH").select("ts", F.round("z", 3).alias("z"), F.col("position").cast("long").alias("position"))


@query(f"WITH RECURSIVE n AS (SELECT *, row_number() OVER ({W}) AS k FROM bars), {ewm_sql('e12', 'close', 2 / 13)}, {ewm_sql('e26', 'close', 2 / 27)}, m AS (SELECT n.ticker, n.ts, n.k, e12.y - e26.y AS macd FROM n JOIN e12 USING (ticker, k) JOIN e26 USING (ticker, k)), {ewm_sql('e9', 'macd', 0.2, 'm').replace('n.ticker, n.k', 'n.ticker, n.k').replace('JOIN m n', 'JOIN m n')} SELECT m.ticker, m.ts, (CASE WHEN m.k = 1 THEN 0 WHEN macd > e9.y THEN 1 WHEN macd < e9.y THEN -1 ELSE 0 END)::BIGINT AS signal FROM m JOIN e9 USING (ticker, k)", "bars")
def str_13_macd_sign(t: Tables):
    m = S.ewm(t.bars, "close", {"e12": 2 / 13, "e26": 2 / 27}).withColumn("macd", F.col("e12") - F.col("e26"))
    m = S.ewm(m, "macd", {"e9": 0.2})
    return m.select("ticker", "ts", F.when(F.col("macd") > F.col("e9"), 1).when(F.col("macd") < F.col("e9"), -1).otherwise(0).cast("long").alias("signal"))


@query("WITH d AS (SELECT DISTINCT month AS day FROM panel), c AS (SELECT CAST(unnest(generate_series(min(day), max(day) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM d), r AS (SELECT c.day, (SELECT count(*) FROM panel p WHERE p.month <= c.day AND c.day < p.month + INTERVAL 30 DAY) AS n FROM c), u AS (SELECT d.day, (SELECT sum(CASE WHEN n > 0 THEN 1.0 / n ELSE 0 END) FROM r WHERE r.day >= d.day AND r.day < d.day + INTERVAL 30 DAY) / 30 AS u FROM d) SELECT day, round(u / max(u) OVER (), 6) AS weight FROM u", "panel")
def lbl_06_uniqueness(t: Tables):
    return N.label_uniqueness(t.panel.select(F.col("month").alias("day"), "ticker")).groupBy("day").agg(r6(F.max("weight"), "weight"))


GAPPY = "g AS (SELECT ticker, ts, CASE WHEN day(ts) % 4 = 0 OR month(ts) = 3 THEN NULL ELSE close END AS v FROM bars)"


@query(f"WITH {GAPPY} SELECT ticker, ts, round(coalesce(last_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)), 6) AS filled FROM g", "bars")
def jn_16_limited_fill(t: Tables):
    g = t.bars.withColumn("v", F.when((F.dayofmonth("ts") % 4 == 0) | (F.month("ts") == 3), None).otherwise(F.col("close")))
    return N.fill_limited(g, "v").select("ticker", "ts", r6("filled"))


EV = "ev AS (SELECT ticker, ts FROM bars WHERE day(ts) = 10)"


@query(f"WITH {EV}, b AS (SELECT ticker, ts, lag(close) OVER ({W}) AS before, lead(close) OVER ({W}) AS after FROM bars) SELECT ticker, ts, round(after / before - 1, 6) AS move FROM b WHERE day(ts) = 10", "bars")
def jn_13_event_moves(t: Tables):
    """Move from the last close before an event to the first after it: two as-of joins."""
    ev = t.bars.where("day(ts) = 10").select("ticker", "ts")
    before = S.asof_backward(ev.withColumn("ts", F.date_sub("ts", 1)), t.bars, "ticker", "ts", "close").select("ticker", F.date_add("ts", 1).alias("ts"), F.col("close").alias("before"))
    after = S.asof_forward(ev.withColumn("ts", F.date_add("ts", 1)), t.bars, "ticker", "ts", "close").select("ticker", F.date_sub("ts", 1).alias("ts"), F.col("close").alias("after"))
    return before.join(after, ["ticker", "ts"]).select("ticker", "ts", r6(F.col("after") / F.col("before") - 1, "move"))


@query(BT + " SELECT ticker, round(avg(coalesce(sr, 0)) * 252, 5) AS annual, round(skewness(coalesce(sr, 0)), 4) AS skew, round(kurtosis(coalesce(sr, 0)), 4) AS kurt FROM p GROUP BY ticker", "bars")
def bt_06_performance(t: Tables):
    x = G.backtest(G.ma_cross(t.bars))
    return x.groupBy("ticker").agg(F.round(F.avg("strategy_return") * 252, 5).alias("annual"), F.round(sample_skew("strategy_return"), 4).alias("skew"), F.round(sample_kurtosis("strategy_return"), 4).alias("kurt"))


@query("SELECT pk, round(least(greatest(v * 0.001, 1.0), 100.0), 6) AS percent, round(v * CASE WHEN v < 10000 THEN 0.002 WHEN v < 100000 THEN 0.001 ELSE 0.0005 END, 6) AS tiered, round(v * 5 / 10000, 6) AS slippage, round(v * (volatility * (0.314 * s + 0.142 * pow(s, 0.6))), 5) AS impact FROM (SELECT pk, current_price * (1 + pk % 50) AS v, (1 + pk % 50) / nullif(avg_volume, 0) AS s, volatility FROM xsection)", "xsection")
def bt_13_costs(t: Tables):
    n = 1 + F.col("pk") % 50
    v = F.col("current_price") * n
    return t.xsection.select("pk", r6(N.cost("percent", v), "percent"), r6(N.cost("tiered", v), "tiered"), r6(N.cost("slippage", v), "slippage"), F.round(N.cost("impact", v, n.cast("double"), F.col("avg_volume"), F.col("volatility")), 5).alias("impact"))


@query(f"SELECT ticker, ts, round(max(close) OVER ({W}) * 0.9, 6) AS trailing_stop, close < max(close) OVER ({W}) * 0.9 AS stopped FROM bars", "bars")
def bt_15_trailing_stop(t: Tables):
    from pyspark.sql import Window

    top = F.max("close").over(S.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return t.bars.select("ticker", "ts", r6(top * 0.9, "trailing_stop"), (F.col("close") < top * 0.9).alias("stopped"))


@query(BT + f", e AS (SELECT ticker, ts, product(1 + coalesce(sr, 0)) OVER ({W}) AS equity FROM p), d AS (SELECT *, equity / max(equity) OVER ({W}) - 1 AS dd FROM e), v AS (SELECT *, CASE WHEN dd <= -0.2 THEN 0 WHEN dd >= -0.1 THEN 1 END AS event FROM d) SELECT ticker, ts, coalesce(last_value(event IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 1) = 1 AS active FROM v", "bars")
def bt_16_circuit_breaker(t: Tables):
    return N.circuit_breaker(G.backtest(G.ma_cross(t.bars))).select("ticker", "ts", "active")


STATE = f"""WITH x AS (SELECT ticker, ts, close, {roll('avg', 'close', 50)} AS a, {roll('avg', 'close', 200)} AS b, coalesce(close / lag(close, 62) OVER ({W}) - 1, 0) AS r, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bars)
SELECT ticker, CASE WHEN b IS NULL THEN 'NEUTRAL' WHEN close > a AND close > b THEN CASE WHEN r > 0.05 THEN 'STRONG_UP' WHEN r >= -0.02 THEN 'UP' ELSE 'NEUTRAL' END
  WHEN NOT close > a AND NOT close > b THEN CASE WHEN r < -0.05 THEN 'STRONG_DOWN' ELSE 'DOWN' END ELSE CASE WHEN r < -0.03 THEN 'DOWN' WHEN r > 0.03 THEN 'UP' ELSE 'NEUTRAL' END END AS state FROM x WHERE k = 1"""


@query(STATE, "bars")
def scr_36_sector_state(t: Tables):
    return N.sector_state(t.bars).select("ticker", "state")


@query("WITH s AS (SELECT sector, avg(return_6m) AS m, avg(return_3m) AS r FROM xsection WHERE sector IS NOT NULL GROUP BY sector), k AS (SELECT sector, row_number() OVER (ORDER BY round(m, 9) DESC, sector) AS km, row_number() OVER (ORDER BY round(r, 9) DESC, sector) AS kr FROM s) SELECT sector, km AS slow_rank, kr AS fast_rank, CASE WHEN km - kr >= 2 THEN 'IN' WHEN km - kr <= -2 THEN 'OUT' ELSE 'STAY' END AS rotation FROM k", "xsection")
def scr_38_sector_rotation(t: Tables):
    from pyspark.sql import Window

    s = t.xsection.where("sector is not null").groupBy("sector").agg(F.round(F.avg("return_6m"), 9).alias("m"), F.round(F.avg("return_3m"), 9).alias("r"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "sector")).cast("long")  # noqa: E731  a row for each sector
    k = s.withColumns({"slow_rank": rank("m"), "fast_rank": rank("r")})
    gap = F.col("slow_rank") - F.col("fast_rank")
    return k.select("sector", "slow_rank", "fast_rank", F.when(gap >= 2, "IN").when(gap <= -2, "OUT").otherwise("STAY").alias("rotation"))


@query(BT + ", a AS (SELECT ticker, sum(CASE WHEN sr > 0 THEN 1 ELSE 0 END) AS w, sum(CASE WHEN sr < 0 THEN 1 ELSE 0 END) AS l, avg(CASE WHEN sr > 0 THEN sr END) AS g, abs(avg(CASE WHEN sr < 0 THEN sr END)) AS s FROM p GROUP BY ticker) SELECT ticker, round(greatest(w * 1.0 / (w + l) - (1 - w * 1.0 / (w + l)) / (g / s), 0) * 0.25, 6) AS fraction FROM a", "bars")
def pf_13_kelly(t: Tables):
    x, r = G.backtest(G.ma_cross(t.bars)), F.col("strategy_return")
    a = x.groupBy("ticker").agg(F.count_if(r > 0).alias("w"), F.count_if(r < 0).alias("l"), F.avg(F.when(r > 0, r)).alias("g"), F.abs(F.avg(F.when(r < 0, r))).alias("s"))
    return a.select("ticker", r6(N.kelly(F.col("w"), F.col("l"), F.col("g"), F.col("s")), "fraction"))
