"""Queries over bars: indicators, labels, strategy signals, backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import known, ratio, sample_kurtosis, sample_skew
from tallyloom.operators import strategies as G
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

W = "PARTITION BY ticker ORDER BY ts"


def roll(agg: str, c: str, n: int) -> str:
    w = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} = {n} THEN {agg}({c}) {w} END"


CH = "ch AS (SELECT *, close - lag(close) OVER (" + W + ") AS change, close / lag(close) OVER (" + W + ") - 1 AS r FROM bars)"


@query(f"SELECT ticker, ts, round(close / lag(close, 5) OVER ({W}) - 1, 6) AS r5, round(ln(close / lag(close) OVER ({W})), 6) AS log_r FROM bars", "bars")
def win_01_02_returns(t: Tables):
    return t.bars.select("ticker", "ts", r6(S.returns("close", 5), "r5"), r6(S.log_returns(), "log_r"))


@query(f"SELECT ticker, ts, round({roll('avg', 'close', 20)}, 6) AS sma20, round({roll('stddev_samp', 'close', 20)}, 5) AS std20 FROM bars", "bars")
def win_03_10_sma_and_bands(t: Tables):
    return t.bars.select("ticker", "ts", r6(S.sma("close", 20), "sma20"), F.round(S.rolling_std("close", 20), 5).alias("std20"))


GAIN, LOSS = roll("avg", "gain", 14), roll("avg", "loss", 14)


@query(f"WITH {CH}, gl AS (SELECT *, CASE WHEN change IS NULL THEN NULL ELSE greatest(change, 0) END AS gain, CASE WHEN change IS NULL THEN NULL ELSE greatest(-change, 0) END AS loss FROM ch), m AS (SELECT ticker, ts, {GAIN} AS g, {LOSS} AS l FROM gl) SELECT ticker, ts, round(CASE WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 5) AS rsi FROM m", "bars")
def win_05_rsi_simple(t: Tables):
    return S.with_changes(t.bars).select("ticker", "ts", F.round(S.rsi_simple(), 5).alias("rsi"))


def ewm_sql(name: str, c: str, a: float, source: str = "n") -> str:
    return f"{name} AS (SELECT ticker, k, CAST({c} AS DOUBLE) AS y FROM {source} WHERE k = 1 UNION ALL SELECT n.ticker, n.k, y * (1 - {a}::DOUBLE) + n.{c} * {a}::DOUBLE FROM {name} e JOIN {source} n ON n.ticker = e.ticker AND n.k = e.k + 1)"


@query(f"WITH RECURSIVE n AS (SELECT *, row_number() OVER ({W}) AS k FROM bars), {ewm_sql('e12', 'close', 2 / 13)}, {ewm_sql('e26', 'close', 2 / 27)} SELECT n.ticker, n.ts, round(e12.y, 4) AS ema12, round(e12.y - e26.y, 4) AS macd FROM n JOIN e12 USING (ticker, k) JOIN e26 USING (ticker, k)", "bars")
def win_04_09_ema_macd(t: Tables):
    out = S.ewm(t.bars, "close", {"e12": 2 / 13, "e26": 2 / 27})
    return out.select("ticker", "ts", F.round("e12", 4).alias("ema12"), F.round(F.col("e12") - F.col("e26"), 4).alias("macd"))


TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars)"


@query(f"WITH {TR} SELECT ticker, ts, round({roll('avg', 'tr', 14)}, 5) AS atr FROM tr", "bars")
def win_11_atr(t: Tables):
    return t.bars.withColumn("tr", S.true_range()).select("ticker", "ts", F.round(S.sma("tr", 14), 5).alias("atr"))


@query(f"WITH {CH} SELECT ticker, ts, round({roll('stddev_samp', 'r', 20)} * sqrt(252), 6) AS vol20 FROM ch", "bars")
def win_13_volatility(t: Tables):
    return S.with_changes(t.bars).select("ticker", "ts", r6(S.rolling_std("r", 20) * F.sqrt(F.lit(252.0)), "vol20"))


@query(f"SELECT ticker, ts, round(close / {roll('max', 'close', 252)} - 1, 6) AS from_high, round(close / {roll('min', 'close', 252)} - 1, 6) AS from_low FROM bars", "bars")
def win_14_year_range(t: Tables):
    high, low = S.full(F.max("close"), "close", 252), S.full(F.min("close"), "close", 252)
    return t.bars.select("ticker", "ts", r6(ratio("close", high) - 1, "from_high"), r6(ratio("close", low) - 1, "from_low"))


@query(f"SELECT ticker, ts, round(close / {roll('avg', 'close', 50)} - 1, 6) AS vs50, round(close / {roll('avg', 'close', 200)} - 1, 6) AS vs200, coalesce({roll('avg', 'close', 50)} > {roll('avg', 'close', 200)}, false) AS golden FROM bars", "bars")
def win_15_moving_averages(t: Tables):
    a, b = S.sma("close", 50), S.sma("close", 200)
    return t.bars.select("ticker", "ts", r6(ratio("close", a) - 1, "vs50"), r6(ratio("close", b) - 1, "vs200"), known(a > b).alias("golden"))


@query(f"SELECT ticker, ts, round({roll('avg', 'volume', 5)} / {roll('avg', 'volume', 20)}, 6) AS volume_ratio FROM bars", "bars")
def win_16_volume_ratio(t: Tables):
    return t.bars.select("ticker", "ts", r6(ratio(S.sma("volume", 5), S.sma("volume", 20)), "volume_ratio"))


@query(f"WITH {CH}, e AS (SELECT *, product(1 + coalesce(r, 0)) OVER ({W}) AS equity FROM ch) SELECT ticker, ts, round(equity, 6) AS equity, round(equity / max(equity) OVER ({W}) - 1, 6) AS drawdown FROM e", "bars")
def win_18_bt_02_drawdown(t: Tables):
    w = S.ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = S.with_changes(t.bars).withColumn("equity", F.product(1 + F.coalesce("r", F.lit(0.0))).over(w))
    return out.select("ticker", "ts", r6("equity"), r6(S.drawdown("equity"), "drawdown"))


@query(f"WITH {CH}, l AS (SELECT *, lag(r) OVER ({W}) AS r1 FROM ch) SELECT ticker, round(corr(r, r1), 6) AS autocorr FROM l GROUP BY ticker", "bars")
def win_19_autocorrelation(t: Tables):
    out = S.with_changes(t.bars).withColumn("r1", F.lag("r").over(S.ordered()))
    return out.where("r is not null and r1 is not null").groupBy("ticker").agg(r6(F.corr("r", "r1"), "autocorr"))


@query(f"SELECT ticker, ts, round(CASE WHEN count(*) OVER ({W} ROWS 19 PRECEDING) = 20 AND max(volume) OVER ({W} ROWS 19 PRECEDING) > min(volume) OVER ({W} ROWS 19 PRECEDING) THEN corr(close, volume) OVER ({W} ROWS 19 PRECEDING) END, 4) + 0.0 AS pv FROM bars", "bars")
def win_20_price_volume(t: Tables):
    w, v = S.last_n(20), F.col("volume").cast("double")
    c = ratio(F.covar_samp("close", v).over(w), F.stddev_samp("close").over(w) * F.stddev_samp(v).over(w))
    moves = (F.count("*").over(w) == 20) & (F.max("volume").over(w) > F.min("volume").over(w))
    return t.bars.select("ticker", "ts", F.round(F.when(moves, c), 4).alias("pv"))


STREAK = f"""WITH {CH}, d AS (SELECT *, CASE WHEN change > 0 THEN 1 WHEN change < 0 THEN -1 ELSE 0 END AS dir FROM ch),
f AS (SELECT *, CASE WHEN dir = lag(dir) OVER ({W}) THEN 0 ELSE 1 END AS fresh FROM d), i AS (SELECT *, sum(fresh) OVER ({W}) AS island FROM f)
SELECT ticker, ts, dir::BIGINT AS dir, row_number() OVER (PARTITION BY ticker, island ORDER BY ts) AS streak FROM i"""


@query(STREAK, "bars")
def win_23_streaks(t: Tables):
    """Runs of days in one direction: gaps and islands."""
    d = S.with_changes(t.bars).withColumn("dir", F.when(F.col("change") > 0, 1).when(F.col("change") < 0, -1).otherwise(0))
    d = d.withColumn("fresh", F.when(F.col("dir") == F.lag("dir").over(S.ordered()), 0).otherwise(1))
    d = d.withColumn("island", F.sum("fresh").over(S.ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return d.select("ticker", "ts", F.col("dir").cast("long").alias("dir"), F.row_number().over(Window.partitionBy("ticker", "island").orderBy("ts")).cast("long").alias("streak"))


@query(f"WITH {CH} SELECT ticker, round(skewness(r), 5) AS skew, round(kurtosis(r), 5) AS kurt, round(avg(CASE WHEN r > 0 THEN r END) / abs(avg(CASE WHEN r < 0 THEN r END)), 6) AS vol_skew FROM ch GROUP BY ticker", "bars")
def win_25_moments(t: Tables):
    r = F.col("r")
    return S.with_changes(t.bars).groupBy("ticker").agg(F.round(sample_skew("r"), 5).alias("skew"), F.round(sample_kurtosis("r"), 5).alias("kurt"), r6(ratio(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))), "vol_skew"))


@query(f"WITH n AS (SELECT *, row_number() OVER ({W}) AS k FROM bars) SELECT a.ticker, a.ts, round(CASE WHEN a.k >= 60 THEN (sum(CASE WHEN b.close < a.close THEN 1 ELSE 0 END) + (sum(CASE WHEN b.close = a.close THEN 1 ELSE 0 END) + 1) / 2.0) / 60 END, 6) AS own_rank FROM n a JOIN n b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 59 AND a.k GROUP BY a.ticker, a.ts, a.k", "bars")
def win_26_rolling_rank(t: Tables):
    return t.bars.select("ticker", "ts", r6(S.rolling_rank("close", 60), "own_rank"))


@query(f"WITH {CH} SELECT ticker, ts, round(CASE WHEN count(r) OVER ({W} ROWS 125 PRECEDING) = 126 THEN avg(r) OVER ({W} ROWS 125 PRECEDING) / nullif(stddev_samp(r) OVER ({W} ROWS 125 PRECEDING), 0) * sqrt(252) END, 5) AS sharpe FROM ch", "bars")
def win_27_rolling_sharpe(t: Tables):
    s = ratio(S.sma("r", 126), S.rolling_std("r", 126)) * F.sqrt(F.lit(252.0))
    return S.with_changes(t.bars).select("ticker", "ts", F.round(s, 5).alias("sharpe"))


@query("WITH m AS (SELECT ticker, CAST(date_trunc('month', ts) AS DATE) AS month, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2) SELECT ticker, month, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY month) - 1, 6) AS r FROM m", "bars")
def win_29_month_returns(t: Tables):
    m = t.bars.groupBy("ticker", F.trunc("ts", "MM").alias("month")).agg(F.max_by("close", "ts").alias("close"))
    return m.select("ticker", "month", r6(ratio("close", F.lag("close").over(S.ordered(ts="month"))) - 1, "r"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, max(ts) AS rebalance FROM bars GROUP BY 1", "bars")
def win_30_rebalance_dates(t: Tables):
    return t.bars.groupBy(F.trunc("ts", "WEEK").alias("week")).agg(F.max("ts").alias("rebalance"))


@query("SELECT ticker, max(ts) AS ts, round(arg_max(close, ts), 6) AS close FROM bars GROUP BY ticker", "bars")
def win_31_latest_row(t: Tables):
    return t.bars.groupBy("ticker").agg(F.max("ts").alias("ts"), r6(F.max_by("close", "ts"), "close"))


BARRIER = f"""WITH n AS (SELECT *, row_number() OVER ({W}) AS k FROM bars), j AS (SELECT a.ticker, a.ts, a.k,
  min(CASE WHEN b.close >= a.close * (1 + 0.10::DOUBLE) THEN b.k END) AS up, min(CASE WHEN b.close <= a.close * (1 - 0.05::DOUBLE) THEN b.k END) AS down
  FROM n a LEFT JOIN n b ON a.ticker = b.ticker AND b.k BETWEEN a.k + 1 AND a.k + 29 GROUP BY ALL)
SELECT ticker, ts, CASE WHEN up IS NOT NULL AND (down IS NULL OR up < down) THEN 1 ELSE 0 END AS label FROM j"""


@query(BARRIER, "bars")
def lbl_01_triple_barrier(t: Tables):
    """1 if the upper barrier is touched within 29 bars and before the lower one."""
    return G.triple_barrier(t.bars).select("ticker", "ts", "label")


@query(f"WITH n AS (SELECT *, row_number() OVER ({W}) AS k, lead(close, 30) OVER ({W}) AS later FROM bars) SELECT ticker, ts, round(later / close - 1, 6) AS forward FROM n WHERE k >= 252 AND (k - 252) % 21 = 0 AND later / close - 1 BETWEEN -0.95 AND 5", "bars")
def lbl_02_forward_returns(t: Tables):
    w = S.ordered()
    n = t.bars.withColumn("k", F.row_number().over(w)).withColumn("f", ratio(F.lead("close", 30).over(w), "close") - 1)
    return n.where("k >= 252 and (k - 252) % 21 = 0 and f between -0.95 and 5").select("ticker", "ts", r6("f", "forward"))


@query(f"WITH {CH}, s AS (SELECT *, CASE WHEN close / lag(close, 60) OVER ({W}) - 1 > 0 THEN 1 ELSE 0 END AS raw, row_number() OVER ({W}) - 1 AS k FROM ch), h AS (SELECT *, first_value(raw) OVER (PARTITION BY ticker, k // 20 ORDER BY ts) AS signal FROM s) SELECT ticker, ts, signal::BIGINT AS signal FROM h", "bars")
def str_01_momentum_hold(t: Tables):
    return G.momentum_hold(t.bars, 60, 20).select("ticker", "ts", F.col("signal").cast("long").alias("signal"))


@query("SELECT ticker, ts, (CASE WHEN month(ts) IN (11, 12, 1, 2, 3, 4) THEN 1 ELSE 0 END)::BIGINT AS by_month, (CASE WHEN isodow(ts) = 1 THEN -1 WHEN isodow(ts) = 5 THEN 1 ELSE 0 END)::BIGINT AS by_day FROM bars", "bars")
def str_04_seasonality(t: Tables):
    day = F.weekday("ts")
    return t.bars.select("ticker", "ts", F.when(F.month("ts").isin(11, 12, 1, 2, 3, 4), 1).otherwise(0).cast("long").alias("by_month"), F.when(day == 0, -1).when(day == 4, 1).otherwise(0).cast("long").alias("by_day"))


@query(f"WITH b AS (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars) SELECT ticker, ts, (CASE WHEN close < m - 2 * s THEN 1 WHEN close > m + 2 * s THEN -1 ELSE 0 END)::BIGINT AS signal FROM b", "bars")
def str_09_bollinger(t: Tables):
    return G.bollinger(t.bars).select("ticker", "ts", F.col("signal").cast("long").alias("signal"))


@query(f"SELECT ticker, ts, (CASE WHEN {roll('avg', 'close', 20)} > {roll('avg', 'close', 50)} THEN 1 WHEN {roll('avg', 'close', 20)} < {roll('avg', 'close', 50)} THEN -1 ELSE 0 END)::BIGINT AS signal FROM bars", "bars")
def str_12_ma_cross(t: Tables):
    return G.ma_cross(t.bars).select("ticker", "ts", F.col("signal").cast("long").alias("signal"))


DONCHIAN = f"""WITH e AS (SELECT ticker, ts, CASE WHEN row_number() OVER ({W}) <= 20 THEN NULL WHEN close > max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 1 WHEN close < min(low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) THEN 0 END AS event FROM bars)
SELECT ticker, ts, coalesce(last_value(event IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS position FROM e"""


@query(DONCHIAN, "bars")
def str_06_donchian(t: Tables):
    """Breakout with a position that holds until the next event."""
    return G.donchian(t.bars).select("ticker", "ts", F.col("position").cast("long").alias("position"))


CROSS = f"s AS (SELECT *, CASE WHEN {roll('avg', 'close', 20)} > {roll('avg', 'close', 50)} THEN 1 WHEN {roll('avg', 'close', 20)} < {roll('avg', 'close', 50)} THEN -1 ELSE 0 END AS signal FROM ch)"
BT = f"WITH {CH}, {CROSS}, p AS (SELECT *, lag(signal) OVER ({W}) * r AS sr FROM s)"


@query(BT + f" SELECT ticker, ts, round(coalesce(sr, 0), 6) + 0.0 AS strategy_return, round(product(1 + coalesce(sr, 0)) OVER ({W}), 5) + 0.0 AS equity FROM p", "bars")
def bt_01_02_strategy_equity(t: Tables):
    return G.backtest(G.ma_cross(t.bars)).select("ticker", "ts", r6("strategy_return"), F.round("equity", 5).alias("equity"))


@query(BT + f""", e AS (SELECT *, coalesce(sr, 0) AS x, product(1 + coalesce(sr, 0)) OVER ({W}) AS equity FROM p), d AS (SELECT *, equity / max(equity) OVER ({W}) - 1 AS dd FROM e)
SELECT ticker, count(*) AS n, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 5) AS sharpe, round(avg(x) * sqrt(252) / nullif(stddev_samp(CASE WHEN x < 0 THEN x END), 0), 5) AS sortino,
  round(min(dd), 6) AS max_drawdown, round(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN x <> 0 THEN 1 ELSE 0 END), 0), 6) AS win_rate,
  round(sum(CASE WHEN x > 0 THEN x END) / nullif(abs(sum(CASE WHEN x < 0 THEN x END)), 0), 5) AS profit_factor FROM d GROUP BY ticker""", "bars")
def bt_04_metrics(t: Tables):
    m = G.metrics(G.backtest(G.ma_cross(t.bars)))
    return m.select("ticker", "n", F.round("sharpe", 5).alias("sharpe"), F.round("sortino", 5).alias("sortino"), r6("max_drawdown"), r6("win_rate"), F.round("profit_factor", 5).alias("profit_factor"))


@query(f"WITH {CH}, {CROSS}, c AS (SELECT *, coalesce(lag(signal) OVER ({W}), 0) AS before FROM s), e AS (SELECT *, CASE WHEN signal <> before THEN 1 ELSE 0 END AS turn FROM c), x AS (SELECT ticker, ts, close, signal, lead(ts) OVER ({W}) AS exit_ts, lead(close) OVER ({W}) AS exit_close FROM e WHERE turn = 1) SELECT ticker, ts AS entry_ts, exit_ts, signal::BIGINT AS direction, round(signal * (exit_close / close - 1), 6) AS pnl FROM x WHERE signal <> 0 AND exit_ts IS NOT NULL", "bars")
def bt_03_jn_14_trades(t: Tables):
    return G.trades(G.ma_cross(t.bars)).select("ticker", "entry_ts", "exit_ts", F.col("direction").cast("long").alias("direction"), r6("pnl"))


@query("WITH " + CH + ", p AS (SELECT a.ticker AS a, b.ticker AS b, corr(a.r, b.r) AS c, count(*) AS n FROM ch a JOIN ch b ON a.ts = b.ts AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2) SELECT a, b, n, round(c, 6) AS correlation FROM p", "bars")
def jn_19_pf_05_pairwise_correlation(t: Tables):
    return G.pairwise_correlation(S.with_changes(t.bars)).select("a", "b", "n", r6("correlation"))


@query("WITH ev AS (SELECT ticker, CAST(ts + INTERVAL 3 DAY AS DATE) AS ts FROM bars WHERE day(ts) = 15) SELECT ev.ticker, ev.ts, round(b.close, 6) AS close FROM ev ASOF LEFT JOIN bars b ON ev.ticker = b.ticker AND ev.ts >= b.ts", "bars")
def jn_11_asof_backward(t: Tables):
    left = t.bars.where("day(ts) = 15").select("ticker", F.date_add("ts", 3).alias("ts"))
    return S.asof_backward(left, t.bars, "ticker", "ts", "close").select("ticker", "ts", r6("close"))


@query("WITH ev AS (SELECT ticker, CAST(ts + INTERVAL 3 DAY AS DATE) AS ts FROM bars WHERE day(ts) = 15) SELECT ev.ticker, ev.ts, round(b.close, 6) AS close FROM ev ASOF LEFT JOIN bars b ON ev.ticker = b.ticker AND ev.ts <= b.ts", "bars")
def jn_12_asof_forward(t: Tables):
    left = t.bars.where("day(ts) = 15").select("ticker", F.date_add("ts", 3).alias("ts"))
    return S.asof_forward(left, t.bars, "ticker", "ts", "close").select("ticker", "ts", r6("close"))


@query("WITH " + CH + " SELECT ticker, round(quantile_cont(r, 0.05), 6) AS var95, round(avg(r) - 1.645 * stddev_samp(r), 6) AS var_parametric, round((SELECT avg(b.r) FROM ch b WHERE b.ticker = ch.ticker AND b.r <= quantile_cont(ch.r, 0.05)), 6) AS cvar95 FROM ch GROUP BY ticker".replace("(SELECT avg(b.r) FROM ch b WHERE b.ticker = ch.ticker AND b.r <= quantile_cont(ch.r, 0.05))", "avg(r) FILTER (r <= q)").replace("FROM ch GROUP BY", "FROM (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY ticker) AS q FROM ch) GROUP BY"), "bars")
def pf_08_var(t: Tables):
    return G.value_at_risk(S.with_changes(t.bars)).select("ticker", r6("var95"), r6("var_parametric"), r6("cvar95"))


@query("WITH " + CH + ", m AS (SELECT ts, avg(r) AS mr FROM ch GROUP BY ts) SELECT ticker, round(covar_samp(r, mr) / var_samp(mr), 5) AS beta, round(corr(r, mr), 6) AS corr FROM ch JOIN m USING (ts) WHERE r IS NOT NULL GROUP BY ticker", "bars")
def pf_09_beta(t: Tables):
    return G.market_beta(S.with_changes(t.bars)).select("ticker", F.round("beta", 5).alias("beta"), r6("corr"))


@query("WITH " + CH + ", v AS (SELECT ticker, 1 / stddev_samp(r) AS w FROM ch GROUP BY ticker) SELECT ticker, round(w / sum(w) OVER (), 6) AS weight FROM v", "bars")
def pf_07_inverse_vol(t: Tables):
    return G.inverse_vol(S.with_changes(t.bars)).select("ticker", r6("weight"))
