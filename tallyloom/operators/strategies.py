"""Strategy signals, labels, backtests and risk figures over bars (ticker, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import ratio


def triple_barrier(bars: DataFrame, up: float = 0.10, down: float = 0.05, bars_ahead: int = 29) -> DataFrame:
    ahead = F.collect_list("close").over(S.ordered().rowsBetween(1, bars_ahead))
    first = lambda hit: F.array_position(F.transform("ahead", hit), True)
    out = bars.withColumn("ahead", ahead)
    out = out.withColumn("hit_up", first(lambda x: x >= F.col("close") * (1 + up))).withColumn("hit_down", first(lambda x: x <= F.col("close") * (1 - down)))
    won = (F.col("hit_up") > 0) & ((F.col("hit_down") == 0) | (F.col("hit_up") < F.col("hit_down")))
    return out.withColumn("label", F.when(won, 1).otherwise(0)).drop("ahead", "hit_up", "hit_down")


def momentum_hold(bars: DataFrame, lookback: int, hold: int) -> DataFrame:
    """1 after a rise over lookback bars, looked at every hold bars and held between."""
    raw = bars.withColumn("raw", F.when(S.returns("close", lookback) > 0, 1).otherwise(0)).withColumn("k", F.row_number().over(S.ordered()) - 1)
    return raw.withColumn("signal", F.first("raw").over(Window.partitionBy("ticker", F.floor(F.col("k") / hold)).orderBy("ts")))


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    out = bars.withColumn("mid", S.sma("close", n)).withColumn("dev", S.rolling_std("close", n) * width)
    return out.withColumn("signal", F.when(F.col("close") < F.col("mid") - F.col("dev"), 1).when(F.col("close") > F.col("mid") + F.col("dev"), -1).otherwise(0))


def ma_cross(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    out = bars.withColumn("fast", S.sma("close", fast)).withColumn("slow", S.sma("close", slow))
    return out.withColumn("signal", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") < F.col("slow"), -1).otherwise(0))


def donchian(bars: DataFrame, enter: int = 20, leave: int = 10) -> DataFrame:
    """Long above the high of the last enter bars, out below the low of the last leave bars, held between.

    The last event decides: no fold is needed, a running last value keeps the state.
    """
    before = lambda n: S.ordered().rowsBetween(-n, -1)
    event = F.when(F.col("close") > F.max("high").over(before(enter)), 1).when(F.col("close") < F.min("low").over(before(leave)), 0)
    event = F.when(F.row_number().over(S.ordered()) > enter, event)
    held = F.last(F.col("event"), ignorenulls=True).over(S.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("event", event).withColumn("position", F.coalesce(held, F.lit(0))).drop("event")


def backtest(signals: DataFrame) -> DataFrame:
    """Yesterday's signal earns today's return; equity compounds."""
    out = S.with_changes(signals).withColumn("strategy_return", F.coalesce(F.lag("signal").over(S.ordered()) * F.col("r"), F.lit(0.0)))
    return out.withColumn("equity", F.product(1 + F.col("strategy_return")).over(S.ordered().rowsBetween(Window.unboundedPreceding, 0)))


def metrics(tested: DataFrame, periods: int = 252) -> DataFrame:
    x = F.col("strategy_return")
    year = F.sqrt(F.lit(float(periods)))
    return (
        tested.withColumn("dd", S.drawdown("equity"))
        .groupBy("ticker")
        .agg(
            F.count("*").alias("n"),
            (ratio(F.avg(x), F.stddev_samp(x)) * year).alias("sharpe"),
            ratio(F.avg(x) * year, F.stddev_samp(F.when(x < 0, x))).alias("sortino"),
            F.min("dd").alias("max_drawdown"),
            ratio(F.count_if(x > 0), F.count_if(x != 0)).alias("win_rate"),
            ratio(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x)))).alias("profit_factor"),
        )
    )


def trades(signals: DataFrame) -> DataFrame:
    """A trade from each change of the signal to the next one."""
    w = S.ordered()
    turns = signals.withColumn("before", F.coalesce(F.lag("signal").over(w), F.lit(0))).where("signal <> before")
    turns = turns.withColumn("exit_ts", F.lead("ts").over(w)).withColumn("exit_close", F.lead("close").over(w))
    pnl = F.col("signal") * (ratio("exit_close", "close") - 1)
    return turns.where("signal <> 0 and exit_ts is not null").select("ticker", F.col("ts").alias("entry_ts"), "exit_ts", F.col("signal").alias("direction"), F.col("close").alias("entry_price"), F.col("exit_close").alias("exit_price"), pnl.alias("pnl"))


def pairwise_correlation(changes: DataFrame) -> DataFrame:
    """Correlation of the returns of each pair of tickers, joined by day."""
    r = changes.where("r is not null").select("ticker", "ts", "r")
    a, b = r.toDF("a", "ts", "ra"), r.toDF("b", "ts", "rb")
    return a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("correlation"))


def value_at_risk(changes: DataFrame, level: float = 0.05) -> DataFrame:
    cut = changes.groupBy("ticker").agg(F.percentile("r", F.lit(level)).alias("var95"))
    return changes.join(cut, "ticker").groupBy("ticker").agg(F.first("var95").alias("var95"), (F.avg("r") - 1.645 * F.stddev_samp("r")).alias("var_parametric"), F.avg(F.when(F.col("r") <= F.col("var95"), F.col("r"))).alias("cvar95"))


def market_beta(changes: DataFrame) -> DataFrame:
    market = changes.groupBy("ts").agg(F.avg("r").alias("mr"))
    both = changes.join(market, "ts").where("r is not null")
    return both.groupBy("ticker").agg(ratio(F.covar_samp("r", "mr"), F.var_samp("mr")).alias("beta"), F.corr("r", "mr").alias("corr"))


def inverse_vol(changes: DataFrame) -> DataFrame:
    w = changes.groupBy("ticker").agg(ratio(F.lit(1.0), F.stddev_samp("r")).alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    return w.crossJoin(F.broadcast(total)).withColumn("weight", ratio("w", "total")).select("ticker", "weight")
