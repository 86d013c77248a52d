"""More indicators, signals and labels over bars; recursive ones are folds over a key's ordered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import known, ratio


def rsi_ewm(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI from exponentially weighted rises and falls, alpha 1/n."""
    x = bars.withColumn("change", F.col("close") - F.lag("close").over(S.ordered())).where("change is not null")
    x = x.withColumns({"up": F.greatest("change", F.lit(0.0)), "down": F.greatest(-F.col("change"), F.lit(0.0))})
    both = S.ewm(x, "up", {"avg_up": 1 / n}).join(S.ewm(x, "down", {"avg_down": 1 / n}).select("ticker", "ts", "avg_down"), ["ticker", "ts"])
    return both.withColumn("rsi", F.when(F.col("avg_down") == 0, 100.0).otherwise(100 - 100 / (1 + ratio("avg_up", "avg_down"))))


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional index from simple means of the directional moves and the true range."""
    up, down = F.col("high") - F.lag("high").over(S.ordered()), F.lag("low").over(S.ordered()) - F.col("low")
    x = bars.withColumns({"tr": S.true_range(), "up": up, "down": down})
    x = x.withColumns({"plus": F.when((F.col("up") > F.col("down")) & (F.col("up") > 0), F.col("up")).otherwise(0.0), "minus": F.when((F.col("down") > F.col("up")) & (F.col("down") > 0), F.col("down")).otherwise(0.0)})
    x = x.withColumns({"pdi": 100 * ratio(S.sma("plus", n), S.sma("tr", n)), "mdi": 100 * ratio(S.sma("minus", n), S.sma("tr", n))})
    x = x.withColumn("dx", 100 * ratio(F.abs(F.col("pdi") - F.col("mdi")), F.col("pdi") + F.col("mdi")))
    return x.withColumn("adx", S.sma("dx", n))


def window_drawdown(n: int = 60) -> Column:
    """Deepest fall from a peak within the last n closes: one pass over the window's values."""
    values = F.collect_list("close").over(S.last_n(n))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, x):
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], x / peak - 1).alias("worst"))

    return F.when(F.count("close").over(S.last_n(n)) == n, F.aggregate(values, start, step, lambda acc: acc["worst"]))


def momentum_tails(bars: DataFrame, lookback: int = 20, n: int = 60, top: float = 0.8, bottom: float = 0.2) -> DataFrame:
    """Long in the top of its own history of momentum, short in the bottom."""
    x = bars.withColumn("momentum", S.returns("close", lookback))
    x = x.withColumn("place", S.rolling_rank("momentum", n))
    return x.withColumn("signal", F.when(F.col("place") >= top, 1).when(F.col("place") <= bottom, -1).otherwise(0))


def dual_momentum(bars: DataFrame, n: int = 60) -> DataFrame:
    """Long while the series beats both zero and the mean of all series over n bars."""
    x = bars.withColumn("momentum", S.returns("close", n))
    x = x.withColumn("others", F.avg("momentum").over(Window.partitionBy("ts")))
    return x.withColumn("signal", F.when((F.col("momentum") > 0) & (F.col("momentum") > F.col("others")), 1).otherwise(0))


def trend_with_adx(bars: DataFrame, fast: int = 20, slow: int = 50, strong: float = 20.0) -> DataFrame:
    x = adx(bars).withColumns({"fast": S.sma("close", fast), "slow": S.sma("close", slow)})
    ok = known(F.col("adx") > strong)
    return x.withColumn("signal", F.when(ok & (F.col("fast") > F.col("slow")), 1).when(ok & (F.col("fast") < F.col("slow")), -1).otherwise(0))


def pair_spread(bars: DataFrame, a: str, b: str, n: int = 60, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """Two series by day: rolling hedge ratio, z-score of the spread, and a position held between entry and exit."""
    x, y = bars.where(F.col("ticker") == a).select("ts", F.col("close").alias("x")), bars.where(F.col("ticker") == b).select("ts", F.col("close").alias("y"))
    both = x.join(y, "ts").withColumn("pair", F.lit(f"{a}|{b}"))
    w = Window.partitionBy("pair").orderBy("ts").rowsBetween(1 - n, 0)
    full = F.count("*").over(w) == n
    both = both.withColumn("beta", F.when(full, ratio(F.covar_samp("x", "y").over(w), F.var_samp("y").over(w)))).withColumn("spread", F.col("x") - F.col("beta") * F.col("y"))
    z = F.when(F.count("spread").over(w) == n, ratio(F.col("spread") - F.avg("spread").over(w), F.stddev_samp("spread").over(w)))
    both = both.withColumn("z", z)
    event = F.when(F.col("z") > enter, -1).when(F.col("z") < -enter, 1).when(F.abs("z") < leave, 0)
    held = F.last(F.col("event"), ignorenulls=True).over(Window.partitionBy("pair").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("event", event).withColumn("position", F.coalesce(held, F.lit(0))).drop("event")


def label_uniqueness(events: DataFrame, days: int = 30) -> DataFrame:
    """Weight of each label by how few others run at the same time, the largest being 1.

    Labels run from their day for `days` days.  Starts and ends sweep along the days: the running sum is how many run;
    a prefix sum of its inverse, taken at both ends, gives the mean of 1 / concurrency over a label's days.
    """
    starts = events.groupBy("day").agg(F.count("*").alias("c"))
    calendar = events.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", F.date_add("b", days))).alias("day"))
    change = starts.unionByName(starts.select(F.date_add("day", days).alias("day"), (-F.col("c")).alias("c"))).groupBy("day").agg(F.sum("c").alias("c"))
    sweep = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    per_day = calendar.join(change, "day", "left").withColumn("running", F.sum(F.coalesce("c", F.lit(0))).over(sweep))
    per_day = per_day.withColumn("prefix", F.sum(F.coalesce(ratio(F.lit(1.0), "running"), F.lit(0.0))).over(sweep)).select("day", "prefix")
    low, high = per_day.select(F.date_add("day", 1).alias("day"), F.col("prefix").alias("before")), per_day.select(F.date_sub("day", days - 1).alias("day"), F.col("prefix").alias("after"))
    mean = (F.col("after") - F.coalesce("before", F.lit(0.0))) / days
    each = events.select("day").distinct().join(high, "day").join(low, "day", "left").withColumn("u", mean)
    top = each.agg(F.max("u").alias("top"))
    weights = each.crossJoin(F.broadcast(top)).select("day", (F.col("u") / F.col("top")).alias("weight"))
    return events.join(weights, "day")


def fill_limited(rows: DataFrame, c: str, limit: int = 5) -> DataFrame:
    """Missing values take the last one within limit rows, else the next one within limit rows."""
    w = Window.partitionBy("ticker").orderBy("ts")
    return rows.withColumn("filled", F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)), F.first(c, ignorenulls=True).over(w.rowsBetween(0, limit))))


def cost(kind: str, value: Column, volume: Column | None = None, daily: Column | None = None, volatility: Column | None = None) -> Column:
    """Cost models in currency for a trade of a value: fixed, percent, tiered, slippage, participation, impact."""
    if kind == "fixed":
        return F.lit(5.0)
    if kind == "percent":
        return F.least(F.greatest(value * 0.001, F.lit(1.0)), F.lit(100.0))
    if kind == "tiered":
        return value * F.when(value < 10_000, 0.002).when(value < 100_000, 0.001).otherwise(0.0005)
    if kind == "slippage":
        return value * 5 / 10_000
    if kind == "participation":
        return value * 0.1 * ratio(volume, daily)
    if kind == "impact":
        share = ratio(volume, daily)
        return value * (volatility * (0.314 * share + 0.142 * F.pow(share, F.lit(0.6))))
    raise ValueError(f"unknown cost model: {kind}")


def kelly(wins: Column, losses: Column, gain: Column, loss: Column) -> Column:
    """p - (1 - p) / R, not below 0, of which a quarter is used."""
    p = ratio(wins, wins + losses)
    return F.greatest(p - ratio(1 - p, ratio(gain, loss)), F.lit(0.0)) * 0.25


def circuit_breaker(tested: DataFrame, limit: float = 0.2, recover: float = 0.1) -> DataFrame:
    """Whether trading is on: off once the drawdown exceeds limit, on again when it is within recover.

    The last event decides, so a running last value holds the state.
    """
    dd = S.drawdown("equity")
    event = F.when(F.col("dd") <= -limit, 0).when(F.col("dd") >= -recover, 1)
    held = F.last(F.col("event"), ignorenulls=True).over(S.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return tested.withColumn("dd", dd).withColumn("event", event).withColumn("active", F.coalesce(held, F.lit(1)) == 1).drop("event")


def sector_state(bars: DataFrame) -> DataFrame:
    """Newest bar of each series with its trend class from two moving averages and the return over 63 bars."""
    x = bars.withColumns({"ma50": S.sma("close", 50), "ma200": S.sma("close", 200), "r3": ratio("close", F.lag("close", 62).over(S.ordered())) - 1})
    newest = x.groupBy("ticker").agg(F.max_by(F.struct("close", "ma50", "ma200", "r3"), "ts").alias("n")).select("ticker", "n.*")
    up50, up200, r = F.col("close") > F.col("ma50"), F.col("close") > F.col("ma200"), F.coalesce("r3", F.lit(0.0))
    state = (
        F.when(F.col("ma200").isNull(), "NEUTRAL")
        .when(up50 & up200, F.when(r > 0.05, "STRONG_UP").when(r >= -0.02, "UP").otherwise("NEUTRAL"))
        .when(~up50 & ~up200, F.when(r < -0.05, "STRONG_DOWN").otherwise("DOWN"))
        .otherwise(F.when(r < -0.03, "DOWN").when(r > 0.03, "UP").otherwise("NEUTRAL"))
    )
    return newest.withColumn("state", state)


# Change of the score by the sector's state.
STATE_POINTS = {"STRONG_UP": 10.0, "UP": 5.0, "NEUTRAL": 0.0, "DOWN": -10.0, "STRONG_DOWN": -20.0}
