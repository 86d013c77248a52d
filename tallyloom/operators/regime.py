"""Market regime from six signals of series, and sensitivity of sectors to rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import clip, ratio

# Weights of the six signals and the cuts between regimes.
WEIGHTS = {"trend": 0.30, "fear": 0.20, "momentum": 0.15, "breadth": 0.10, "curve": 0.10, "credit": 0.15}
BULL, BEAR = 0.62, 0.38


def signals(market: Column, fear: Column, momentum: Column, breadth: Column, curve: Column, credit: Column) -> dict[str, Column]:
    """Each signal from 0 to 1, one half being neutral."""
    return {
        "trend": clip(0.5 + market * 5, 0.0, 1.0),
        "fear": clip(1 - (fear - 15) / 15, 0.0, 1.0),
        "momentum": clip(0.5 + momentum * 6.25, 0.0, 1.0),
        "breadth": F.coalesce(clip(0.5 + breadth * 5, 0.0, 1.0), F.lit(0.5)),
        "curve": F.coalesce(clip(0.5 + curve / 4, 0.0, 1.0), F.lit(0.5)),
        "credit": F.coalesce(clip(0.5 + credit * 10, 0.0, 1.0), F.lit(0.5)),
    }


def regimes(bars: DataFrame) -> DataFrame:
    """A regime for each bar of each series: the market is the series, its volatility stands for fear."""
    x = S.with_changes(bars)
    vs200 = ratio("close", S.sma("close", 200)) - 1
    x = x.withColumns({"vs200": vs200, "fear": S.rolling_std("r", 20) * 20, "r63": ratio("close", F.lag("close", 62).over(S.ordered())) - 1, "vol60": ratio("volume", S.sma("volume", 60)) - 1})
    parts = signals(F.col("vs200"), F.col("fear"), F.col("r63"), F.col("vol60"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    total = sum((parts[n] * w for n, w in WEIGHTS.items()), F.lit(0.0))
    x = x.withColumn("composite", total)
    return x.withColumn("regime", F.when(F.col("composite") >= BULL, "BULL").when(F.col("composite") <= BEAR, "BEAR").when(F.col("composite").isNotNull(), "NEUTRAL"))


def macro_regimes(bars: DataFrame, rates: DataFrame, market: str, equal: str, risky: str, safe: str) -> DataFrame:
    """ts, composite, regime, confidence and the six signals of each of the market's days, from all of its 200-day means on.

    market, equal, risky and safe name series of bars: the market, the same with equal weights, bonds with and without
    credit risk.  rates (ts, long, short) are yields in per cent.  The market's 20-day volatility stands for fear.  Days
    without a bar or a rate take the last ones before.  A series is a row a day, so a single window is small.
    """
    own = lambda name: F.max(F.when(F.col("ticker") == name, F.col("close"))).alias
    days = bars.where(F.col("ticker").isin(market, equal, risky, safe)).groupBy("ts").agg(own(market)("market"), own(equal)("equal"), own(risky)("risky"), own(safe)("safe"))
    x = days.join(rates.select("ts", "long", "short"), "ts", "full").withColumn("ticker", F.lit(market))
    before = S.ordered().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in ("equal", "risky", "safe", "long", "short")}).where("market is not null")
    x = x.withColumns({"close": F.col("market"), "width": ratio("equal", "market"), "spread": ratio("risky", "safe")})
    x = S.with_changes(x)
    known = {
        "vs200": ratio("close", S.sma("close", 200)) - 1,
        "fear": S.rolling_std("r", 20) * 20,
        "r63": ratio("close", F.lag("close", 62).over(S.ordered())) - 1,
        "breadth_delta": ratio("width", S.sma("width", 60)) - 1,
        "curve_spread": F.col("long") - F.col("short"),
        "credit_delta": ratio("spread", S.sma("spread", 20)) - 1,
    }
    x = x.withColumns(known).where("vs200 is not null and fear is not null")
    parts = signals(F.col("vs200"), F.col("fear"), F.col("r63"), F.col("breadth_delta"), F.col("curve_spread"), F.col("credit_delta"))
    x = x.withColumns(parts).withColumn("composite", sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)))
    regime = F.when(F.col("composite") >= BULL, "BULL").when(F.col("composite") <= BEAR, "BEAR").otherwise("NEUTRAL")
    sure = F.when(regime == "BULL", F.least(F.lit(0.85), F.col("composite"))).when(regime == "BEAR", F.least(F.lit(0.85), 1 - F.col("composite"))).otherwise(0.5)
    return x.select("ts", "composite", regime.alias("regime"), sure.alias("confidence"), *parts)
