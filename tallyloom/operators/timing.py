"""Factor timing: what factors have earned lately decides how much each of them counts next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import clip, rank_metrics, ratio

LOOKBACK, FIFTH = 6, 20.0


def factor_ranks(panel: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """month, ticker, actual and each factor's percentile rank in its month, all ranked in one shuffle."""
    ranks = rank_metrics(panel, ["month", "ticker", "actual"], ["month"], {n: (c, True, None) for n, c in factors.items()})
    return ranks


def factor_returns(ranks: DataFrame, factors: list[str]) -> DataFrame:
    """month, factor, earned: mean outcome of the best fifth by rank less that of the worst."""
    long = ranks.select("month", "actual", F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("rank")) for n in factors])))
    top, bottom = F.col("rank") > 100 - FIFTH, F.col("rank") <= FIFTH
    return long.groupBy("month", "factor").agg((F.avg(F.when(top, F.col("actual"))) - F.avg(F.when(bottom, F.col("actual")))).alias("earned"))


def weights(returns: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """month, factor, lately, weight: shares of the mean returns of the lookback months before; losers get nothing.

    Only months before count.  Without a winner, as in the first month, all factors weigh the same.
    """
    before = Window.partitionBy("factor").orderBy("month").rowsBetween(-lookback, -1)  # a row a month
    month = Window.partitionBy("month")
    x = returns.withColumn("lately", F.avg("earned").over(before))
    won = F.greatest(F.coalesce("lately", F.lit(0.0)), F.lit(0.0))
    x = x.withColumn("won", F.round(won, 12)).withColumn("all_won", F.sum("won").over(month))
    return x.select("month", "factor", "lately", F.when(F.col("all_won") > 0, ratio("won", "all_won")).otherwise(1 / F.count("*").over(month)).alias("weight"))


def timed_signals(ranks: DataFrame, weighted: DataFrame, factors: list[str]) -> DataFrame:
    """month, ticker, signal: ranks (0 to 1, one half without one) by the month's weights."""
    wide = weighted.groupBy("month").agg(*[F.max(F.when(F.col("factor") == n, F.col("weight"))).alias(f"weight_{n}") for n in factors])
    total = sum((F.coalesce(F.col(n) / 100, F.lit(0.5)) * F.col(f"weight_{n}") for n in factors), F.lit(0.0))
    return ranks.join(wide, "month").select("month", "ticker", clip(total, -1.0, 1.0).alias("signal"))
