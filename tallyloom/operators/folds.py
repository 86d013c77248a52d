"""Indicators whose bands or averages recurse: one fold over each key's ordered bars, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import series as S


def fold(df: DataFrame, columns: list[str], start: Column, step, outputs: list[str]) -> DataFrame:
    """df plus outputs: fields of an accumulator that step(acc, bar) carries along each ticker's bars.

    The accumulator has the outputs and whatever else the step needs.  Time grows with the number of bars.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col("ts").alias("t"), *[F.col(c).cast("double").alias(c) for c in columns])))
    arrays = df.groupBy("ticker").agg(points.alias("p"))
    folded = S.scan("p", start, step, outputs)
    rows = arrays.select("ticker", F.explode(F.arrays_zip(F.transform("p", lambda x: x["t"]).alias("ts"), folded.alias("o"))).alias("z"))
    return df.join(rows.select("ticker", F.col("z.ts").alias("ts"), *[F.col(f"z.o.{o}").alias(o) for o in outputs]), ["ticker", "ts"])


def struct(**fields) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Rises and falls averaged as (n - 1) / n old + 1 / n new, from the plain mean of the first n."""
    nothing = F.lit(None).cast("double")
    start = struct(i=F.lit(-1.0), before=nothing, up=F.lit(0.0), down=F.lit(0.0), rsi=nothing)

    def step(a, x):
        i = a["i"] + 1
        change = F.coalesce(x["close"] - a["before"], F.lit(0.0))
        rise, fall = F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))
        mean = lambda old, new: F.when(i <= n, old + new / n).otherwise((old * (n - 1) + new) / n)
        up, down = mean(a["up"], rise), mean(a["down"], fall)
        rsi = F.when(i < n, nothing).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
        return struct(i=i, before=x["close"], up=up, down=down, rsi=rsi)

    return fold(bars, ["close"], start, step, ["rsi"])


def supertrend(bars: DataFrame, n: int = 10, width: float = 3.0) -> DataFrame:
    """Bands that only tighten while the close stays on their side; direction flips when it crosses."""
    x = bars.withColumn("tr", S.true_range()).withColumn("atr", S.sma("tr", n)).where("atr is not null")
    x = x.withColumns({"top": (F.col("high") + F.col("low")) / 2 + width * F.col("atr"), "bottom": (F.col("high") + F.col("low")) / 2 - width * F.col("atr")})
    nothing = F.lit(None).cast("double")
    start = struct(upper=nothing, lower=nothing, close=nothing, direction=F.lit(1.0))

    def step(a, b):
        upper = F.when(a["upper"].isNull() | (b["top"] < a["upper"]) | (a["close"] > a["upper"]), b["top"]).otherwise(a["upper"])
        lower = F.when(a["lower"].isNull() | (b["bottom"] > a["lower"]) | (a["close"] < a["lower"]), b["bottom"]).otherwise(a["lower"])
        direction = F.when(b["close"] > F.coalesce(a["upper"], upper), 1.0).when(b["close"] < F.coalesce(a["lower"], lower), -1.0).otherwise(a["direction"])
        return struct(upper=upper, lower=lower, close=b["close"], direction=direction)

    return fold(x, ["close", "top", "bottom"], start, step, ["direction"])


def parabolic(bars: DataFrame, first: float = 0.02, most: float = 0.2) -> DataFrame:
    """Stop that speeds up towards the extreme of the move and turns when it is hit."""
    nothing = F.lit(None).cast("double")
    start = struct(stop=nothing, extreme=nothing, pace=F.lit(first), direction=F.lit(1.0))

    def step(a, b):
        fresh = a["stop"].isNull()
        long = a["direction"] > 0
        moved = a["stop"] + a["pace"] * (a["extreme"] - a["stop"])
        hit = F.when(long, b["low"] < moved).otherwise(b["high"] > moved)
        further = F.when(long, b["high"] > a["extreme"]).otherwise(b["low"] < a["extreme"])
        return struct(
            stop=F.when(fresh, b["low"]).when(hit, a["extreme"]).otherwise(moved),
            extreme=F.when(fresh, b["high"]).when(hit, F.when(long, b["low"]).otherwise(b["high"])).when(further, F.when(long, b["high"]).otherwise(b["low"])).otherwise(a["extreme"]),
            pace=F.when(fresh | hit, F.lit(first)).when(further, F.least(a["pace"] + first, F.lit(most))).otherwise(a["pace"]),
            direction=F.when(fresh, 1.0).when(hit, -a["direction"]).otherwise(a["direction"]),
        )

    return fold(bars, ["high", "low"], start, step, ["stop", "direction"])
