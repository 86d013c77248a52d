"""Time-series columns over ordered windows, one partition for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import col, ratio

KEY, TS = "ticker", "ts"


def ordered(key: str = KEY, ts: str = TS):
    return Window.partitionBy(key).orderBy(ts)


def last_n(n: int, key: str = KEY, ts: str = TS):
    return ordered(key, ts).rowsBetween(1 - n, 0)


def full(agg: Column, c, n: int) -> Column:
    """A rolling aggregate once n values are in the window, null before."""
    return F.when(F.count(col(c)).over(last_n(n)) == n, agg.over(last_n(n)))


def returns(c="close", n: int = 1) -> Column:
    return ratio(c, F.lag(col(c), n).over(ordered())) - 1


def log_returns(c="close", n: int = 1) -> Column:
    return F.ln(ratio(c, F.lag(col(c), n).over(ordered())))


def sma(c, n: int) -> Column:
    return full(F.avg(col(c)), c, n)


def rolling_std(c, n: int) -> Column:
    return full(F.stddev_samp(col(c)), c, n)


def with_changes(df: DataFrame, c: str = "close") -> DataFrame:
    return df.withColumn("change", F.col(c) - F.lag(c).over(ordered())).withColumn("r", returns(c))


def rsi_simple(n: int = 14) -> Column:
    """From simple means of the rises and falls of column change: 100 without falls, 50 without either."""
    gain, loss = full(F.avg(F.greatest("change", F.lit(0.0))), "change", n), full(F.avg(F.greatest(-F.col("change"), F.lit(0.0))), "change", n)
    return F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


CHUNK = 128  # bars of a series that a fold takes at a time


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(points, start: Column, step, outputs: list[str]) -> Column:
    """An array of structs of the outputs: fields of the accumulator that step(acc, point) carries along the array points.

    The array is taken in chunks: a chunk's trail grows inside it alone and joins the others as one piece, so time grows
    in proportion to the length (a trail that grew over the whole series would be copied for each of its points).
    """
    points = col(points)
    trail = f"array<struct<{','.join(f'{o}:double' for o in outputs)}>>"
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(points) / CHUNK).cast("int") - 1), lambda k: F.slice(points, k * CHUNK + 1, F.lit(CHUNK)))
    chunks = F.when(F.size(points) > 0, chunks)

    def advance(acc, x):
        return let(step(acc["now"], x), lambda now: F.struct(now.alias("now"), F.concat(acc["trail"], F.array(F.struct(*[now[o].alias(o) for o in outputs]))).alias("trail")))

    def over_chunk(acc, chunk):
        empty = F.struct(acc["now"].alias("now"), F.array().cast(trail).alias("trail"))
        return let(F.aggregate(chunk, empty, advance), lambda done: F.struct(done["now"].alias("now"), F.concat(acc["trails"], F.array(done["trail"])).alias("trails")))

    first = F.struct(start.alias("now"), F.array().cast(f"array<{trail}>").alias("trails"))
    return F.flatten(F.aggregate(chunks, first, over_chunk, lambda acc: acc["trails"]))


def ewm(df: DataFrame, c: str, alphas: dict[str, float], key: str = KEY, ts: str = TS) -> DataFrame:
    """df plus exponentially weighted means y = (1 - a) y' + a x, the first x as the start.

    One fold over each key's values in order of ts, in time that grows with their number; a key's values are one array.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(c).cast("double").alias("x"))))
    arrays = df.groupBy(key).agg(points.alias("p"))
    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit(True).alias("first"), *[nothing.alias(n) for n in alphas])

    def step(a, p):
        return F.struct(F.lit(False).alias("first"), *[F.when(a["first"], p["x"]).otherwise(a[n] * (1 - v) + p["x"] * v).alias(n) for n, v in alphas.items()])

    folded = scan("p", start, step, list(alphas))
    rows = arrays.select(key, F.explode(F.arrays_zip(F.transform("p", lambda p: p["t"]).alias("ts"), folded.alias("o"))).alias("z"))
    return df.join(rows.select(key, F.col("z.ts").alias(ts), *[F.col(f"z.o.{n}").alias(n) for n in alphas]), [key, ts])


def drawdown(equity) -> Column:
    """Share lost since the highest value so far."""
    top = F.max(col(equity)).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return ratio(equity, top) - 1


def rolling_rank(c, n: int) -> Column:
    """Average percentile rank of the newest of the last n values among them."""
    values = F.collect_list(col(c)).over(last_n(n))
    below = F.size(F.filter(values, lambda x: x < col(c)))
    equal = F.size(F.filter(values, lambda x: x == col(c)))
    return F.when(F.count(col(c)).over(last_n(n)) == n, (below + (equal + 1) / 2) / n)


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left plus the newest value of right at or before its ts: a union and a running last value, no range join."""
    both = left.select(key, ts, F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(key, ts, F.lit(0).alias("side"), value))
    w = Window.partitionBy(key).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")


def asof_forward(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left plus the first value of right at or after its ts."""
    both = left.select(key, ts, F.lit(0).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(key, ts, F.lit(1).alias("side"), value))
    w = Window.partitionBy(key).orderBy(ts, "side").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(value, F.first(value, ignorenulls=True).over(w)).where("side = 0").drop("side")
