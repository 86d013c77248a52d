"""Walk-forward optimisation of strategies and rolling walk-forward portfolios.

A grid of parameters is an array in each bar's row, so bars are read and sorted once whatever the grid: every distinct
window length is one rolling mean, every parameter pair one element, and the grid becomes rows only to be summed.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import average_rank, ratio

YEAR = 252


def cross_returns(bars: DataFrame, pairs: list[tuple[int, int]], by: list[str]) -> DataFrame:
    """bars' by, ts, with fast, slow and x for each pair of window lengths: what a moving-average cross earns on the bar.

    Yesterday's signal earns today's return.  Means, signals and returns start anew in each of by.
    """
    w = Window.partitionBy(*by).orderBy("ts")
    lengths = sorted({n for pair in pairs for n in pair})

    def mean(n: int) -> Column:
        last = w.rowsBetween(1 - n, 0)
        return F.when(F.count("close").over(last) == n, F.avg("close").over(last))

    x = bars.withColumns({f"mean_{n}": mean(n) for n in lengths} | {"r": ratio("close", F.lag("close").over(w)) - 1})
    sides = [F.when(F.col(f"mean_{f}") > F.col(f"mean_{s}"), 1.0).when(F.col(f"mean_{f}") < F.col(f"mean_{s}"), -1.0).otherwise(0.0) for f, s in pairs]
    x = x.withColumn("held", F.lag(F.array(*sides)).over(w))
    cells = [F.struct(F.lit(f).cast("long").alias("fast"), F.lit(s).cast("long").alias("slow"), F.coalesce(F.get("held", F.lit(k)) * F.col("r"), F.lit(0.0)).alias("x")) for k, (f, s) in enumerate(pairs)]
    return x.select(*by, "ts", F.inline(F.array(*cells)))


def sharpe(x: Column) -> Column:
    return ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(float(YEAR)))


def segments(bars: DataFrame, windows: int, share: float) -> DataFrame:
    """bars with segment (from 1) and trains: each ticker's bars are cut into windows of equal numbers, whose first share trains.

    Bars left over at the end belong to none.
    """
    k, n = F.row_number().over(S.ordered()) - 1, F.count("*").over(Window.partitionBy("ticker"))
    x = bars.withColumns({"k": k, "size": F.floor(n / windows)})
    x = x.withColumns({"segment": F.floor(ratio("k", "size")) + 1, "trains": F.pmod("k", F.col("size")) < F.floor(F.col("size") * share)})
    return x.where(F.col("segment") <= windows).drop("k", "size")


def optimised_windows(bars: DataFrame, pairs: list[tuple[int, int]], windows: int = 5, share: float = 0.7, least_train: int = 50, least_test: int = 10) -> DataFrame:
    """A row for each ticker and window: the pair of best Sharpe ratio in sample, and how it fares out of sample.

    Ties go to the shorter lengths; without any ratio the first pair is taken.  Windows with too few bars are left out.
    oos_n, oos_sum and oos_squares are the count and the sums of the returns out of sample and of their squares.
    """
    rows = cross_returns(segments(bars, windows, share), pairs, ["ticker", "segment", "trains"])
    inside, outside = (lambda c: F.when(F.col("trains"), c)), (lambda c: F.when(~F.col("trains"), c))
    x = F.col("x")
    each = rows.groupBy("ticker", "segment", "fast", "slow").agg(
        F.min(inside(F.col("ts"))).alias("train_start"),
        F.max(inside(F.col("ts"))).alias("train_end"),
        F.min(outside(F.col("ts"))).alias("test_start"),
        F.max(outside(F.col("ts"))).alias("test_end"),
        F.count(inside(x)).alias("n_train"),
        F.count(outside(x)).alias("oos_n"),
        sharpe(inside(x)).alias("is_sharpe"),
        sharpe(outside(x)).alias("oos_sharpe"),
        (F.product(outside(1 + x)) - 1).alias("oos_return"),
        F.sum(outside(x)).alias("oos_sum"),
        F.sum(outside(x * x)).alias("oos_squares"),
    )
    best = Window.partitionBy("ticker", "segment").orderBy(F.round("is_sharpe", 9).desc_nulls_last(), "fast", "slow")
    return each.where((F.col("n_train") >= least_train) & (F.col("oos_n") >= least_test)).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def summary(chosen: DataFrame) -> DataFrame:
    """By ticker: means over the windows, the ratio of all returns out of sample as one series, the share of windows that lose there."""
    n, total, squares = F.sum("oos_n"), F.sum("oos_sum"), F.sum("oos_squares")
    spread = F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))
    return chosen.groupBy("ticker").agg(
        F.count("*").alias("n_windows"),
        F.avg("is_sharpe").alias("avg_is_sharpe"),
        F.avg("oos_sharpe").alias("avg_oos_sharpe"),
        F.avg(F.col("is_sharpe") - F.col("oos_sharpe")).alias("avg_drop"),
        F.avg("oos_return").alias("avg_oos_return"),
        (ratio(total / n, spread) * F.sqrt(F.lit(float(YEAR)))).alias("combined_oos_sharpe"),
        (F.count_if(F.col("oos_sharpe") < 0) / F.count("*")).alias("overfit_probability"),
    )


def month_end(year: int, month: int) -> datetime.date:
    """The last day of a month; months beyond December run on into the next years."""
    year, month = year + month // 12, month % 12 + 1
    return datetime.date(year, month, 1) - datetime.timedelta(days=1)


def calendar(last: datetime.date, years: int, months: int = 12) -> list[tuple[int, int, datetime.date]]:
    """(window, period, month end): windows of some months follow each other over the years before last."""
    first = (last.year - years) * 12 + last.month - (last.day == 1)  # the first month that begins in that span
    out, window = [], 1
    while (ends := first + window * months) <= last.year * 12 + last.month - 1:
        out += [(window, k, month_end(0, ends - months + k + 1)) for k in range(months)]
        window += 1
    return out


#: What each part weighs in the momentum score.
WEIGHTS = {"r12": 0.4, "r6": 0.3, "r3": 0.2, "from_high": 0.1}
#: Bars back, dealing costs by venue, and what a year costs for companies that are gone.
BACK = {"r12": 252, "r6": 126, "r3": 63}
HOME, HOME_FEE, AWAY_FEE, SURVIVORSHIP = ".ST", 0.0025, 0.0055, 0.015
LEAST, VOLATILITY_BARS, LEAST_VOLATILITY = 63, 126, 20


def at_dates(bars: DataFrame, dates: list[tuple[int, int, datetime.date]]) -> DataFrame:
    """ticker, window, period and day, with what is known of the ticker before the day, and its first price from then on.

    The dates become rows among each ticker's bars, so one pass over its ordered rows finds both sides of each.
    """
    w = S.ordered()
    r = bars.withColumns({n: ratio("close", F.lag("close", k - 1).over(w)) - 1 for n, k in BACK.items()} | {"r": S.returns(), "k": F.row_number().over(w)})
    lately = w.rowsBetween(1 - VOLATILITY_BARS, 0)
    vol = F.when(F.count("r").over(lately) > LEAST_VOLATILITY, F.stddev_samp("r").over(lately) * F.sqrt(F.lit(float(YEAR))))
    known = F.struct(*BACK, (ratio("close", F.max("close").over(w.rowsBetween(-251, 0))) - 1).alias("from_high"), "k").alias("known")
    points = r.select("ticker", "ts", F.lit(1).alias("side"), known, F.struct("close", vol.alias("vol")).alias("price"))
    marks = F.array(*[F.struct(F.lit(a).alias("window"), F.lit(b).alias("period"), F.lit(d).alias("ts")) for a, b, d in dates])
    days = bars.select("ticker").distinct().select("ticker", F.inline(marks)).withColumn("side", F.lit(0))
    both = points.unionByName(days, allowMissingColumns=True)
    order = Window.partitionBy("ticker").orderBy("ts", "side")
    found = both.withColumn("known", F.last("known", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("price", F.first("price", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return found.where("side = 0").select("ticker", "window", "period", F.col("ts").alias("day"), "known.*", F.col("price.close").alias("entry"), F.col("price.vol").alias("vol"))


def scored(found: DataFrame) -> DataFrame:
    """found with score: weighted percentile ranks of each day's tickers; a part that at most three tickers have counts for none."""
    found = found.where(F.col("k") >= LEAST)
    day = ["window", "period"]
    there = {n: F.count(n).over(Window.partitionBy(*day)) for n in WEIGHTS}
    x = found.withColumns({f"rank_{n}": average_rank(n, day) * 100 / there[n] for n in WEIGHTS} | {f"has_{n}": there[n] > 3 for n in WEIGHTS})
    total, weight = F.lit(50.0), F.lit(0.0)
    for n, v in WEIGHTS.items():
        total = total + F.when(F.col(f"has_{n}"), F.col(f"rank_{n}") * v).otherwise(0.0)
        weight = weight + F.when(F.col(f"has_{n}"), v).otherwise(0.0)
    return x.withColumn("score", F.when(weight > 0, total / weight).otherwise(total)).drop(*[f"rank_{n}" for n in WEIGHTS], *[f"has_{n}" for n in WEIGHTS])


def rolling_portfolio(bars: DataFrame, years: int = 4, top: int = 5, months: int = 12) -> DataFrame:
    """window, period, day, n, port_return, bench_return: the best by score at each month's end, weighted by inverse volatility, net of costs.

    Only bars before the day score.  Prices are those of the first bar from the day on; the benchmark is the mean of all
    tickers.  Tickers without a volatility get no weight, unless none has one: then all get the same.
    """
    last = bars.agg(F.max("ts").alias("last")).first()["last"]
    dates = calendar(last, years, months) if last else []
    if not dates:
        return bars.sparkSession.createDataFrame([], "window int, period int, day date, n long, port_return double, bench_return double")
    found = at_dates(bars, dates)
    following = Window.partitionBy("ticker", "window").orderBy("period")
    found = found.withColumn("gain", ratio(F.lead("entry").over(following), "entry") - 1)
    place = Window.partitionBy("window", "period").orderBy(F.round("score", 9).desc_nulls_last(), "ticker")
    s = scored(found.where(F.col("period") < months - 1)).withColumn("picked", F.row_number().over(place) <= top)
    s = s.withColumn("fee", F.when(F.col("ticker").endswith(HOME), HOME_FEE).otherwise(AWAY_FEE))
    inverse = F.when(F.col("picked"), ratio(F.lit(1.0), "vol"))
    chosen = s.groupBy("window", "period", "day").agg(
        F.count_if(F.col("picked")).alias("n"),
        F.sum(inverse).alias("weights"),
        F.sum(inverse * (F.col("gain") - F.col("fee"))).alias("weighted"),
        F.sum(F.when(F.col("picked"), F.col("gain") - F.col("fee"))).alias("plain"),
        F.avg("gain").alias("bench_return"),
    )
    port = F.when(F.col("weights") > 0, F.coalesce("weighted", F.lit(0.0)) / F.col("weights")).otherwise(F.col("plain") / F.col("n"))
    return chosen.select("window", "period", "day", "n", port.alias("port_return"), "bench_return").where("port_return is not null")


def portfolio_windows(periods: DataFrame) -> DataFrame:
    """By window: compounded returns, the portfolio's less a share of a year's loss for companies that are gone, and whether it beats the benchmark."""
    port = F.product(1 + F.col("port_return")) - 1 - SURVIVORSHIP / 12 * F.count("*")
    out = periods.groupBy("window").agg(F.count("*").alias("n_periods"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), port.alias("port_return"), (F.product(1 + F.col("bench_return")) - 1).alias("bench_return"))
    return out.withColumns({"alpha": F.col("port_return") - F.col("bench_return"), "beats": F.col("port_return") > F.col("bench_return")})
