"""Snapshots by date (snapshot_date, ticker, score_total, rsi_14, close, entry_signal): change and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import known, ratio



def by_ticker():
    return Window.partitionBy("ticker").orderBy("snapshot_date")


def newest_recent(snapshots: DataFrame, as_of: str, days: int) -> DataFrame:
    """The newest row of each ticker among the snapshots of the last days; the date bound prunes partitions."""
    day = F.lit(as_of).cast("date")
    recent = snapshots.where(F.col("snapshot_date").between(F.date_sub(day, days), day))
    newest = Window.partitionBy(F.upper("ticker")).orderBy(F.col("snapshot_date").desc())
    return recent.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k").withColumn("stale_days", F.datediff(day, "snapshot_date"))


def daily_deltas(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    was = yesterday.select("ticker", F.col("score_total").alias("score_was"), F.col("rsi_14").alias("rsi_was"), F.col("close").alias("close_was"))
    return today.join(was, "ticker", "left").withColumns(
        {
            "delta": F.col("score_total") - F.col("score_was"),
            "crossed_up": known((F.col("rsi_14") >= 70) & (F.col("rsi_was") < 70)),
            "crossed_down": known((F.col("rsi_14") <= 30) & (F.col("rsi_was") > 30)),
            "big_move": known(F.abs(ratio("close", "close_was") - 1) >= 0.04),
        }
    )


def snapshot_diff(today: DataFrame, yesterday: DataFrame, least: float = 5.0) -> DataFrame:
    a, b = today.select("ticker", F.col("score_total").alias("now")), yesterday.select("ticker", F.col("score_total").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.abs(F.col("now") - F.col("was")) >= least, "moved").otherwise("same")
    return a.join(b, "ticker", "full_outer").withColumn("status", status)


def top_changes(today: DataFrame, yesterday: DataFrame, n: int) -> DataFrame:
    top = lambda df: df.orderBy(F.col("score_total").desc(), "ticker").limit(n).select("ticker")
    a, b = top(today), top(yesterday)
    return a.join(b, "ticker", "left_anti").select(F.lit("entered").alias("change"), "ticker").unionByName(b.join(a, "ticker", "left_anti").select(F.lit("left").alias("change"), "ticker"))


def staleness_merge(today: DataFrame, earlier: DataFrame) -> DataFrame:
    """Today's rows, then the earlier rows of tickers that are missing today."""
    kept = earlier.join(today.select("ticker"), "ticker", "left_anti")
    return today.withColumn("stale", F.lit(0)).unionByName(kept.withColumn("stale", F.lit(1)), allowMissingColumns=True)


def score_history(snapshots: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("ticker").orderBy(F.col("snapshot_date").desc())
    last = snapshots.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)
    points = F.array_sort(F.collect_list(F.struct("snapshot_date", F.col("score_total").cast("long").alias("s"))))
    h = last.groupBy("ticker").agg(points.alias("p")).where(F.size("p") >= 2)
    change = F.element_at("p", -1)["s"] - F.col("p")[0]["s"]
    return h.select("ticker", F.array_join(F.transform("p", lambda p: p["s"].cast("string")), ",").alias("history"), F.when(change > 5, "UP").when(change < -5, "DOWN").otherwise("FLAT").alias("trend"))


def signal_outcomes(snapshots: DataFrame) -> DataFrame:
    f = ratio(F.lead("close").over(by_ticker()), "close") - 1
    return snapshots.withColumn("f", f).groupBy("entry_signal").agg(F.count("f").alias("n"), F.avg("f").alias("mean"), F.avg((F.col("f") > 0).cast("double")).alias("hit_rate"))


def universe_audit(universe: DataFrame, snapshots: DataFrame, rare: float, regular: float) -> DataFrame:
    days = snapshots.agg(F.count_distinct("snapshot_date").alias("days"))
    seen = snapshots.groupBy("ticker").agg(F.count_distinct("snapshot_date").alias("seen"))
    share = F.coalesce("seen", F.lit(0)) / F.col("days")
    band = F.when(share == 0, "never").when(share < rare, "rare").when(share >= regular, "regular").otherwise("some")
    return universe.join(seen, "ticker", "left").crossJoin(F.broadcast(days)).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def fresh_signals(snapshots: DataFrame, signal: str) -> DataFrame:
    was = F.lag("entry_signal").over(by_ticker())
    return snapshots.withColumn("was", was).where((F.col("entry_signal") == signal) & ~F.col("was").eqNullSafe(F.lit(signal)))


def strikes(events: DataFrame, limit: int = 3) -> DataFrame:
    """Failing days in a row, a success clears them: gaps and islands, one strike a day."""
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max((F.col("value") > 150).cast("int")).alias("ok"))
    running = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("island", F.sum("ok").over(running))
    within = Window.partitionBy("user_id", "island").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    counted = days.withColumn("strikes", F.sum(1 - F.col("ok")).over(within))
    return counted.groupBy("user_id").agg(F.max("strikes").cast("long").alias("worst"), F.bool_or(F.col("strikes") >= limit).alias("blacklisted"))


def top_n_backtest(snapshots: DataFrame, n: int) -> DataFrame:
    """Mean return of each date's best n from their price to the next one known."""
    best = Window.partitionBy("snapshot_date").orderBy(F.col("score_total").desc(), "ticker")
    held = snapshots.withColumn("later", F.lead("close").over(by_ticker())).withColumn("k", F.row_number().over(best)).where(F.col("k") <= n)
    return held.groupBy("snapshot_date").agg(F.count("later").alias("n"), F.avg(ratio("later", "close") - 1).alias("mean_return"))
