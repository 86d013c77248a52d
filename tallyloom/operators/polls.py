"""Polled news, queues of failed tickers, and gaps that older rows fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polled_once(news: DataFrame, minutes: int = 30, most: int = 2) -> DataFrame:
    """Items (ticker, headline, ts, id) that polls report: the newest few of a ticker in a poll, each headline once a day.

    A headline that a poll passed over may be reported by a later one of the day.
    """
    x = news.withColumn("poll", F.window("ts", f"{minutes} minutes").start).withColumn("day", F.to_date("ts"))
    newest = Window.partitionBy("ticker", "poll").orderBy(F.col("ts").desc(), F.col("id").desc())
    x = x.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    once = x.groupBy("ticker", "day", "headline").agg(F.min(F.struct("poll", "place", "id")).alias("first"))
    return once.select("ticker", "day", "headline", F.col("first.poll").alias("poll"), F.col("first.id").alias("id"))


def retry_queue(attempts: DataFrame, blacklist: DataFrame, as_of: Column, days: int = 7, most: int = 5) -> DataFrame:
    """Tickers to try again: ticker, passes (failures since the last success), last_try, exhausted.

    attempts: ticker, ts, ok.  Queues older than days and tickers of the blacklist, whatever their case, are left out.
    """
    key = F.upper(F.col("ticker").cast("string"))
    good = attempts.where("ok").groupBy("ticker").agg(F.max("ts").alias("good"))
    failed = attempts.where("not ok").join(good, "ticker", "left").where("good is null or ts > good")
    queue = failed.groupBy("ticker").agg(F.count("*").alias("passes"), F.max("ts").alias("last_try"))
    banned = blacklist.select(key.alias("banned")).distinct()
    left = queue.join(banned, key == F.col("banned"), "left_anti")
    return left.crossJoin(F.broadcast(attempts.agg(as_of.alias("as_of")))).where(F.datediff("as_of", "last_try") <= days).select("ticker", "passes", "last_try", (F.col("passes") >= most).alias("exhausted"))


def gaps_filled(daily: DataFrame, value: str, days: int = 14) -> DataFrame:
    """daily (ticker, day, value) with nulls taken from the ticker's newest older row that has one, some days back at most."""
    back = Window.partitionBy("ticker").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-days, 0)
    return daily.withColumn("filled", F.last(value, ignorenulls=True).over(back))
