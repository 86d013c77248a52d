"""Signals out of text, metric summaries and merges of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio

# The sentiment lexicon.
POSITIVE = ["gain", "rise", "surge", "strong", "beat", "growth", "profit", "record", "buyback", "upgrade", "positive", "bullish", "ökar", "stiger", "rekord", "tillväxt", "vinst"]
NEGATIVE = ["fall", "drop", "loss", "miss", "weak", "sell", "downgrade", "negative", "bearish", "cut", "decline", "risk", "faller", "minskar", "förlust", "svag", "sälj"]
#: Words in capitals that aren't tickers.
STOP = ["THE", "AND", "FOR", "CEO", "CFO", "IPO", "USA", "ETF", "GDP", "MIT", "GNU"]


def words(*ws: str) -> Column:
    return F.array(*[F.lit(w) for w in ws])


def sentiment(c: str) -> Column:
    """(positive - negative) / (positive + negative) over the distinct words of a text; 0 without any or under five characters."""
    words_of = F.array_distinct(F.split(F.lower(c), r"[ \t\n\x0b\f\r]+"))
    found = F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) >= 5, words_of).otherwise(F.array().cast("array<string>"))
    p, n = F.size(F.array_intersect(found, words(*POSITIVE))), F.size(F.array_intersect(found, words(*NEGATIVE)))
    return F.coalesce(ratio(p - n, p + n), F.lit(0.0))


def tickers(c: str) -> Column:
    """Words of two to five capitals, each once, without the stop words."""
    found = F.regexp_extract_all(c, F.lit(r"[^ \n.,!?;:()$#]+"), F.lit(0))
    return F.array_distinct(F.array_except(F.filter(found, lambda w: w.rlike("^[A-Z]{2,5}$")), words(*STOP)))


def metric_summary(events: DataFrame) -> DataFrame:
    """Count, bounds, mean, order statistics by position and the newest value by type.

    Positions are found by a row number in the type, so no type's values are gathered in one array.
    """
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("event_type"))
    placed = events.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("value"))).withColumn("n_rows", n)
    at = lambda place: F.max(F.when(F.col("k") == place, F.col("value")))
    return placed.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        at(F.floor(F.col("n_rows") / 2) + 1).alias("p50"),
        at(F.floor(F.col("n_rows") * 0.95) + 1).alias("p95"),
        F.max_by("value", F.struct("ts", "event_id")).alias("last"),
    )


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Best confidence of each ticker, raised for each further source, at most 1."""
    best = candidates.groupBy("ticker").agg(F.max("confidence").alias("best"), F.count_distinct("source").alias("sources"))
    more = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("sources").cast("int"), F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.least(F.lit(0.05) * (i - 1), F.lit(0.20)))
    return best.withColumn("confidence", F.least(F.lit(1.0), F.col("best") + more))
