"""Transaction ledgers (ticker, day, seq, kind, shares, price): first-in-first-out lots as running intervals.

A buy covers the interval of shares from the running total before it to the one after it; so does a sale.  A lot's
open shares are its interval beyond all shares sold; a sale's cost is the overlap of its interval with those of the
buys.  Both are exact while a ticker is never oversold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio


def intervals(ledger: DataFrame, kind: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("day", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.where(F.col("kind") == kind).withColumn("until", F.sum("shares").over(w))
    return rows.withColumn("start", F.col("until") - F.col("shares"))


def holdings(ledger: DataFrame) -> DataFrame:
    """Open shares, their cost and the first open buy of each ticker."""
    sold = ledger.where("kind = 'SELL'").groupBy("ticker").agg(F.sum("shares").alias("sold"))
    lots = intervals(ledger, "BUY").join(sold, "ticker", "left").withColumn("open", F.greatest(F.lit(0.0), F.least("shares", F.col("until") - F.coalesce("sold", F.lit(0.0)))))
    left = F.col("open") > 0
    return lots.groupBy("ticker").agg(F.sum("open").alias("shares"), ratio(F.sum(F.col("open") * F.col("price")), F.sum("open")).alias("avg_cost"), F.min(F.when(left, F.col("day"))).alias("first_buy")).where("shares > 0")


def realised(ledger: DataFrame) -> DataFrame:
    """Proceeds less first-in-first-out cost of each ticker's sales: an overlap join within the ticker."""
    buys = intervals(ledger, "BUY").select("ticker", F.col("start").alias("b0"), F.col("until").alias("b1"), F.col("price").alias("cost"))
    sells = intervals(ledger, "SELL").select("ticker", "seq", "price", F.col("start").alias("s0"), F.col("until").alias("s1"))
    both = sells.join(buys, (sells["ticker"] == buys["ticker"]) & (F.col("s0") < F.col("b1")) & (F.col("b0") < F.col("s1"))).drop(buys["ticker"])
    overlap = F.least("s1", "b1") - F.greatest("s0", "b0")
    return both.groupBy("ticker").agg(F.count_distinct("seq").alias("sales"), F.sum(overlap * (F.col("price") - F.col("cost"))).alias("pnl"))


def fee(kind: str = "kind", value: str = "value"):
    """A quarter of a percent for buys, 0.55 % for sales, at least 1."""
    return F.greatest(F.lit(1.0), F.col(value) * F.when(F.col(kind) == "BUY", 0.0025).otherwise(0.0055))
