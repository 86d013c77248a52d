"""Stress tests of books: what each holding and each whole book loses in each scenario, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio
from tallyloom.operators.cleaning import lookup

DEFAULT = "_default_"
TOTAL = "TOTAL"
# Losses of a whole book from which the risk is high or medium.
HIGH, MEDIUM = -0.25, -0.10


def weighted(holdings: DataFrame, value: str = "value") -> DataFrame:
    """holdings (book, ticker, value, ...) with weight, the share of the book's value."""
    total = holdings.groupBy("book").agg(F.sum(value).alias("its_total"))
    return holdings.join(total, "book").withColumn("weight", ratio(value, "its_total")).drop("its_total")


def impact(shocks: dict[str, float]) -> Column:
    """A holding's part in the book's loss: its sector's shock, or the scenario's own, times beta and weight."""
    own = {s: v for s, v in shocks.items() if s != DEFAULT}
    shock = lookup(own, F.coalesce("sector", F.lit("General")), shocks.get(DEFAULT, 0.0))
    return F.round(shock * F.coalesce("beta", F.lit(1.0)) * F.coalesce("weight", F.lit(0.0)), 6)


def stress_table(holdings: DataFrame, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """book, ticker, is_total, weight, beta and a column for each scenario; each book ends in a TOTAL row (weight: all, beta: 0).

    Grouping sets add up holdings and books in one shuffle.
    """
    rows = holdings.select("book", "ticker", "weight", F.coalesce("beta", F.lit(1.0)).alias("beta"), *[impact(s).alias(n) for n, s in scenarios.items()])
    sums = rows.groupingSets([["book", "ticker"], ["book"]], "book", "ticker").agg(F.grouping("ticker").alias("is_total"), F.sum("weight").alias("weight"), F.max("beta").alias("beta"), *[F.round(F.sum(F.col(f"`{n}`")), 6).alias(n) for n in scenarios])
    whole = F.col("is_total") == 1
    return sums.select("book", F.when(whole, TOTAL).otherwise(F.col("ticker")).alias("ticker"), whole.alias("is_total"), "weight", F.when(whole, 0.0).otherwise(F.col("beta")).alias("beta"), *[F.col(f"`{n}`") for n in scenarios])


def summary(table: DataFrame, scenarios: list[str]) -> DataFrame:
    """book, scenario, total_impact (in per cent), worst and best holding, and the level of risk."""
    long = table.select("book", "ticker", "is_total", F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"`{n}`").alias("x")) for n in scenarios])))
    own = lambda c: F.when(~F.col("is_total"), c)
    out = long.groupBy("book", "scenario").agg(
        F.max(F.when(F.col("is_total"), F.col("x"))).alias("total"),
        F.min(own(F.struct("x", "ticker"))).alias("low"),
        F.min(own(F.struct((-F.col("x")).alias("x"), "ticker"))).alias("high"),
    )
    level = F.when(F.col("total") < HIGH, "high").when(F.col("total") < MEDIUM, "medium").otherwise("low")
    return out.select("book", "scenario", F.round(F.col("total") * 100, 1).alias("total_impact"), F.col("low.ticker").alias("worst"), F.col("high.ticker").alias("best"), level.alias("level"))
