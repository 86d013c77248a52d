"""Option chains (ticker, contract, kind, strike, days, open_interest, volume, last_price, iv, spot)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.series import let
from tallyloom.functions.stats import normal_cdf, ratio


def greeks(chain: DataFrame, rate: float = 0.03) -> DataFrame:
    t = F.col("days") / 365.0
    d1 = (F.ln(F.col("spot") / F.col("strike")) + (rate + F.col("iv") ** 2 / 2) * t) / (F.col("iv") * F.sqrt(t))
    out = chain.withColumn("d1", d1).withColumn("d2", F.col("d1") - F.col("iv") * F.sqrt(t))
    density = F.exp(-F.col("d1") ** 2 / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    call = F.col("kind") == "call"
    return out.withColumns(
        {
            "delta": F.when(call, normal_cdf("d1")).otherwise(normal_cdf("d1") - 1),
            "gamma": density / (F.col("spot") * F.col("iv") * F.sqrt(t)),
            "vega": F.col("spot") * density * F.sqrt(t) / 100,
            "value": F.when(call, F.col("spot") * normal_cdf("d1") - F.col("strike") * F.exp(-rate * t) * normal_cdf("d2")).otherwise(F.col("strike") * F.exp(-rate * t) * normal_cdf(-F.col("d2")) - F.col("spot") * normal_cdf(-F.col("d1"))),
        }
    )


LOW_VOL, HIGH_VOL, HALVINGS = 0.001, 5.0, 60


def model_value(sigma: Column, kind, spot, strike, years, rate: float) -> Column:
    """What the model gives for an option at a volatility."""
    root = sigma * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + sigma * sigma / 2) * years) / root
    call = spot * normal_cdf(d1) - strike * F.exp(-rate * years) * normal_cdf(d1 - root)
    return F.when(kind == "call", call).otherwise(call - spot + strike * F.exp(-rate * years))


def implied_volatility(chain: DataFrame, price: str = "last_price", rate: float = 0.03) -> DataFrame:
    """chain with implied, the volatility at which the model gives the price; null where none between the bounds does.

    The model's value rises with the volatility, so the interval is halved, always on the side of the price; a row's
    halvings are one fold in the JVM.
    """
    years = F.when(F.col("days") > 0, F.col("days") / 365.0)
    row = F.struct(F.col("kind"), *[F.col(c).cast("double").alias(c) for c in ("spot", "strike")], years.alias("years"), F.col(price).cast("double").alias("price"))
    value = lambda sigma, x: model_value(sigma, x["kind"], x["spot"], x["strike"], x["years"], rate)

    def halve(acc, _):
        middle = (acc["low"] + acc["high"]) / 2
        return let(F.struct(middle.alias("middle"), (value(middle, F.col("its_row")) < F.col("its_row.price")).alias("more")), lambda m: F.struct(F.when(m["more"], m["middle"]).otherwise(acc["low"]).alias("low"), F.when(m["more"], acc["high"]).otherwise(m["middle"]).alias("high")))

    x = chain.withColumn("its_row", row)
    start = F.struct(F.lit(LOW_VOL).alias("low"), F.lit(HIGH_VOL).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc["low"] + acc["high"]) / 2)
    inside = (F.col("days") > 0) & (F.col(price) > 0) & (value(F.lit(LOW_VOL), F.col("its_row")) <= F.col(price)) & (value(F.lit(HIGH_VOL), F.col("its_row")) >= F.col(price))
    return x.withColumn("implied", F.when(inside, found)).drop("its_row")


def pain_at_spot(chain: DataFrame) -> DataFrame:
    """The variant that weighs each strike by its distance from the spot."""
    pain = F.abs(F.col("strike") - F.col("spot")) * F.col("open_interest")
    by_strike = chain.groupBy("ticker", "strike").agg(F.sum(pain).alias("pain"))
    return by_strike.groupBy("ticker").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"))


def max_pain(chain: DataFrame) -> DataFrame:
    """The settlement strike at which holders are paid least; strikes of a ticker are few, pairs of them are summed."""
    by_strike = chain.groupBy("ticker", "strike").agg(F.sum(F.when(F.col("kind") == "call", F.col("open_interest")).otherwise(0)).alias("calls"), F.sum(F.when(F.col("kind") == "put", F.col("open_interest")).otherwise(0)).alias("puts"))
    other = by_strike.select("ticker", F.col("strike").alias("k"), "calls", "puts")
    paid = F.when(F.col("strike") > F.col("k"), (F.col("strike") - F.col("k")) * F.col("calls")).otherwise((F.col("k") - F.col("strike")) * F.col("puts"))
    total = by_strike.select("ticker", "strike").join(other, "ticker").groupBy("ticker", "strike").agg(F.sum(paid).alias("pain"))
    return total.groupBy("ticker").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("pain"))


def expected_move(chain: DataFrame) -> DataFrame:
    """Price of the straddle at the strike nearest the spot."""
    near = chain.groupBy("ticker").agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")).alias("strike"))
    return chain.join(near, ["ticker", "strike"]).groupBy("ticker", "strike").agg((F.coalesce(F.avg(F.when(F.col("kind") == "call", F.col("last_price"))), F.lit(0.0)) + F.coalesce(F.avg(F.when(F.col("kind") == "put", F.col("last_price"))), F.lit(0.0))).alias("move"))


def top_strikes(chain: DataFrame, n: int = 5) -> DataFrame:
    by = chain.groupBy("ticker", "kind", "strike").agg(F.sum("open_interest").alias("open_interest"))
    w = Window.partitionBy("ticker", "kind").orderBy(F.col("open_interest").desc(), "strike")
    return by.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def put_call(chain: DataFrame) -> DataFrame:
    part = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0))
    r = chain.groupBy("ticker").agg(ratio(part("put", "volume"), part("call", "volume")).alias("volume_ratio"), ratio(part("put", "open_interest"), part("call", "open_interest")).alias("interest_ratio"))
    return r.withColumn("mood", F.when(F.col("volume_ratio") < 0.7, "bullish").when(F.col("volume_ratio") > 1.3, "bearish").otherwise("neutral"))


def unusual(chain: DataFrame, limit: float = 2.0) -> DataFrame:
    """Contracts whose volume lies over limit deviations above their ticker and kind."""
    w = Window.partitionBy("ticker", "kind")
    z = ratio(F.col("volume") - F.avg("volume").over(w), F.stddev_samp("volume").over(w))
    return chain.withColumn("z", z).where(F.col("z") > limit)


def smile(chain: DataFrame) -> DataFrame:
    return chain.groupBy("ticker", "strike").pivot("kind", ["call", "put"]).agg(F.avg("iv"))


def term_structure(chain: DataFrame) -> DataFrame:
    return chain.groupBy("ticker", "days").agg(F.avg("iv").alias("iv"), F.count("*").alias("n"))


def covered_calls(chain: DataFrame, n: int = 5) -> DataFrame:
    """Calls over 2 % out of the money, the first n of each ticker by annualised yield."""
    calls = chain.where("kind = 'call' and strike > spot * 1.02").withColumn("annual", ratio("last_price", "spot") * 365 / F.col("days"))
    w = Window.partitionBy("ticker").orderBy(F.col("annual").desc(), "contract")
    return calls.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).withColumn("breakeven", F.col("spot") - F.col("last_price"))
