"""Paper trades over daily bars, and recommendations for what is held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import clip, ratio
from tallyloom.operators.folds import struct

# Stop, take-profit, partial sale, trailing stop and top-up as shares of the price, and what an order costs.
STOP, TAKE, PARTIAL, SOLD_PART = 0.10, 0.25, 0.12, 0.5
TRAIL_FROM, TRAIL, TOP_UP_AT, TOP_UP, MOST_TOP_UPS = 0.08, 0.08, 0.08, 1.5, 2
COST, WEEKS = 0.0015, 8


def paper_trades(bars: DataFrame, entry: str, capital: float) -> DataFrame:
    """A trade for each bar (ticker, day, close, atr) whose column entry is true, followed over the bars after it.

    On each bar, the first that holds: hard stop, dynamic stop (two atr below the price, at most 20 % below the cost;
    12 % without an atr; the hard stop always comes before it), take-profit (unless half is sold), sale of half, trailing stop, top-up.  After eight weeks it
    closes at the next bar.  A trade sees the twelve weeks after its entry, so its array of bars is bounded; a trade
    that has not closed by then is OPEN.  Prices and shares are not rounded.
    """
    day = F.datediff("day", F.lit("1970-01-01"))
    window = Window.partitionBy("ticker").orderBy("n").rangeBetween(1, 84)
    after = F.collect_list(F.struct("n", F.col("close").alias("p"), F.coalesce("atr", F.lit(0.0)).alias("atr"))).over(window)
    trades = bars.withColumn("n", day).withColumn("after", after).where(entry)
    cost = F.col("close") * (1 + COST)
    none, no = F.lit(None).cast("double"), F.lit(False)
    start = struct(
        cost=cost, shares=capital / cost, first=capital / cost, stop=cost * (1 - STOP), take=cost * (1 + TAKE), partial=cost * (1 + PARTIAL), high=cost, trail=none,
        top_ups=F.lit(0), halved=no, banked=F.lit(0.0), reason=F.lit(None).cast("string"), sold=none, ended=F.lit(None).cast("int"),
    )

    def step(a: Column, x: Column) -> Column:
        p, gain = x["p"], x["p"] / a["cost"] - 1
        dynamic = F.when(x["atr"] > 0, F.greatest(p - 2 * x["atr"], a["cost"] * 0.8)).otherwise(a["cost"] * 0.88)
        rising = (gain >= TRAIL_FROM) & (p > a["high"])
        trail = F.when(rising, p * (1 - TRAIL)).otherwise(a["trail"])
        kind = (
            F.when(p <= a["stop"], "stop")
            .when(p <= dynamic, "dynamic stop")
            .when(~a["halved"] & (p >= a["take"]), "take profit")
            .when(~a["halved"] & (p >= a["partial"]), "half")
            .when((gain >= TRAIL_FROM) & trail.isNotNull() & (p <= trail), "trailing stop")
            .when((gain <= -TOP_UP_AT) & (a["top_ups"] < MOST_TOP_UPS), "top up")
            .otherwise("")
        )
        more = capital * TOP_UP / p
        aged = x["n"] - F.col("n") >= 7 * WEEKS

        def now(b: Column) -> Column:
            k = b["kind"]
            half, top = k == "half", k == "top up"
            shares = F.when(half, a["shares"] * (1 - SOLD_PART)).when(top, a["shares"] + more).otherwise(a["shares"])
            new_cost = F.when(top, (a["cost"] * a["first"] + p * more) / (a["shares"] + more)).otherwise(a["cost"])
            moved = ~k.isin("stop", "dynamic stop", "take profit", "half")
            out = F.when(~k.isin("half", "top up", ""), k).when(aged, "time")
            return struct(
                cost=new_cost, shares=shares, first=a["first"], stop=F.when(half | top, new_cost * (1 - STOP)).otherwise(a["stop"]), take=a["take"], partial=a["partial"],
                high=F.when(moved & rising, p).otherwise(a["high"]), trail=F.when(moved, trail).otherwise(a["trail"]), top_ups=a["top_ups"] + F.when(top, 1).otherwise(0),
                halved=a["halved"] | half, banked=a["banked"] + F.when(half, (p - a["cost"]) * a["shares"] * SOLD_PART).otherwise(0.0),
                reason=out, sold=F.when(out.isNotNull(), p * (1 - COST)), ended=F.when(out.isNotNull(), x["n"]),
            )

        return F.when(a["reason"].isNotNull(), a).otherwise(F.element_at(F.transform(F.array(struct(kind=kind)), now), 1))

    t = trades.withColumn("t", F.aggregate("after", start, step))
    price = F.col("t.sold") / (1 - COST)
    return t.select(
        "ticker", F.col("day").alias("bought"), F.coalesce("t.reason", F.lit("OPEN")).alias("reason"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("t.ended")).alias("sold_on"),
        F.col("t.sold").alias("sold_at"), F.col("t.top_ups").alias("top_ups"), F.col("t.halved").alias("halved"), ((price - F.col("t.cost")) * F.col("t.shares") + F.col("t.banked")).alias("pnl"),
    )


def shrunk_kelly(n_positions, win_rate: float = 0.55, win_loss: float = 1.5, n_trades: int = 0) -> Column:
    """Half of Kelly's fraction (2 to 10 %) drawn towards equal weights (2 to 25 %): the fewer trades, the more."""
    half = clip(F.lit((win_rate - (1 - win_rate) / win_loss) * 0.5), 0.02, 0.10)
    phi = 0.7 if n_trades < 20 else 0.5 if n_trades < 50 else 0.3 if n_trades < 100 else 0.2
    return (1 - phi) * half + phi * clip(ratio(F.lit(1.0), n_positions), 0.02, 0.25)


def recommendations(held: DataFrame, scored: DataFrame) -> DataFrame:
    """held (ticker, shares, avg_cost) with what the scores (ticker, score, rank, current_price, rsi_14, return_3m, atr) advise.

    The best fifth is bought unless overbought, the best half is held unless it falls, the rest is watched or reduced;
    UNKNOWN without a score.  Buys have a stop of 2.5 atr.  All positions have one weight.
    """
    size = scored.agg(F.count("*").alias("n_scored"))  # one row
    x = held.join(scored, "ticker", "left").crossJoin(F.broadcast(size))
    x = x.withColumn("percentile", 100 * (1 - ratio(F.coalesce("rank", "n_scored") - 1, "n_scored")))
    fell = lambda most: F.coalesce(F.col("return_3m") < most, F.lit(False))
    advice = (
        F.when(F.col("score").isNull(), "UNKNOWN")
        .when(F.col("percentile") >= 80, F.when(F.col("rsi_14") > 75, "HOLD").otherwise("BUY"))
        .when(F.col("percentile") >= 50, F.when(fell(-0.15), "WATCH").otherwise("HOLD"))
        .when(fell(-0.10) | (F.col("percentile") < 25), "REDUCE")
        .otherwise("WATCH")
    )
    x = x.withColumn("advice", advice).withColumn("market_value", F.col("shares") * F.col("current_price"))
    book = x.agg(F.sum("market_value").alias("book_value"), F.count("*").alias("n_positions"))  # one row
    paid, weight = F.col("shares") * F.col("avg_cost"), shrunk_kelly("n_positions")
    stop = F.when(F.col("advice") == "BUY", F.col("current_price") - 2.5 * F.col("atr"))
    return x.crossJoin(F.broadcast(book)).select(
        "ticker", "advice", "market_value", (F.col("market_value") - paid).alias("pnl"), ratio(F.col("market_value") - paid, paid).alias("pnl_share"), stop.alias("stop"), weight.alias("weight"), (weight * F.col("book_value")).alias("amount")
    )
