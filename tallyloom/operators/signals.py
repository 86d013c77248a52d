"""Alerts that fire once, bounded signals of single names, and position sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.series import last_n
from tallyloom.functions.stats import clip, col, known, ratio


def alert_met(price="close") -> Column:
    """Whether a row of a tick and an alert (condition, target) fires; unknown values never do."""
    near = lambda c: (F.col(c) > -0.01) & (F.col(c) < 0.01)
    met = (
        F.when(F.col("condition") == "above", col(price) >= F.col("target"))
        .when(F.col("condition") == "below", col(price) <= F.col("target"))
        .when(F.col("condition") == "crosses_ma50", near("price_vs_ma50"))
        .when(F.col("condition") == "crosses_ma200", near("price_vs_ma200"))
        .when(F.col("condition") == "rsi_above_70", F.col("rsi_14") > 70)
        .when(F.col("condition") == "rsi_below_30", F.col("rsi_14") < 30)
        .when(F.col("condition") == "change_pct", F.abs("change_pct") >= F.col("target"))
        .when(F.col("condition") == "volume_spike", ratio("volume", "avg_volume") >= F.col("target"))
    )
    return known(met & col(price).isNotNull())


def one_shot(alerts: DataFrame, ticks: DataFrame, ts: str, price: str = "close") -> DataFrame:
    """alert_id, triggered_at and triggered_price of each alert that fires, at the first tick where it does."""
    fired = alerts.join(ticks, "ticker").where(alert_met(price))
    return fired.groupBy("alert_id").agg(F.min(ts).alias("triggered_at"), F.min_by(price, ts).alias("triggered_price"))


def insider_signal(trades: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """ticker, insider: 0.5 plus 0.35 times the net share of bought among traded shares of the last days; planned sales don't count."""
    said = F.lower("text")
    bought = said.rlike("buy|purchase|acquired")
    sold = said.rlike("sale|sell|sold|disposed") & ~said.rlike("automatic|plan|10b5")
    shares, late = F.abs("shares"), F.col("day") >= F.date_sub(as_of, days)
    sums = trades.groupBy("ticker").agg(F.sum(F.when(bought & late, shares)).alias("b"), F.sum(F.when(sold & late, shares)).alias("s"))
    b, s = F.coalesce("b", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return sums.select("ticker", F.coalesce(clip(0.5 + 0.35 * ratio(b - s, b + s), 0.1, 0.9), F.lit(0.5)).alias("insider"))


def short_interest_signal(percent) -> Column:
    """Little short interest (below 3 %) is good, much of it (over 15 %) bad; 0.5 if unknown."""
    x = col(percent)
    signal = F.when(x < 3, 0.5 + (3 - x) / 3 * 0.4).when(x > 15, 0.5 - (x - 15) / 15 * 0.4).when(x.isNotNull(), 0.5 - (x - 3) / 12 * 0.2)
    return F.coalesce(clip(signal, 0.1, 0.9), F.lit(0.5))


def kelly_fraction(win_rate, win_loss) -> Column:
    """Half of Kelly's fraction, held to 1 to 25 %; 2 % if the ratio of wins to losses isn't positive."""
    p, r = col(win_rate), col(win_loss)
    return F.when(r <= 0, 0.02).otherwise(clip((p - ratio(1 - p, r)) * 0.5, 0.01, 0.25))


def shares_for(fraction, price, capital: float) -> Column:
    """Whole shares that a fraction of the capital buys, one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.floor(ratio(col(fraction) * capital, price)), F.lit(0))).cast("long")


def shares_by_risk(price, volatility, capital: float, risk: float = 0.01) -> Column:
    """Whole shares whose risk (price times volatility, else 2 % of the price) uses up the risk budget."""
    each = F.coalesce(col(price) * F.nullif(col(volatility), F.lit(0.0)), col(price) * 0.02)
    return F.greatest(F.lit(1), F.coalesce(F.floor(ratio(F.lit(capital * risk), each)), F.lit(0))).cast("long")


def rank_in_window(c, n: int = 252, least: int = 20) -> Column:
    """Average percentile rank of a value among the known ones of the last n rows; null if it or too many are unknown."""
    values = F.collect_list(col(c)).over(last_n(n))  # nulls are left out
    below = F.size(F.filter(values, lambda x: x < col(c)))
    equal = F.size(F.filter(values, lambda x: x == col(c)))
    return F.when(col(c).isNotNull() & (F.size(values) >= least), (below + (equal + 1) / 2) / F.size(values))


def factor_composite(df: DataFrame, weights: dict[str, float], n: int = 252, least: int = 20) -> DataFrame:
    """df plus score, the weighted mean of ranks in windows, and signal: 1 over the window's 60th percentile, -1 below one less it."""
    ranked = df.withColumns({f"rank_{c}": rank_in_window(c, n, least) for c in weights})
    total = sum(F.lit(w / sum(weights.values())) * F.coalesce(f"rank_{c}", F.lit(0.5)) for c, w in weights.items())
    scored = ranked.withColumn("score", F.round(total, 9)).drop(*[f"rank_{c}" for c in weights])
    high = F.when(F.count("score").over(last_n(n)) >= least, F.round(F.percentile("score", F.lit(0.6)).over(last_n(n)), 9))
    low = F.round(1 - F.coalesce("high", F.lit(0.4)), 9)
    signal = F.when(F.col("score") < low, -1).when(F.col("score") > F.col("high"), 1).otherwise(0)
    return scored.withColumn("high", high).withColumn("signal", signal.cast("long")).drop("high")
