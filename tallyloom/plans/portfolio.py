"""Queries over ledgers, portfolios and option chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio
from tallyloom.operators import ledger as L
from tallyloom.operators import options as O
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

RUN = "sum(shares) OVER (PARTITION BY ticker ORDER BY day, seq ROWS UNBOUNDED PRECEDING)"
BUYS = f"buys AS (SELECT *, {RUN} AS until, {RUN} - shares AS start FROM ledger WHERE kind = 'BUY')"
SELLS = f"sells AS (SELECT *, {RUN} AS until, {RUN} - shares AS start FROM ledger WHERE kind = 'SELL')"


@query(f"WITH {BUYS}, sold AS (SELECT ticker, sum(shares) AS sold FROM ledger WHERE kind = 'SELL' GROUP BY ticker), o AS (SELECT b.*, greatest(0, least(shares, until - coalesce(sold, 0))) AS open FROM buys b LEFT JOIN sold USING (ticker)) SELECT ticker, sum(open) AS shares, round(sum(open * price) / sum(open), 5) AS avg_cost, min(CASE WHEN open > 0 THEN day END) AS first_buy FROM o GROUP BY ticker HAVING sum(open) > 0", "ledger")
def pf_01_fifo_holdings(t: Tables):
    return L.holdings(t.ledger).select("ticker", "shares", F.round("avg_cost", 5).alias("avg_cost"), "first_buy")


@query(f"WITH {BUYS}, {SELLS} SELECT s.ticker, count(DISTINCT s.seq) AS sales, round(sum((least(s.until, b.until) - greatest(s.start, b.start)) * (s.price - b.price)), 2) AS pnl FROM sells s JOIN buys b ON s.ticker = b.ticker AND s.start < b.until AND b.start < s.until GROUP BY s.ticker", "ledger")
def pf_02_realised_pnl(t: Tables):
    return L.realised(t.ledger).select("ticker", "sales", F.round("pnl", 2).alias("pnl"))


@query("SELECT ticker, seq, round(greatest(1.0, shares * price * CASE WHEN kind = 'BUY' THEN 0.0025 ELSE 0.0055 END), 6) AS fee FROM ledger", "ledger")
def pf_03_fees(t: Tables):
    return t.ledger.withColumn("value", F.col("shares") * F.col("price")).select("ticker", "seq", r6(L.fee(), "fee"))


@query("WITH v AS (SELECT ticker, sum(CASE WHEN kind = 'BUY' THEN shares * price ELSE 0 END) AS value FROM ledger GROUP BY ticker), w AS (SELECT ticker, value / sum(value) OVER () AS w, row_number() OVER (ORDER BY value DESC, ticker) AS k FROM v) SELECT round(max(w), 6) AS max_weight, round(sum(CASE WHEN k <= 3 THEN w END), 6) AS top3, round(sum(w * w), 6) AS herfindahl FROM w", "ledger")
def agg_13_14_concentration(t: Tables):
    v = t.ledger.groupBy("ticker").agg(F.sum(F.when(F.col("kind") == "BUY", F.col("shares") * F.col("price")).otherwise(0)).alias("value"))
    total = v.agg(F.sum("value").alias("total"))
    w = v.crossJoin(F.broadcast(total)).withColumn("w", ratio("value", "total"))
    top = w.orderBy(F.col("value").desc(), "ticker").limit(3).agg(F.sum("w").alias("top3"))
    return w.agg(r6(F.max("w"), "max_weight"), r6(F.sum(F.col("w") * F.col("w")), "herfindahl")).crossJoin(top.select(r6("top3")))


TARGET = "tgt AS (SELECT s_suppkey AS ticker, (1 + s_suppkey % 3) * 1.0 / sum(1 + s_suppkey % 3) OVER () AS target FROM supplier)"


@query(f"WITH v AS (SELECT ticker, sum(shares * price) AS value FROM ledger GROUP BY ticker), c AS (SELECT ticker, value / sum(value) OVER () AS weight FROM v), {TARGET}, d AS (SELECT coalesce(c.ticker, tgt.ticker) AS ticker, coalesce(weight, 0) - coalesce(target, 0) AS drift FROM c FULL JOIN tgt ON c.ticker = tgt.ticker) SELECT ticker, round(drift, 6) AS drift, CASE WHEN drift > 0.005 THEN 'SELL' WHEN drift < -0.005 THEN 'BUY' ELSE 'HOLD' END AS action FROM d", "ledger")
def jn_20_pf_12_drift(t: Tables):
    v = t.ledger.groupBy("ticker").agg(F.sum(F.col("shares") * F.col("price")).alias("value"))
    c = v.crossJoin(F.broadcast(v.agg(F.sum("value").alias("total")))).select("ticker", ratio("value", "total").alias("weight"))
    each = t.supplier.select(F.col("s_suppkey").alias("ticker"), (1 + F.col("s_suppkey") % 3).alias("w"))
    tgt = each.crossJoin(F.broadcast(each.agg(F.sum("w").alias("tw")))).select("ticker", ratio("w", "tw").alias("target"))
    d = c.join(tgt, "ticker", "full_outer").withColumn("drift", F.coalesce("weight", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)))
    return d.select("ticker", r6("drift"), F.when(F.col("drift") > 0.005, "SELL").when(F.col("drift") < -0.005, "BUY").otherwise("HOLD").alias("action"))


# Shocks of four scenarios by sector.
SCENARIOS = {
    "financial crisis": {"_default_": -0.40, "Financial Services": -0.55, "Real Estate": -0.50, "Technology": -0.35, "Consumer Cyclical": -0.45, "Energy": -0.30, "Utilities": -0.20, "Healthcare": -0.20, "Consumer Defensive": -0.15},
    "pandemic": {"_default_": -0.35, "Travel/Hospitality": -0.60, "Energy": -0.50, "Consumer Cyclical": -0.40, "Technology": -0.20, "Healthcare": -0.15, "Utilities": -0.15, "Consumer Defensive": -0.10},
    "rate shock": {"_default_": -0.15, "Real Estate": -0.35, "Utilities": -0.25, "Technology (High Growth)": -0.25, "Financial Services": 0.05, "Energy": -0.05},
    "stagflation": {"_default_": -0.20, "Consumer Cyclical": -0.35, "Technology": -0.30, "Energy": 0.10, "Basic Materials": 0.05, "Consumer Defensive": -0.05, "Healthcare": -0.05, "Utilities": -0.15},
}
SHOCKS = [(scenario, sector, shock) for scenario, shocks in SCENARIOS.items() for sector, shock in shocks.items()]
VALUES = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in SHOCKS)


@query(f"WITH sh(scenario, sector, shock) AS (VALUES {VALUES}), d AS (SELECT scenario, shock AS base FROM sh WHERE sector = '_default_'), p AS (SELECT x.ticker, d.scenario, coalesce(sh.shock, d.base) * coalesce(x.beta, 1.0) AS impact FROM xsection x CROSS JOIN d LEFT JOIN sh ON sh.scenario = d.scenario AND sh.sector = x.sector) SELECT scenario, round(avg(impact), 6) AS mean_impact, arg_min(ticker, (round(impact, 9), ticker)) AS worst FROM p GROUP BY scenario", "xsection")
def pf_11_stress(t: Tables):
    shocks = t.spark.createDataFrame(SHOCKS, "scenario string, shock_sector string, shock double")
    default = shocks.where("shock_sector = '_default_'").select("scenario", F.col("shock").alias("base"))
    x = t.xsection.select("ticker", "sector", "beta").crossJoin(F.broadcast(default))
    own = F.broadcast(shocks.withColumnRenamed("scenario", "own_scenario"))
    hit = x.join(own, (F.col("scenario") == F.col("own_scenario")) & (F.col("sector") == F.col("shock_sector")), "left")
    impact = F.coalesce("shock", "base") * F.coalesce("beta", F.lit(1.0))
    return hit.withColumn("impact", impact).groupBy("scenario").agg(r6(F.avg("impact"), "mean_impact"), F.min_by("ticker", F.struct(F.round("impact", 9), "ticker")).alias("worst"))


@query("WITH g AS (SELECT contract, (ln(spot / strike) + (0.03 + iv * iv / 2) * days / 365.0) / (iv * sqrt(days / 365.0)) AS d1, iv, days, spot FROM chain) SELECT contract, round(d1, 5) AS d1, round(d1 - iv * sqrt(days / 365.0), 5) AS d2, round(exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * iv * sqrt(days / 365.0)), 6) AS gamma, round(spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(days / 365.0) / 100, 6) AS vega FROM g", "chain")
def opt_01_greeks(t: Tables):
    g = O.greeks(t.chain)
    return g.select("contract", F.round("d1", 5).alias("d1"), F.round("d2", 5).alias("d2"), r6("gamma"), r6("vega"))


@query("WITH p AS (SELECT ticker, strike, sum(abs(strike - spot) * open_interest) AS pain FROM chain GROUP BY 1, 2) SELECT ticker, arg_min(strike, (pain, strike)) AS max_pain FROM p GROUP BY ticker", "chain")
def opt_03_pain_at_spot(t: Tables):
    return O.pain_at_spot(t.chain)


@query("WITH s AS (SELECT ticker, strike, sum(CASE WHEN kind = 'call' THEN open_interest ELSE 0 END) AS calls, sum(CASE WHEN kind = 'put' THEN open_interest ELSE 0 END) AS puts FROM chain GROUP BY 1, 2), p AS (SELECT a.ticker, a.strike, sum(CASE WHEN a.strike > b.strike THEN (a.strike - b.strike) * b.calls ELSE (b.strike - a.strike) * b.puts END) AS pain FROM s a JOIN s b USING (ticker) GROUP BY 1, 2) SELECT ticker, arg_min(strike, (pain, strike)) AS max_pain, min(pain) AS pain FROM p GROUP BY ticker", "chain")
def opt_03_max_pain(t: Tables):
    return O.max_pain(t.chain)


@query("WITH n AS (SELECT ticker, arg_min(strike, (abs(strike - spot), strike)) AS strike FROM chain GROUP BY ticker) SELECT ticker, strike, round(coalesce(avg(CASE WHEN kind = 'call' THEN last_price END), 0) + coalesce(avg(CASE WHEN kind = 'put' THEN last_price END), 0), 6) AS move FROM chain JOIN n USING (ticker, strike) GROUP BY 1, 2", "chain")
def opt_04_expected_move(t: Tables):
    return O.expected_move(t.chain).select("ticker", "strike", r6("move"))


@query("WITH s AS (SELECT ticker, kind, strike, CAST(sum(open_interest) AS BIGINT) AS open_interest FROM chain GROUP BY 1, 2, 3) SELECT ticker, kind, strike, open_interest FROM (SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY open_interest DESC, strike) AS k FROM s) WHERE k <= 5", "chain")
def opt_05_top_strikes(t: Tables):
    return O.top_strikes(t.chain).select("ticker", "kind", "strike", "open_interest")


@query("WITH r AS (SELECT ticker, sum(CASE WHEN kind = 'put' THEN volume ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN kind = 'call' THEN volume ELSE 0 END), 0) AS v, sum(CASE WHEN kind = 'put' THEN open_interest ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN kind = 'call' THEN open_interest ELSE 0 END), 0) AS o FROM chain GROUP BY ticker) SELECT ticker, round(v, 6) AS volume_ratio, round(o, 6) AS interest_ratio, CASE WHEN v < 0.7 THEN 'bullish' WHEN v > 1.3 THEN 'bearish' ELSE 'neutral' END AS mood FROM r", "chain")
def opt_07_put_call(t: Tables):
    return O.put_call(t.chain).select("ticker", r6("volume_ratio"), r6("interest_ratio"), "mood")


@query("SELECT contract, round(z, 6) AS z FROM (SELECT contract, (volume - avg(volume) OVER (PARTITION BY ticker, kind)) / nullif(stddev_samp(volume) OVER (PARTITION BY ticker, kind), 0) AS z FROM chain) WHERE z > 2", "chain")
def opt_08_unusual(t: Tables):
    return O.unusual(t.chain).select("contract", r6("z"))


@query("SELECT ticker, strike, round(avg(CASE WHEN kind = 'call' THEN iv END), 6) AS call, round(avg(CASE WHEN kind = 'put' THEN iv END), 6) AS put FROM chain GROUP BY 1, 2", "chain")
def opt_10_smile(t: Tables):
    return O.smile(t.chain).select("ticker", "strike", r6("call"), r6("put"))


@query("SELECT ticker, days, round(avg(iv), 6) AS iv, count(*) AS n FROM chain GROUP BY 1, 2", "chain")
def opt_10_term_structure(t: Tables):
    return O.term_structure(t.chain).select("ticker", "days", r6("iv"), "n")


@query("SELECT ticker, contract, round(annual, 6) AS annual, round(spot - last_price, 6) AS breakeven FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY annual DESC, contract) AS k FROM (SELECT *, last_price / spot * 365 / days AS annual FROM chain WHERE kind = 'call' AND strike > spot * 1.02)) WHERE k <= 5", "chain")
def opt_11_covered_calls(t: Tables):
    return O.covered_calls(t.chain).select("ticker", "contract", r6("annual"), r6("breakeven"))


@query("WITH q AS (SELECT ticker, day, seq, kind, sum(CASE WHEN kind = 'BUY' THEN shares ELSE -shares END) OVER (PARTITION BY ticker ORDER BY day, seq ROWS UNBOUNDED PRECEDING) AS held FROM ledger) SELECT ticker, min(held) >= 0 AS never_oversold, arg_max(held, (day, seq)) AS held FROM q GROUP BY ticker", "ledger")
def pf_04_positions(t: Tables):
    w = Window.partitionBy("ticker").orderBy("day", "seq").rowsBetween(Window.unboundedPreceding, 0)
    q = t.ledger.withColumn("held", F.sum(F.when(F.col("kind") == "BUY", F.col("shares")).otherwise(-F.col("shares"))).over(w))
    return q.groupBy("ticker").agg((F.min("held") >= 0).alias("never_oversold"), F.max_by("held", F.struct("day", "seq")).alias("held"))
