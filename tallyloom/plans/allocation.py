"""Queries over allocations, simulations, sweeps, calendars, insiders and attributions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import clip, known, ratio
from tallyloom.operators import allocation as A
from tallyloom.operators import walkforward as WF
from tallyloom.operators.search import genetic, random_candidates
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.plans.series import CH, W, roll
from tallyloom.sources.catalog import Tables


def portfolio_cov(t: Tables):
    return A.covariances(S.with_changes(t.bars).withColumn("portfolio", F.lit("all")))


@query("WITH " + CH + " SELECT a.ticker AS a, b.ticker AS b, round(covar_samp(a.r, b.r), 6) AS cov FROM ch a JOIN ch b ON a.ts = b.ts WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2", "bars")
def pf_14_covariances(t: Tables):
    return portfolio_cov(t).select("a", "b", r6("cov"))


@query(None)
def pf_14_mean_variance(t: Tables):
    return A.weights(portfolio_cov(t), "mean_variance")


@query(None)
def pf_14_min_variance(t: Tables):
    return A.weights(portfolio_cov(t), "min_variance")


@query(None)
def pf_16_black_litterman(t: Tables):
    return A.weights(portfolio_cov(t), "black_litterman")


@query(None)
def pf_17_hierarchical(t: Tables):
    return A.weights(portfolio_cov(t), "hierarchical")


@query("WITH w AS (SELECT sector AS portfolio, ticker, least(greatest(roe, 0.01), 0.25) AS w FROM xsection WHERE sector IS NOT NULL AND roe IS NOT NULL) SELECT portfolio, ticker, round(w / sum(w) OVER (PARTITION BY portfolio), 6) AS weight FROM w", "xsection")
def pf_15_clipped_weights(t: Tables):
    x = t.xsection.where("sector is not null and roe is not null").select(F.col("sector").alias("portfolio"), "ticker", F.col("roe").alias("weight"))
    return A.clip_weights(x).select("portfolio", "ticker", r6("weight"))


@query(None)
def pf_18_monte_carlo(t: Tables):
    params = S.with_changes(t.bars).groupBy("ticker").agg((F.avg("r") / 1000).alias("drift"), (F.stddev_samp("r") / 100).alias("volatility"))
    return A.monte_carlo(params, 200, 20)


SWEEP = [(5, 20), (10, 50), (20, 100)]


def sweep_sql(pairs=tuple(SWEEP)) -> str:
    parts = []
    for f, s in pairs:
        parts.append(f"SELECT ticker, {f} AS fast, {s} AS slow, avg(coalesce(x, 0)) / nullif(stddev_samp(coalesce(x, 0)), 0) * sqrt(252) AS sharpe FROM (SELECT ticker, lag(CASE WHEN f > s THEN 1 WHEN f < s THEN -1 ELSE 0 END) OVER ({W}) * r AS x FROM (SELECT ticker, ts, r, {roll('avg', 'close', f)} AS f, {roll('avg', 'close', s)} AS s FROM ch)) GROUP BY ticker")
    return f"WITH {CH}, s AS ({' UNION ALL '.join(parts)}) SELECT ticker, fast::BIGINT AS fast, slow::BIGINT AS slow, round(sharpe, 5) AS sharpe, row_number() OVER (PARTITION BY ticker ORDER BY round(sharpe, 9) DESC, fast, slow) AS place FROM s"


@query(sweep_sql(), "bars")
def bt_09_parameter_sweep(t: Tables):
    """Each pair of window lengths on each series, ranked by Sharpe ratio: the parameters are rows like any others."""
    return placed(sweep(t, SWEEP))


def sweep(t: Tables, pairs):
    """ticker, fast, slow, sharpe of moving-average crosses for each pair of window lengths: one pass over the bars."""
    return WF.cross_returns(t.bars, pairs, ["ticker"]).groupBy("ticker", "fast", "slow").agg(WF.sharpe(F.col("x")).alias("sharpe"))


def placed(runs):
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.round("sharpe", 9).desc(), "fast", "slow")).cast("long")
    return runs.withColumn("place", place).withColumn("sharpe", F.round("sharpe", 5))


DRAWN = random_candidates([[3, 5, 8, 10, 15, 20], [25, 40, 60, 90, 120]], 5)


@query(sweep_sql(DRAWN), "bars")
def bt_10_random_search(t: Tables):
    """Seeded draws of window lengths, valued and ranked like the sweep."""
    return placed(sweep(t, DRAWN))


@query(None)
def bt_11_genetic_search(t: Tables):
    """Best mean Sharpe ratio over all series by generation; each generation's new pairs are one job."""

    def values(pairs):
        rows = sweep(t, pairs).groupBy("fast", "slow").agg(F.avg("sharpe").alias("v")).collect()  # a number a candidate
        return {(r["fast"], r["slow"]): float("-inf") if r["v"] is None else r["v"] for r in rows}

    found = genetic(values, [[3, 5, 8, 10, 15, 20], [25, 40, 60, 90, 120]], size=4, generations=3)
    return t.spark.createDataFrame([(g, *c, v) for g, c, v in found], "generation long, fast long, slow long, sharpe double")


MONTHLY = f"""WITH m AS (SELECT ticker, CAST(date_trunc('month', ts) AS DATE) AS month, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2),
s AS (SELECT *, close / lag(close, 3) OVER (PARTITION BY ticker ORDER BY month) - 1 AS momentum, lead(close) OVER (PARTITION BY ticker ORDER BY month) / close - 1 AS next FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(momentum, 9) DESC, ticker) AS k FROM s WHERE momentum IS NOT NULL)
SELECT month, round(avg(CASE WHEN k <= 2 THEN next END), 6) AS picked, round(avg(next), 6) AS market FROM k GROUP BY month"""


@query(MONTHLY, "bars")
def bt_17_18_monthly_top_n(t: Tables):
    m = t.bars.groupBy("ticker", F.trunc("ts", "MM").alias("month")).agg(F.max_by("close", "ts").alias("close"))
    w = Window.partitionBy("ticker").orderBy("month")
    s = m.withColumns({"momentum": ratio("close", F.lag("close", 3).over(w)) - 1, "next": ratio(F.lead("close").over(w), "close") - 1}).where("momentum is not null")
    k = s.withColumn("k", F.row_number().over(Window.partitionBy("month").orderBy(F.round("momentum", 9).desc(), "ticker")))
    return k.groupBy("month").agg(r6(F.avg(F.when(F.col("k") <= 2, F.col("next"))), "picked"), r6(F.avg("next"), "market"))


@query("WITH h AS (SELECT c_custkey, concat('T', lpad(CAST(1 + c_custkey % 2000 AS VARCHAR), 6, '0')) AS name, c_acctbal AS shares FROM customer), k AS (SELECT h.*, s.suffix, s.p, h.name || s.suffix AS ticker FROM h CROSS JOIN (VALUES ('', 0), ('.ST', 1), ('.HK', 2), ('.DE', 3), ('.L', 4)) s(suffix, p)), j AS (SELECT k.c_custkey, x.ticker, x.current_price, k.shares, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN x.ticker IS NULL THEN 1 ELSE 0 END, p) AS n FROM k LEFT JOIN xsection x ON k.ticker = x.ticker) SELECT c_custkey, ticker, round(shares * current_price, 4) AS value FROM j WHERE n = 1", "xsection")
def jn_03_04_holdings_with_suffixes(t: Tables):
    """Each holding with the first of its candidate tickers that is known, and its value."""
    h = t.customer.select("c_custkey", F.concat(F.lit("T"), F.lpad((1 + F.col("c_custkey") % 2000).cast("string"), 6, "0")).alias("name"), F.col("c_acctbal").alias("shares"))
    k = h.select("*", F.posexplode(F.array(*[F.lit(s) for s in ("", ".ST", ".HK", ".DE", ".L")])).alias("p", "suffix")).withColumn("ticker", F.concat("name", "suffix"))
    prices = t.xsection.select(F.col("ticker").alias("known_ticker"), "current_price")
    j = k.join(prices, F.col("ticker") == F.col("known_ticker"), "left")
    first = Window.partitionBy("c_custkey").orderBy(F.col("known_ticker").isNull(), "p")
    return j.withColumn("n", F.row_number().over(first)).where("n = 1").select("c_custkey", F.col("known_ticker").alias("ticker"), F.round(F.col("shares") * F.col("current_price"), 4).alias("value"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, datediff('day', DATE '2024-01-20', CAST(ts AS DATE)) AS days_left, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-25' AND user_id IN (SELECT s_suppkey FROM supplier) AND event_type = 'purchase'")
def jn_06_top_11_upcoming(t: Tables):
    """Events of held names within five days, with the days left."""
    day = F.to_date("ts")
    held = t.supplier.select(F.col("s_suppkey").alias("user_id"))
    near = t.events.where(day.between("2024-01-20", "2024-01-25") & (F.col("event_type") == "purchase"))
    return near.join(held, "user_id", "left_semi").select("user_id", day.alias("day"), F.datediff(day, F.lit("2024-01-20")).cast("long").alias("days_left"), "event_type")


@query("WITH b AS (SELECT user_id % 20 AS ticker, user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'error' THEN -value ELSE 0 END AS net FROM events) SELECT ticker, round(sum(CASE WHEN net > 0 THEN net ELSE 0 END), 4) AS bought, round(-sum(CASE WHEN net < 0 THEN net ELSE 0 END), 4) AS sold, count(DISTINCT CASE WHEN net > 0 AND day >= DATE '2024-01-25' THEN user_id END) >= 3 AS cluster, round(0.5 + 0.35 * sum(net) / nullif(sum(abs(net)), 0), 6) AS signal FROM b GROUP BY ticker")
def agg_06_07_insider_clusters(t: Tables):
    value = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", -F.col("value")).otherwise(0.0)
    b = t.events.select((F.col("user_id") % 20).alias("ticker"), "user_id", F.to_date("ts").alias("day"), value.alias("net"))
    buyers = F.count_distinct(F.when((F.col("net") > 0) & (F.col("day") >= "2024-01-25"), F.col("user_id")))
    return b.groupBy("ticker").agg(F.round(F.sum(F.greatest("net", F.lit(0.0))), 4).alias("bought"), F.round(-F.sum(F.least("net", F.lit(0.0))), 4).alias("sold"), (buyers >= 3).alias("cluster"), r6(F.lit(0.5) + 0.35 * ratio(F.sum("net"), F.sum(F.abs("net"))), "signal"))


BRINSON = """WITH x AS (SELECT sector, market_cap, return_3m, CASE WHEN piotroski_f >= 5 THEN market_cap ELSE 0 END AS held FROM xsection WHERE sector IS NOT NULL AND market_cap IS NOT NULL),
s AS (SELECT sector, sum(held) AS pv, sum(market_cap) AS bv, sum(held * return_3m) / nullif(sum(held), 0) AS pr, sum(market_cap * return_3m) / sum(market_cap) AS br FROM x GROUP BY sector),
w AS (SELECT *, pv / sum(pv) OVER () AS pw, bv / sum(bv) OVER () AS bw, sum(bv * br) OVER () / sum(bv) OVER () AS total FROM s)
SELECT sector, round((pw - bw) * (br - total), 6) + 0.0 AS allocation, round(bw * (pr - br), 6) + 0.0 AS selection, round((pw - bw) * (pr - br), 6) + 0.0 AS interaction FROM w"""


@query(BRINSON, "xsection")
def agg_20_brinson(t: Tables):
    x = t.xsection.where("sector is not null and market_cap is not null").withColumn("held", F.when(F.col("piotroski_f") >= 5, F.col("market_cap")).otherwise(0.0))
    s = x.groupBy("sector").agg(F.sum("held").alias("pv"), F.sum("market_cap").alias("bv"), ratio(F.sum(F.col("held") * F.col("return_3m")), F.sum("held")).alias("pr"), ratio(F.sum(F.col("market_cap") * F.col("return_3m")), F.sum("market_cap")).alias("br"))
    total = s.agg(F.sum("pv").alias("pt"), F.sum("bv").alias("bt"), F.sum(F.col("bv") * F.col("br")).alias("bsum"))
    w = s.crossJoin(F.broadcast(total)).withColumns({"pw": ratio("pv", "pt"), "bw": ratio("bv", "bt"), "total": ratio("bsum", "bt")})
    tilt = F.col("pw") - F.col("bw")
    return w.select("sector", r6(tilt * (F.col("br") - F.col("total")), "allocation"), r6(F.col("bw") * (F.col("pr") - F.col("br")), "selection"), r6(tilt * (F.col("pr") - F.col("br")), "interaction"))


@query("SELECT ticker, round((CASE WHEN rsi_14 IS NOT NULL THEN 40 * greatest(0, 1 - (pk % 30) / 30.0) ELSE 0 END + CASE WHEN beta IS NOT NULL THEN 20 * greatest(0, 1 - (pk % 90) / 90.0) ELSE 0 END + CASE WHEN roe IS NOT NULL THEN 25 * greatest(0, 1 - (pk % 7) / 7.0) ELSE 0 END) / nullif(CASE WHEN rsi_14 IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN beta IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN roe IS NOT NULL THEN 25 ELSE 0 END, 0), 6) AS freshness FROM xsection", "xsection")
def agg_21_freshness(t: Tables):
    """Weighted mean of age scores over the parts that are there."""
    parts = [("rsi_14", 40.0, 30), ("beta", 20.0, 90), ("roe", 25.0, 7)]
    used = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w, _ in parts), F.lit(0.0))
    total = sum((F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), 1 - (F.col("pk") % d) / float(d)) * w).otherwise(0.0) for c, w, d in parts), F.lit(0.0))
    return t.xsection.select("ticker", r6(ratio(total, used), "freshness"))


@query("SELECT event_type, round((arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / nullif(datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 0), 6) AS per_day FROM events GROUP BY event_type")
def agg_22_growth_rate(t: Tables):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("event_type").agg(r6(ratio(F.max_by("value", at) - F.min_by("value", at), F.datediff(F.max("ts"), F.min("ts"))), "per_day"))


@query("SELECT ticker, array_to_string(list_filter([CASE WHEN roe < 0 THEN 'unprofitable' END, CASE WHEN piotroski_f <= 2 THEN 'weak accounts' END, CASE WHEN return_6m < -0.15 THEN 'falling' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM xsection WHERE coalesce(roe < 0, false) OR piotroski_f <= 2 OR return_6m < -0.15", "xsection")
def top_07_removals(t: Tables):
    why = F.filter(F.array(F.when(F.col("roe") < 0, "unprofitable"), F.when(F.col("piotroski_f") <= 2, "weak accounts"), F.when(F.col("return_6m") < -0.15, "falling")), lambda x: x.isNotNull())
    return t.xsection.withColumn("why", why).where(F.size("why") > 0).select("ticker", F.array_join("why", ", ").alias("reasons"))


@query("WITH g AS (SELECT ticker, sector, row_number() OVER (PARTITION BY sector ORDER BY return_6m, ticker) AS k FROM xsection WHERE piotroski_f = 0 AND sector IS NOT NULL), c AS (SELECT ticker AS candidate, sector, row_number() OVER (PARTITION BY sector ORDER BY return_6m DESC, ticker) AS k FROM xsection WHERE piotroski_f = 9) SELECT g.ticker, c.candidate FROM g LEFT JOIN c USING (sector, k)", "xsection")
def top_08_10_replacements(t: Tables):
    """Each removal gets another candidate of its sector: ranks on both sides are joined."""
    rank = lambda order: F.row_number().over(Window.partitionBy("sector").orderBy(*order))
    gone = t.xsection.where("piotroski_f = 0 and sector is not null").withColumn("k", rank([F.col("return_6m"), F.col("ticker")])).select("ticker", "sector", "k")
    fresh = t.xsection.where("piotroski_f = 9").withColumn("k", rank([F.col("return_6m").desc(), F.col("ticker")])).select(F.col("ticker").alias("candidate"), "sector", "k")
    return gone.join(fresh, ["sector", "k"], "left").select("ticker", "candidate")


@query("SELECT ticker, pk % 4 = 0 AS watched FROM xsection WHERE rsi_14 IS NULL OR market_cap IS NULL OR (pe_trailing IS NULL AND roe IS NULL) ORDER BY watched DESC, ticker LIMIT 50", "xsection")
def top_09_missing_data(t: Tables):
    gap = F.col("rsi_14").isNull() | F.col("market_cap").isNull() | (F.col("pe_trailing").isNull() & F.col("roe").isNull())
    return t.xsection.where(gap).select("ticker", (F.col("pk") % 4 == 0).alias("watched")).orderBy(F.col("watched").desc(), "ticker").limit(50)


@query("SELECT name, min(pos) AS pos FROM (SELECT p_name AS name, p_partkey AS pos FROM part UNION ALL SELECT p_name, p_partkey + 1000000 FROM part) GROUP BY name")
def set_02_09_ordered_distinct(t: Tables):
    both = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")).unionByName(t.part.select(F.col("p_name").alias("name"), (F.col("p_partkey") + 1000000).alias("pos")))
    return both.groupBy("name").agg(F.min("pos").alias("pos"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT s_suppkey FROM supplier)")
def set_10_jn_10_new_candidates(t: Tables):
    states = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).union(t.supplier.select("s_suppkey"))
    return t.customer.join(states, "c_custkey", "left_anti").select("c_custkey")


@query(f"SELECT ticker, ts, round(close / nullif({roll('avg', 'close', 60)}, 0) - 1, 6) AS vs_mean FROM bars", "bars")
def win_28_own_mean(t: Tables):
    return t.bars.select("ticker", "ts", r6(ratio("close", S.sma("close", 60)) - 1, "vs_mean"))


STOP = f"""WITH {CH}, v AS (SELECT *, {roll('stddev_samp', 'r', 30)} * sqrt(252) / 100 AS vol, {roll('avg', 'range', 14)} AS atr FROM (SELECT *, high - low AS range FROM ch))
SELECT ticker, ts, CASE WHEN vol IS NULL THEN NULL WHEN vol < 0.15 THEN 'LOW' WHEN vol < 0.22 THEN 'NORMAL' WHEN vol < 0.30 THEN 'HIGH' ELSE 'EXTREME' END AS regime, round(greatest(close - 2 * atr, 0.8 * lag(close, 20) OVER ({W})), 5) AS stop FROM v WHERE atr IS NOT NULL"""


@query(STOP.replace("SELECT ticker, ts, CASE", "x AS (SELECT *, lag(close, 20) OVER (" + W + ") AS cost FROM v) SELECT ticker, ts, CASE").replace("FROM (SELECT *, high - low AS range FROM ch))\n", "FROM (SELECT *, high - low AS range FROM ch)),\n").replace(f"lag(close, 20) OVER ({W})), 5) AS stop FROM v WHERE atr IS NOT NULL", "cost), 5) AS stop FROM x WHERE atr IS NOT NULL AND cost IS NOT NULL"), "bars")
def scr_44_volatility_stops(t: Tables):
    x = S.with_changes(t.bars).withColumn("range", F.col("high") - F.col("low"))
    x = x.withColumns({"vol": S.rolling_std("r", 30) * F.sqrt(F.lit(252.0)) / 100, "atr": S.sma("range", 14), "cost": F.lag("close", 20).over(S.ordered())})
    regime = F.when(F.col("vol").isNull(), None).when(F.col("vol") < 0.15, "LOW").when(F.col("vol") < 0.22, "NORMAL").when(F.col("vol") < 0.30, "HIGH").otherwise("EXTREME")
    return x.where("atr is not null and cost is not null").select("ticker", "ts", regime.alias("regime"), F.round(F.greatest(F.col("close") - 2 * F.col("atr"), 0.8 * F.col("cost")), 5).alias("stop"))


@query("SELECT ticker, CASE WHEN ratio IS NULL THEN 0.5 WHEN ratio <= 0.5 THEN 0.9 WHEN ratio >= 1.5 THEN 0.1 ELSE round(0.9 - 0.8 * (ratio - 0.5), 6) END AS signal FROM (SELECT ticker, sum(CASE WHEN kind = 'put' THEN volume ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN kind = 'call' THEN volume ELSE 0 END), 0) AS ratio FROM chain GROUP BY ticker)", "chain")
def opt_09_flow_signal(t: Tables):
    """Put/call ratio as a signal that falls along a line between two ends."""
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("volume")).otherwise(0))
    r = t.chain.groupBy("ticker").agg(ratio(part("put"), part("call")).alias("ratio"))
    line = 0.9 - 0.8 * (F.col("ratio") - 0.5)
    return r.select("ticker", F.when(F.col("ratio").isNull(), 0.5).when(F.col("ratio") <= 0.5, 0.9).when(F.col("ratio") >= 1.5, 0.1).otherwise(F.round(line, 6)).alias("signal"))


@query("WITH n AS (SELECT ticker, spot, strike, last_price, row_number() OVER (PARTITION BY ticker ORDER BY abs(strike - spot), contract) AS k FROM chain) SELECT ticker, round(2 * last_price, 6) AS cost, round(spot - 2 * last_price, 6) AS low, round(spot + 2 * last_price, 6) AS high, CASE WHEN 2 * last_price / spot > 0.04 THEN 'SELL_VOLATILITY' ELSE 'BUY_VOLATILITY' END AS play FROM n WHERE k = 1", "chain")
def opt_12_straddle(t: Tables):
    w = Window.partitionBy("ticker").orderBy(F.abs(F.col("strike") - F.col("spot")), "contract")
    n = t.chain.withColumn("k", F.row_number().over(w)).where("k = 1").withColumn("cost", 2 * F.col("last_price"))
    return n.select("ticker", r6("cost"), r6(F.col("spot") - F.col("cost"), "low"), r6(F.col("spot") + F.col("cost"), "high"), F.when(F.col("cost") / F.col("spot") > 0.04, "SELL_VOLATILITY").otherwise("BUY_VOLATILITY").alias("play"))


@query(None)
def opt_02_implied_volatility(t: Tables):
    """Newton steps for whole batches; the model value of each contract is the price to invert."""
    import numpy as np

    from tallyloom.operators.options import greeks

    @F.pandas_udf("double")
    def implied(value: pd.Series, spot: pd.Series, strike: pd.Series, days: pd.Series, kind: pd.Series) -> pd.Series:
        s, k, y, call = spot.to_numpy(), strike.to_numpy(), days.to_numpy() / 365.0, (kind == "call").to_numpy()
        sigma = np.full(len(value), 0.3)

        def cdf(x):
            z = np.abs(x) / np.sqrt(2)
            u = 1 / (1 + 0.5 * z)
            # Coefficients of the error function's approximation, from the constant term up.
            c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
            tail = u * np.exp(-z * z + np.polyval(c[::-1], u)) / 2
            return np.where(x >= 0, 1 - tail, tail)

        for _ in range(60):
            root = sigma * np.sqrt(y)
            d1 = (np.log(s / k) + (0.03 + sigma**2 / 2) * y) / root
            d2 = d1 - root
            price = np.where(call, s * cdf(d1) - k * np.exp(-0.03 * y) * cdf(d2), k * np.exp(-0.03 * y) * cdf(-d2) - s * cdf(-d1))
            vega = s * np.exp(-(d1**2) / 2) / np.sqrt(2 * np.pi) * np.sqrt(y)
            sigma = np.clip(sigma - (price - value.to_numpy()) / np.maximum(vega, 1e-8), 0.001, 2.0)
        return pd.Series(sigma)

    g = greeks(t.chain)
    return g.select("contract", "iv", implied("value", "spot", "strike", "days", "kind").alias("implied"), known(F.col("value") > 0).alias("positive"))


@query("SELECT ticker, round(greatest(0.0, least(1.0, 0.5 + 0.35 * (return_3m * 2))), 6) AS tilt FROM xsection", "xsection")
def scr_43_bounded_signal(t: Tables):
    return t.xsection.select("ticker", r6(clip(0.5 + 0.35 * (F.col("return_3m") * 2), 0.0, 1.0), "tilt"))
