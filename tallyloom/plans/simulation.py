"""Queries over recursive indicators, reweighted scores, sizing and simulated picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import clip, ratio
from tallyloom.operators import cleaning as C
from tallyloom.operators import folds as D
from tallyloom.operators import indicators as N
from tallyloom.operators import strategies as G
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.plans.series import BT, CH, W, roll
from tallyloom.sources.catalog import Tables

WILDER = f"""WITH RECURSIVE {CH}, n AS (SELECT ticker, ts, row_number() OVER ({W}) - 1 AS k, greatest(coalesce(change, 0), 0) AS up, greatest(-coalesce(change, 0), 0) AS down FROM ch),
w AS (SELECT ticker, 14::BIGINT AS k, sum(up) / 14 AS u, sum(down) / 14 AS d FROM n WHERE k <= 14 GROUP BY ticker HAVING count(*) = 15
  UNION ALL SELECT n.ticker, n.k, (w.u * 13 + n.up) / 14, (w.d * 13 + n.down) / 14 FROM w JOIN n ON n.ticker = w.ticker AND n.k = w.k + 1)
SELECT n.ticker, n.ts, round(CASE WHEN d = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / d) END, 4) AS rsi FROM n LEFT JOIN w USING (ticker, k)"""


@query(WILDER.replace("round(CASE WHEN d = 0", "round(CASE WHEN d IS NULL THEN NULL WHEN d = 0"), "bars")
def win_08_str_10_rsi_wilder(t: Tables):
    return D.rsi_wilder(t.bars).select("ticker", "ts", F.round("rsi", 4).alias("rsi"))


@query(None)
def str_07_supertrend(t: Tables):
    return D.supertrend(t.bars).select("ticker", "ts", "direction")


@query(None)
def str_08_parabolic(t: Tables):
    return D.parabolic(t.bars).select("ticker", "ts", "stop", "direction")


@query(f"SELECT ticker, ts, (CASE WHEN close / lag(close, 20) OVER ({W}) - 1 - {roll('stddev_samp', 'close', 20)} / {roll('avg', 'close', 20)} > 0 THEN 1 ELSE 0 END)::BIGINT AS signal FROM bars", "bars")
def str_14_factor_composite(t: Tables):
    """Momentum less relative deviation, long while positive."""
    x = S.returns("close", 20) - ratio(S.rolling_std("close", 20), S.sma("close", 20))
    return t.bars.select("ticker", "ts", F.when(x > 0, 1).otherwise(0).cast("long").alias("signal"))


@query("WITH s AS (SELECT sector, avg(return_6m) AS m FROM xsection WHERE sector IS NOT NULL GROUP BY sector), b AS (SELECT sector FROM s ORDER BY round(m, 9) DESC, sector LIMIT 3), k AS (SELECT x.ticker, x.sector, row_number() OVER (PARTITION BY x.sector ORDER BY return_6m DESC, x.ticker) AS k FROM xsection x JOIN b USING (sector)) SELECT sector, ticker FROM k WHERE k <= 2", "xsection")
def str_15_sector_rotation(t: Tables):
    """The best names of the best sectors: two levels of top-k."""
    x = t.xsection.where("sector is not null")
    best = x.groupBy("sector").agg(F.round(F.avg("return_6m"), 9).alias("m")).orderBy(F.col("m").desc(), "sector").limit(3).select("sector")
    w = Window.partitionBy("sector").orderBy(F.col("return_6m").desc(), "ticker")
    return x.join(best, "sector", "left_semi").withColumn("k", F.row_number().over(w)).where("k <= 2").select("sector", "ticker")


@query("SELECT ticker, round(least(greatest(roe / nullif(volatility * volatility, 0), 0.0), 1.0) * 0.5, 6) AS half_kelly, round(least(0.15 / nullif(volatility, 0), 1.0), 6) AS by_volatility FROM xsection WHERE roe IS NOT NULL", "xsection")
def bt_14_position_sizes(t: Tables):
    x = t.xsection.where("roe is not null")
    v = F.col("volatility")
    return x.select("ticker", r6(clip(ratio("roe", v * v), 0.0, 1.0) * 0.5, "half_kelly"), r6(clip(ratio(F.lit(0.15), v), high=1.0), "by_volatility"))


AB = "(score_total * 0.7 + rsi_14 * 0.3)"


@query(f"WITH k AS (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY snapshot_date) / nullif(close, 0) - 1 AS f FROM snapshots), r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY score_total DESC, ticker) AS ka, row_number() OVER (PARTITION BY snapshot_date ORDER BY round({AB}, 9) DESC, ticker) AS kb FROM k) SELECT round(avg(CASE WHEN ka <= 10 THEN f END), 6) AS a, round(avg(CASE WHEN kb <= 10 THEN f END), 6) AS b, count(CASE WHEN ka <= 10 AND kb <= 10 THEN 1 END) AS shared FROM r", "snapshots")
def bt_21_reweighting(t: Tables):
    """Two weightings of stored scores by the return of their best ten."""
    f = ratio(F.lead("close").over(Window.partitionBy("ticker").orderBy("snapshot_date")), "close") - 1
    other = F.round(F.col("score_total") * 0.7 + F.col("rsi_14") * 0.3, 9)
    place = lambda c: F.row_number().over(Window.partitionBy("snapshot_date").orderBy(c.desc(), "ticker"))
    r = t.snapshots.withColumn("f", f).withColumn("other", other).withColumns({"ka": place(F.col("score_total")), "kb": place(F.col("other"))})
    a, b = F.col("ka") <= 10, F.col("kb") <= 10
    return r.agg(r6(F.avg(F.when(a, F.col("f"))), "a"), r6(F.avg(F.when(b, F.col("f"))), "b"), F.count_if(a & b).alias("shared"))


@query("WITH r AS (SELECT month, actual, row_number() OVER (PARTITION BY month ORDER BY pred DESC, ticker) AS k FROM panel), m AS (SELECT month, avg(actual) / 100 AS x FROM r WHERE k <= 10 GROUP BY month) SELECT month, round(product(1 + x) OVER (ORDER BY month), 6) AS equity FROM m", "panel")
def bt_22_top_n_simulation(t: Tables):
    k = F.row_number().over(Window.partitionBy("month").orderBy(F.col("pred").desc(), "ticker"))
    m = t.panel.withColumn("k", k).where("k <= 10").groupBy("month").agg((F.avg("actual") / 100).alias("x"))
    return m.select("month", r6(F.product(1 + F.col("x")).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)), "equity"))  # a row a month


@query(BT + f", e AS (SELECT ticker, ts, product(1 + coalesce(sr, 0)) OVER ({W}) AS equity, row_number() OVER ({W}) AS k FROM p) SELECT ticker, ts, round(equity, 5) + 0.0 AS equity FROM e WHERE k % 20 = 0", "bars")
def bt_24_downsampled_equity(t: Tables):
    x = G.backtest(G.ma_cross(t.bars)).withColumn("k", F.row_number().over(S.ordered()))
    return x.where("k % 20 = 0").select("ticker", "ts", F.round("equity", 5).alias("equity"))


@query(BT + ", y AS (SELECT ticker, year(ts) AS y, coalesce(sr, 0) AS x FROM p), ys AS (SELECT ticker, y, avg(x) / nullif(stddev_samp(x), 0) AS s FROM y GROUP BY 1, 2) SELECT a.ticker, a.y::BIGINT AS year, round(a.s, 5) AS in_sample, round(b.s, 5) AS out_of_sample, b.s < 0.5 * a.s AS overfit FROM ys a JOIN ys b ON a.ticker = b.ticker AND b.y = a.y + 1 WHERE a.s IS NOT NULL AND b.s IS NOT NULL", "bars")
def bt_12_19_walk_forward(t: Tables):
    """Each year's Sharpe ratio against that of the next."""
    x = G.backtest(G.ma_cross(t.bars)).withColumn("year", F.year("ts").cast("long"))
    s = x.groupBy("ticker", "year").agg(ratio(F.avg("strategy_return"), F.stddev_samp("strategy_return")).alias("s"))
    later = s.select("ticker", (F.col("year") - 1).alias("year"), F.col("s").alias("o"))
    both = s.join(later, ["ticker", "year"]).where("s is not null and o is not null")
    return both.select("ticker", "year", F.round("s", 5).alias("in_sample"), F.round("o", 5).alias("out_of_sample"), (F.col("o") < 0.5 * F.col("s")).alias("overfit"))


@query("WITH " + CH + ", p AS (SELECT a.ticker AS a, b.ticker AS b, corr(a.r, b.r) AS c FROM ch a JOIN ch b ON a.ts = b.ts AND a.ticker <> b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2) SELECT a AS ticker, round(avg(c), 6) AS mean_correlation, row_number() OVER (ORDER BY round(avg(c), 9), a) AS place FROM p GROUP BY a", "bars")
def pf_06_diversifiers(t: Tables):
    p = G.pairwise_correlation(S.with_changes(t.bars))
    both = p.select("a", "correlation").union(p.select("b", "correlation"))
    m = both.groupBy(F.col("a").alias("ticker")).agg(F.avg("correlation").alias("c"))
    return m.select("ticker", r6("c", "mean_correlation"), F.row_number().over(Window.orderBy(F.round("c", 9), "ticker")).cast("long").alias("place"))  # a row a holding


@query(f"WITH m AS (SELECT *, max(close) OVER ({W}) AS peak FROM bars), d AS (SELECT *, close / peak - 1 AS dd FROM m), v AS (SELECT ticker, min(dd) AS worst, arg_min(ts, (round(dd, 9), ts)) AS valley, arg_min(peak, (round(dd, 9), ts)) AS peak FROM d GROUP BY ticker) SELECT v.ticker, round(worst, 6) AS worst, valley, (SELECT min(ts) FROM bars b WHERE b.ticker = v.ticker AND b.ts > v.valley AND b.close >= v.peak) AS recovered FROM v", "bars")
def pf_10_drawdown_dates(t: Tables):
    top = F.max("close").over(S.ordered().rowsBetween(Window.unboundedPreceding, 0))
    d = t.bars.withColumn("peak", top).withColumn("dd", ratio("close", "peak") - 1)
    order = F.struct(F.round("dd", 9), "ts")
    v = d.groupBy("ticker").agg(F.min("dd").alias("worst"), F.min_by("ts", order).alias("valley"), F.min_by("peak", order).alias("level"))
    later = t.bars.select("ticker", "ts", "close").join(v, "ticker").where("ts > valley and close >= level").groupBy("ticker").agg(F.min("ts").alias("recovered"))
    return v.join(later, "ticker", "left").select("ticker", r6("worst"), "valley", "recovered")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY score_total DESC, ticker) AS k FROM snapshots), e AS (SELECT ticker, snapshot_date FROM r WHERE k <= 10) SELECT e.ticker, e.snapshot_date FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.ticker = e.ticker AND o.snapshot_date < e.snapshot_date)", "snapshots")
def pf_20_new_entries(t: Tables):
    """Daily best ten that weren't picked before."""
    k = F.row_number().over(Window.partitionBy("snapshot_date").orderBy(F.col("score_total").desc(), "ticker"))
    return t.snapshots.withColumn("k", k).where("k <= 10").groupBy("ticker").agg(F.min("snapshot_date").alias("snapshot_date"))


@query("SELECT contract, round(volume * last_price * 100, 4) AS premium, CASE WHEN volume * last_price * 100 >= 20000 THEN 'BLOCK' WHEN volume > open_interest THEN 'SWEEP' ELSE 'NORMAL' END AS class FROM chain", "chain")
def opt_06_flow_classes(t: Tables):
    premium = F.col("volume") * F.col("last_price") * 100
    return t.chain.select("contract", F.round(premium, 4).alias("premium"), F.when(premium >= 20000, "BLOCK").when(F.col("volume") > F.col("open_interest"), "SWEEP").otherwise("NORMAL").alias("class"))


@query("SELECT ticker, (greatest(1, least(9, 4 + CASE WHEN roe > 0.1 THEN 2 WHEN roe < 0 THEN -2 ELSE 0 END + CASE WHEN debt_to_equity < 100 THEN 1 ELSE 0 END + CASE WHEN revenue_growth > 0 THEN 1 ELSE 0 END)))::BIGINT AS proxy FROM xsection", "xsection")
def scr_31_f_proxy(t: Tables):
    roe = F.when(F.col("roe") > 0.1, 2).when(F.col("roe") < 0, -2).otherwise(0)
    total = 4 + roe + F.when(F.col("debt_to_equity") < 100, 1).otherwise(0) + F.when(F.col("revenue_growth") > 0, 1).otherwise(0)
    return t.xsection.select("ticker", F.greatest(F.lit(1), F.least(F.lit(9), total)).cast("long").alias("proxy"))


@query("SELECT ticker, round(greatest(0.0, least(100.0, roe * 200 + CASE sector WHEN 'Technology' THEN 10.0 WHEN 'Energy' THEN -10.0 ELSE 0.0 END)), 6) AS adjusted, rank() OVER (ORDER BY round(greatest(0.0, least(100.0, roe * 200 + CASE sector WHEN 'Technology' THEN 10.0 WHEN 'Energy' THEN -10.0 ELSE 0.0 END)), 9) DESC)::BIGINT AS rank FROM xsection WHERE roe IS NOT NULL", "xsection")
def scr_37_sector_adjustment(t: Tables):
    """Points by the state of the sector, held to 0 to 100, ranked anew."""
    points = C.lookup({"Technology": N.STATE_POINTS["STRONG_UP"], "Energy": N.STATE_POINTS["DOWN"]}, F.col("sector"), 0.0)
    x = t.xsection.where("roe is not null").withColumn("adjusted", clip(F.col("roe") * 200 + points, 0.0, 100.0))
    rank = F.rank().over(Window.partitionBy("as_of").orderBy(F.round("adjusted", 9).desc()))
    return x.select("ticker", r6("adjusted"), rank.cast("long").alias("rank"))
