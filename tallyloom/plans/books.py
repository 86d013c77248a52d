"""Queries over paper trades, recommendations, rolling fits, polls and queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import pct_rank, ratio
from tallyloom.operators import book as B
from tallyloom.operators import ledger as L
from tallyloom.operators import polls as P
from tallyloom.operators import rolling as R
from tallyloom.operators import strategies as G
from tallyloom.plans.cross_section import r6
from tallyloom.plans.portfolio import BUYS
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables


@query(None)
def pf_19_paper_trades(t: Tables):
    """A trade from the first bar of each month in each series; checked against a loop over bars in the tests."""
    month = Window.partitionBy("ticker", F.trunc("ts", "MM")).orderBy("ts")
    x = t.bars.withColumn("tr", S.true_range()).withColumn("atr", S.sma("tr", 14) / 40).withColumn("starts", F.row_number().over(month) == 1)
    out = B.paper_trades(x.withColumn("day", F.col("ts")), "starts", 10_000.0)
    return out.select("ticker", "bought", "reason", "sold_on", r6("sold_at"), "top_ups", "halved", F.round("pnl", 4).alias("pnl"))


@query(f"""WITH {BUYS}, sold AS (SELECT ticker, sum(shares) AS sold FROM ledger WHERE kind = 'SELL' GROUP BY ticker), o AS (SELECT b.*, greatest(0, least(shares, until - coalesce(sold, 0))) AS open FROM buys b LEFT JOIN sold USING (ticker)),
h AS (SELECT ticker AS pk, sum(open) AS shares, sum(open * price) / sum(open) AS avg_cost FROM o GROUP BY ticker HAVING sum(open) > 0),
s AS (SELECT pk, roe AS score, current_price, rsi_14, return_3m, volatility, CASE WHEN roe IS NOT NULL THEN rank() OVER (ORDER BY roe DESC NULLS LAST) END AS rank, count(*) OVER () AS n FROM xsection),
x AS (SELECT h.*, s.*, 100 * (1 - (rank - 1) / n) AS pct, shares * current_price AS mv, shares * avg_cost AS paid FROM h LEFT JOIN s ON h.pk = s.pk),
a AS (SELECT *, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN pct >= 80 THEN CASE WHEN rsi_14 > 75 THEN 'HOLD' ELSE 'BUY' END WHEN pct >= 50 THEN CASE WHEN return_3m < -0.15 THEN 'WATCH' ELSE 'HOLD' END WHEN coalesce(return_3m < -0.10, false) OR pct < 25 THEN 'REDUCE' ELSE 'WATCH' END AS advice FROM x),
b AS (SELECT *, 0.3 * greatest(0.02, least(0.10, (0.55 - 0.45 / 1.5) * 0.5)) + 0.7 * greatest(0.02, least(0.25, 1.0 / count(*) OVER ())) AS weight, sum(mv) OVER () AS total FROM a)
SELECT pk AS ticker, advice, round(mv, 4) AS market_value, round(mv - paid, 4) AS pnl, round((mv - paid) / paid, 6) AS pnl_share, round(CASE WHEN advice = 'BUY' THEN current_price - 2.5 * volatility * current_price / 20 END, 6) AS stop, round(weight, 6) AS weight, round(weight * total, 2) AS amount FROM b""", "xsection", "ledger")
def pf_21_recommendations(t: Tables):
    """Holdings by the rank of their return on equity; a twentieth of the yearly volatility stands for the true range."""
    rank = F.when(F.col("roe").isNotNull(), F.rank().over(Window.partitionBy("as_of").orderBy(F.col("roe").desc_nulls_last())))
    scored = t.xsection.select(F.col("pk").alias("ticker"), F.col("roe").alias("score"), rank.alias("rank"), "current_price", "rsi_14", "return_3m", (F.col("volatility") * F.col("current_price") / 20).alias("atr"))
    out = B.recommendations(L.holdings(t.ledger), scored)
    return out.select("ticker", "advice", F.round("market_value", 4).alias("market_value"), F.round("pnl", 4).alias("pnl"), r6("pnl_share"), r6("stop"), r6("weight"), F.round("amount", 2).alias("amount"))


@query("""WITH d AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT DISTINCT month FROM panel)), k AS (SELECT unnest(range(0, 60)) AS fold),
p AS (SELECT month, i, ticker, pred / 100000 AS x, actual AS y FROM panel JOIN d USING (month) WHERE pred IS NOT NULL AND actual IS NOT NULL),
f AS (SELECT fold, count(*) AS n_train, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p JOIN k ON i >= fold * 3 AND i < fold * 3 + 24 GROUP BY fold HAVING count(*) >= 100),
t AS (SELECT fold, n_train, month, ticker, x, y, b + a * x AS g FROM p JOIN f ON i >= fold * 3 + 24 AND i < fold * 3 + 27),
r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY g) + (count(*) OVER (PARTITION BY month, g) - 1) / 2.0 AS rg, rank() OVER (PARTITION BY month ORDER BY y) + (count(*) OVER (PARTITION BY month, y) - 1) / 2.0 AS ra FROM t),
m AS (SELECT fold, n_train, month, count(*) AS n, corr(rg, ra) AS ic, sum(CASE WHEN (g > 0) = (y > 0) THEN 1 ELSE 0 END) AS hits, avg(y) AS mean FROM r GROUP BY ALL),
e AS (SELECT *, exp(sum(ln(1 + mean)) OVER (PARTITION BY fold ORDER BY month)) AS equity FROM m), l AS (SELECT *, equity / max(equity) OVER (PARTITION BY fold ORDER BY month) - 1 AS lost FROM e),
z AS (SELECT fold, ticker, arg_max(g, month) AS g, arg_max(y, month) AS y FROM t GROUP BY fold, ticker), b AS (SELECT fold, avg(y) AS top_return FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(g, 12) DESC, ticker) AS place FROM z) WHERE place <= 10 GROUP BY fold)
SELECT fold::BIGINT AS fold, any_value(n_train) AS n_train, sum(n)::BIGINT AS n_test, round(avg(CASE WHEN n >= 5 THEN ic END), 6) AS ic, round(sum(hits) / sum(n), 6) AS hit_rate, round(any_value(top_return), 6) AS top_return, round(min(lost), 6) + 0.0 AS max_drawdown FROM l JOIN b USING (fold) GROUP BY fold HAVING sum(n) >= 10""", "panel")
def bt_23_rolling_fits(t: Tables):
    """Two years train, the next quarter tests, a quarter on."""
    out = R.rolling_backtest(t.panel.withColumn("pred", F.col("pred") / 100000), least_train=100)
    return out.select(F.col("fold").cast("long").alias("fold"), "n_train", "n_test", r6("ic"), r6("hit_rate"), r6("top_return"), r6("max_drawdown"))


def boosted(t: Tables):
    """Rows with features and outcome, and a boosted model of them as a function that adds guess."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = ["pred", "sector_id"]
    rows = t.panel.where("pred is not null").select("month", "ticker", F.col("pred").alias("pred"), F.col("sector_id").cast("double").alias("sector_id"), "actual")
    into = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTRegressor(labelCol="actual", predictionCol="guess", maxIter=5, maxDepth=3, seed=42).fit(into.transform(rows))
    return rows, names, lambda df: model.transform(into.transform(df))


@query(None)
def ml_16_permutation_importance(t: Tables):
    rows, names, predict = boosted(t)
    return R.permutation_importance(rows, predict, names, ["month", "ticker"]).select("feature", r6("importance"))


@query(None)
def ml_16_partial_dependence(t: Tables):
    rows, names, predict = boosted(t)
    return R.partial_dependence(rows, predict, names, "pred").select(r6("at"), r6("guess"))


@query(None)
def ml_15_meta_labels(t: Tables):
    """Buys are the series that rose most over 20 bars on a day; targets are triple-barrier labels."""
    x = t.bars.withColumn("momentum", F.round(S.returns("close", 20), 9)).withColumn("busy", ratio("volume", S.sma("volume", 20)))
    x = x.withColumn("rank", pct_rank("momentum", ["ts"]))
    out = R.meta_scores(x, G.triple_barrier(t.bars).select("ticker", "ts", "label"), ["momentum", "busy"], "1997-01-01", 2, months=12, trees=5)
    return out.select("fold", "ticker", "ts", "label", r6("probability"))


@query("""WITH x AS (SELECT user_id AS ticker, event_type AS headline, event_id AS id, CAST(ts AS DATE) AS day, time_bucket(INTERVAL 30 MINUTE, ts) AS poll, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker, poll ORDER BY ts DESC, id DESC) AS place FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY ticker, day, headline ORDER BY poll, place) AS k FROM n WHERE place <= 2) SELECT ticker, day, headline, poll, id FROM f WHERE k = 1""")
def stm_03_polled_news(t: Tables):
    return P.polled_once(t.events.select(F.col("user_id").alias("ticker"), F.col("event_type").alias("headline"), F.col("event_id").alias("id"), "ts"))


@query("""WITH g AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS good FROM events GROUP BY 1), m AS (SELECT max(ts) AS last FROM events),
q AS (SELECT user_id AS ticker, count(*) AS passes, max(ts) AS last_try FROM events JOIN g USING (user_id) WHERE event_type = 'error' AND (good IS NULL OR ts > good) GROUP BY 1)
SELECT ticker, passes, last_try, passes >= 5 AS exhausted FROM q, m WHERE datediff('day', CAST(last_try AS DATE), CAST(last AS DATE)) <= 7 AND ticker NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def stm_09_retry_queue(t: Tables):
    """Errors stand for failed and purchases for successful attempts, suppliers in debt for the blacklist."""
    tried = t.events.where(F.col("event_type").isin("error", "purchase")).select(F.col("user_id").alias("ticker"), "ts", (F.col("event_type") == "purchase").alias("ok"))
    last = t.events.agg(F.max("ts").alias("last"))  # one row
    banned = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("ticker"))
    return P.retry_queue(tried.crossJoin(F.broadcast(last)), banned, F.max("last"))


@query("""WITH d AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, avg(CASE WHEN value < 20 THEN value END) AS v FROM events GROUP BY 1, 2)
SELECT ticker, day, round(v, 6) AS value, round(last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW), 6) AS filled FROM d""")
def stm_13_older_rows_fill_gaps(t: Tables):
    d = t.events.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day")).agg(F.avg(F.when(F.col("value") < 20, F.col("value"))).alias("value"))
    return P.gaps_filled(d, "value").select("ticker", "day", r6("value"), r6("filled"))
