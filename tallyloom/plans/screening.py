"""Queries of candidate screening, portfolio values over time, further indicators and regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import ratio
from tallyloom.operators import candidates as K
from tallyloom.operators import fundamentals as A
from tallyloom.operators import indicators as N
from tallyloom.operators import text as X
from tallyloom.plans.cross_section import r6
from tallyloom.plans.fundamentals import MS
from tallyloom.plans.indicators import GL
from tallyloom.plans.registry import query
from tallyloom.plans.series import CH, GAIN, LOSS, W, ewm_sql, roll
from tallyloom.sources.catalog import Tables

q = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
pct = lambda c: f"(CASE WHEN abs({c}) < 2 THEN {c} * 100 ELSE {c} END)"


def points(*rules: tuple[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {p}e0" for cond, p in rules) + " ELSE 0e0 END"


TECH, FIN, PAYS = (f"coalesce(sector IN ({q(s)}), false)" for s in (K.TECH, K.FINANCIAL, K.PAYERS))
PE = "coalesce(pe_forward, pe_trailing)"
QUALITY = "round(greatest(0e0, least(100e0, 50e0 + " + " + ".join(
    [
        points((f"{pct('roe')} > 15", 8), (f"{pct('roe')} > 8", 4), (f"{pct('roe')} < 0", -10)),
        points((f"{pct('profit_margin')} > 15", 6), (f"{pct('profit_margin')} > 5", 3), (f"{pct('profit_margin')} < 0", -8)),
        points((f"{pct('gross_margin')} > 40", 5), (f"{pct('gross_margin')} > 20", 2), (f"{pct('gross_margin')} < 10 AND {TECH}", -6)),
        points((f"{pct('revenue_growth')} > 20", 8), (f"{pct('revenue_growth')} > 5", 4), (f"{pct('revenue_growth')} < -10", -8), (f"{pct('revenue_growth')} < 0", -4)),
        points((f"{pct('earnings_growth')} > 20", 5), (f"{pct('earnings_growth')} < -20", -5)),
        f"CASE WHEN {FIN} OR debt_to_equity IS NULL OR debt_to_equity < 0 THEN 0e0 ELSE {points(('debt_to_equity / 100 < 0.3', 5), ('debt_to_equity / 100 < 0.8', 2), ('debt_to_equity / 100 > 2.0', -8))} END",
        points(("free_cash_flow > 0", 7), ("free_cash_flow < 0", -6)),
        points(("recommendation_mean <= 2.0", 6), ("recommendation_mean <= 2.5", 3), ("recommendation_mean >= 4.0", -8)),
        f"CASE WHEN {PE} > 0 THEN CASE WHEN {TECH} THEN {points((f'{PE} > 60 AND coalesce({pct("revenue_growth")}, 0) < 15', -5))} ELSE {points((f'{PE} > 30', -3), (f'{PE} < 12', 4))} END ELSE 0e0 END",
        points(("price_to_book < 0", -10), (f"price_to_book > 8 AND NOT {TECH}", -3)),
        points((f"{pct('insider_pct')} > 20", 4), (f"{pct('insider_pct')} > 5", 2)),
        f"CASE WHEN {TECH} THEN {points((f'{pct("gross_margin")} > 60', 5))} WHEN {PAYS} THEN {points(('dividend_yield > 0', 4))} ELSE 0e0 END",
    ]
) + ")), 1)"


@query(f"SELECT ticker, {QUALITY} AS quality_score FROM smallcap", "smallcap")
def scr_32_quality_score(t: Tables):
    return t.exact("smallcap").select("ticker", K.quality_score().alias("quality_score"))


M_SCORES = MS[: MS.rindex("SELECT ticker, round(m, 5)")]
VERDICT = f"""{M_SCORES}, s AS (SELECT x.ticker, m, {QUALITY} AS q0, coalesce(CASE WHEN abs(shares_change_pct) < 2 THEN abs(shares_change_pct) * 100 ELSE abs(shares_change_pct) END, 0.0) AS dilution FROM smallcap x JOIN m ON m.ticker = x.ticker),
f AS (SELECT *, round(greatest(0.0, greatest(0.0, q0 - CASE WHEN m > -1.00 THEN 30 WHEN m > -1.78 THEN 15 ELSE 0 END) - CASE WHEN dilution > 30 THEN 25 WHEN dilution > 15 THEN 12 ELSE 0 END), 1) AS score, coalesce(m > -1.78, false) OR dilution > 15 AS flagged FROM s),
v AS (SELECT *, CASE WHEN score >= 65 AND NOT flagged THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'SPECULATIVE' END AS tier FROM f)
SELECT ticker, score AS quality_score, round(dilution, 6) AS dilution_pct, coalesce(m > -1.00, false) OR dilution > 30 AS excluded, tier,
  round(CASE WHEN m > -1.00 THEN -0.35 WHEN m > -1.78 THEN -0.20 ELSE 0.0 END + CASE WHEN dilution > 30 THEN -0.20 WHEN dilution > 15 THEN -0.10 ELSE 0.0 END + CASE tier WHEN 'HIGH' THEN 0.15 WHEN 'SPECULATIVE' THEN -0.20 ELSE 0.0 END, 3)::DOUBLE AS confidence_delta FROM v"""


@query(VERDICT, "smallcap")
def scr_34_candidate_verdict(t: Tables):
    return K.verdicts(A.m_score(t.exact("smallcap"))).select("ticker", "quality_score", r6("dilution_pct"), "excluded", "tier", "confidence_delta")


BOOST = [(3.0, 0.15), (1.5, 0.10), (0.5, 0.05)]
NEWS = f"""WITH w AS (SELECT source, CASE WHEN length(trim(coalesce(text, ''))) < 5 THEN []::VARCHAR[] ELSE list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+')) END AS ws FROM documents),
s AS (SELECT source, len(list_intersect(ws, [{q(X.POSITIVE)}])) AS p, len(list_intersect(ws, [{q(X.NEGATIVE)}])) AS n FROM w),
a AS (SELECT source, CASE WHEN p + n > 0 THEN (p - n) * 1.0 / (p + n) ELSE 0.0 END AS s FROM s),
g AS (SELECT source, count(*) AS articles, avg(s) AS mean, count(*) FILTER (s > 0.1) AS good, count(*) FILTER (s < -0.1) AS bad FROM a GROUP BY source)
SELECT source, articles, round(mean, 3) AS mean_sentiment, good, bad, round(articles * greatest(mean, 0.0), 2) AS signal, CASE {' '.join(f'WHEN articles * greatest(mean, 0.0) > {a} THEN {b}' for a, b in BOOST)} ELSE 0.0 END::DOUBLE AS boost FROM g"""


@query(NEWS)
def agg_08_news_sentiment(t: Tables):
    s = t.documents.select("source", X.sentiment("text").alias("s"))
    g = s.groupBy("source").agg(F.count("*").alias("articles"), F.avg("s").alias("mean"), F.count_if(F.col("s") > 0.1).alias("good"), F.count_if(F.col("s") < -0.1).alias("bad"))
    signal, boost = F.col("articles") * F.greatest("mean", F.lit(0.0)), F.lit(0.0)
    for least, gain in reversed(BOOST):
        boost = F.when(signal > least, gain).otherwise(boost)
    return g.select("source", "articles", F.round("mean", 3).alias("mean_sentiment"), "good", "bad", F.round(signal, 2).alias("signal"), boost.alias("boost"))


# --- indicators ------------------------------------------------------------------------------------------------------


@query(f"WITH {CH}, gl AS (SELECT *, CASE WHEN change IS NULL THEN NULL ELSE greatest(change, 0) END AS gain, CASE WHEN change IS NULL THEN NULL ELSE greatest(-change, 0) END AS loss FROM ch), m AS (SELECT ticker, ts, {GAIN} AS g, {LOSS} AS l FROM gl) SELECT ticker, ts, round(CASE WHEN l = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END, 5) AS rsi FROM m", "bars")
def win_06_rsi_guarded(t: Tables):
    """As WIN-05, but 0 without any fall in the window."""
    gain, loss = (S.full(F.avg(F.greatest(sign * F.col("change"), F.lit(0.0))), "change", 14) for sign in (F.lit(1), F.lit(-1)))
    return S.with_changes(t.bars).select("ticker", "ts", F.round(F.when(loss == 0, 0.0).otherwise(100 - 100 / (1 + ratio(gain, loss))), 5).alias("rsi"))


LAGS = [2, 4, 8, 16, 32]
HURST = f"""WITH n AS (SELECT ticker, ln(close) AS x, row_number() OVER ({W}) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
c AS (SELECT n.*, lag, k // lag AS chunk FROM n, (SELECT unnest({LAGS}) AS lag) l WHERE lag < n AND (k // lag) * lag < n - lag AND n >= 60),
d AS (SELECT *, x - avg(x) OVER (PARTITION BY ticker, lag, chunk) AS dev FROM c),
e AS (SELECT *, sum(dev) OVER (PARTITION BY ticker, lag, chunk ORDER BY k) AS run FROM d),
r AS (SELECT ticker, lag, chunk, (max(run) - min(run)) / stddev_pop(x) AS rs FROM e GROUP BY ticker, lag, chunk HAVING stddev_pop(x) > 1e-10),
m AS (SELECT ticker, lag, avg(rs) AS rs FROM r GROUP BY ticker, lag)
SELECT ticker, CASE WHEN count(*) >= 3 THEN round(greatest(0.0, least(1.0, regr_slope(ln(rs), ln(lag)))), 5) END AS hurst FROM m GROUP BY ticker"""


@query(HURST, "bars")
def win_21_hurst(t: Tables):
    """Rescaled ranges over chunks of each lag; the slope of their logarithms."""
    n = t.bars.select("ticker", F.ln("close").alias("x"), (F.row_number().over(S.ordered()) - 1).alias("k"), F.count("*").over(Window.partitionBy("ticker")).alias("n")).where("n >= 60")
    c = n.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in LAGS]))).withColumn("chunk", F.floor(F.col("k") / F.col("lag"))).where("lag < n and chunk * lag < n - lag")
    by = Window.partitionBy("ticker", "lag", "chunk")
    run = F.sum("dev").over(by.orderBy("k"))
    d = c.withColumn("dev", F.col("x") - F.avg("x").over(by)).withColumn("run", run)
    r = d.groupBy("ticker", "lag", "chunk").agg((F.max("run") - F.min("run")).alias("wide"), F.stddev_pop("x").alias("s")).where("s > 1e-10")
    m = r.groupBy("ticker", "lag").agg(F.avg(F.col("wide") / F.col("s")).alias("rs"))
    slope = F.regr_slope(F.ln("rs"), F.ln("lag"))
    return m.groupBy("ticker").agg(F.when(F.count("*") >= 3, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), slope)), 5)).alias("hurst"))


KLINGER = f"""WITH RECURSIVE v AS (SELECT ticker, ts, volume, CASE WHEN close > lag(close) OVER ({W}) THEN volume WHEN close < lag(close) OVER ({W}) THEN -volume ELSE 0 END AS force FROM bars),
n AS (SELECT *, row_number() OVER ({W}) AS k, {roll('avg', 'volume', 20)} AS mean FROM v), {ewm_sql('e34', 'force', 2 / 35)}, {ewm_sql('e55', 'force', 2 / 56)}
SELECT n.ticker, n.ts, round((e34.y - e55.y) / mean, 4) AS klinger FROM n JOIN e34 USING (ticker, k) JOIN e55 USING (ticker, k) WHERE k >= 56"""


@query(KLINGER, "bars")
def win_22_klinger(t: Tables):
    before = F.lag("close").over(S.ordered())
    force = F.when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0)
    x = t.bars.withColumn("force", force).withColumn("mean", S.sma("volume", 20)).withColumn("k", F.row_number().over(S.ordered()))
    e = S.ewm(x, "force", {"e34": 2 / 35, "e55": 2 / 56}).where("k >= 56")
    return e.select("ticker", "ts", F.round(ratio(F.col("e34") - F.col("e55"), "mean"), 4).alias("klinger"))


DIVERGENCE = f"""WITH RECURSIVE {CH}, {GL}, {ewm_sql('eu', 'up', 1 / 14)}, {ewm_sql('ed', 'down', 1 / 14)},
s AS (SELECT n.ticker, n.ts, CASE WHEN ed.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + eu.y / ed.y) END AS rsi FROM n JOIN eu USING (ticker, k) JOIN ed USING (ticker, k)),
j AS (SELECT s.ticker, s.ts, rsi, close, row_number() OVER (PARTITION BY s.ticker ORDER BY s.ts) AS k FROM s JOIN bars b ON b.ticker = s.ticker AND b.ts = s.ts)
SELECT ticker, ts, round((rsi - lag(rsi, 14) OVER ({W})) / 100 - (close / lag(close, 14) OVER ({W}) - 1), 5) AS divergence FROM j"""


@query(DIVERGENCE, "bars")
def win_24_rsi_divergence(t: Tables):
    x = N.rsi_ewm(t.bars).select("ticker", "ts", "rsi", "close")
    d = (F.col("rsi") - F.lag("rsi", 14).over(S.ordered())) / 100 - (ratio("close", F.lag("close", 14).over(S.ordered())) - 1)
    return x.select("ticker", "ts", F.round(d, 5).alias("divergence"))


LAST = "row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back"
RETURNS = {"return_1m": 21, "return_3m": 63, "return_6m": 126, "return_12m": 252}
FEATURES = f"""WITH {CH}, f AS (SELECT ticker, ts, close, {', '.join(f'round((close / lag(close, {n}) OVER ({W}) - 1) * 100, 2) AS {c}' for c, n in RETURNS.items())},
  close / max(high) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS from_high, stddev_samp(r) OVER ({W}) * sqrt(252) AS volatility,
  close / nullif({roll('avg', 'close', 50)}, 0) - 1 AS vs50, close / nullif({roll('avg', 'close', 200)}, 0) - 1 AS vs200, volume / nullif({roll('avg', 'volume', 20)}, 0) AS volume_ratio,
  {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd, {LAST} FROM ch)
SELECT ticker, ts, round(close, 6) AS close, {', '.join(RETURNS)}, round(from_high, 6) AS from_high, round(volatility, 5) AS volatility, round(vs50, 6) AS vs50, round(vs200, 6) AS vs200, round(volume_ratio, 6) AS volume_ratio,
  round((close - (mid - 2 * sd)) / nullif(4 * sd, 0), 5) AS band_position FROM f WHERE back = 1"""


@query(FEATURES, "bars")
def win_37_feature_row(t: Tables):
    """The newest row of each series with returns, distance from highs and means, volatility, volume and band position."""
    w = S.ordered()
    x = S.with_changes(t.bars).select(
        "ticker",
        "ts",
        "close",
        *[F.round(S.returns("close", n) * 100, 2).alias(c) for c, n in RETURNS.items()],
        (ratio("close", F.max("high").over(S.last_n(252))) - 1).alias("from_high"),
        (F.stddev_samp("r").over(w) * F.sqrt(F.lit(252))).alias("volatility"),
        *[(ratio("close", S.sma("close", n)) - 1).alias(f"vs{n}") for n in (50, 200)],
        ratio("volume", S.sma("volume", 20)).alias("volume_ratio"),
        S.sma("close", 20).alias("mid"),
        S.rolling_std("close", 20).alias("sd"),
        F.lead("ts").over(w).alias("next"),
    ).where("next is null")
    band = ratio(F.col("close") - (F.col("mid") - 2 * F.col("sd")), 4 * F.col("sd"))
    return x.select("ticker", "ts", r6("close"), *RETURNS, r6("from_high"), F.round("volatility", 5).alias("volatility"), r6("vs50"), r6("vs200"), r6("volume_ratio"), F.round(band, 5).alias("band_position"))


@query(f"WITH p AS (SELECT a.ts, a.close AS x, (SELECT b.close FROM bars b WHERE b.ticker = '2-HIGH' AND b.ts <= a.ts ORDER BY b.ts DESC LIMIT 1) AS y, a.ticker FROM bars a WHERE a.ticker = '1-URGENT'), z AS (SELECT ticker, ts, x / y AS ratio FROM p) SELECT ts, round(ratio, 6) AS ratio, round({roll('avg', 'ratio', 60)}, 6) AS mean60 FROM z", "bars")
def jn_17_breadth_ratio(t: Tables):
    """One series over another, the other's newest value carried on to the first one's dates."""
    mine, other = (t.bars.where(F.col("ticker") == n).select(F.lit("pair").alias("ticker"), "ts", F.col("close").alias(c)) for n, c in (("1-URGENT", "mine"), ("2-HIGH", "other")))
    joined = S.asof_backward(mine, other, "ticker", "ts", "other").join(mine, ["ticker", "ts"])
    z = joined.withColumn("ratio", ratio("mine", "other"))
    return z.select("ts", r6("ratio"), r6(S.sma("ratio", 60), "mean60"))


# --- portfolios over time --------------------------------------------------------------------------------------------

HOLDINGS = "h AS (SELECT ticker, CAST(10 + length(ticker) AS DOUBLE) AS shares, CAST(min(ts) + length(ticker) * INTERVAL '30' DAY AS DATE) AS bought, min(low) AS cost FROM bars GROUP BY ticker)"


def holdings(t: Tables) -> DataFrame:
    """A holding of each series: shares, the day it was bought and what a share cost."""
    return t.bars.groupBy("ticker").agg(F.min("ts").alias("first"), F.min("low").alias("cost")).select("ticker", (F.length("ticker") + 10).cast("double").alias("shares"), F.date_add("first", F.length("ticker") * 30).alias("bought"), "cost")


VALUE = f"""WITH {HOLDINGS}, d AS (SELECT DISTINCT ts FROM bars),
g AS (SELECT d.ts, h.shares * (SELECT b.close FROM bars b WHERE b.ticker = h.ticker AND b.ts <= d.ts ORDER BY b.ts DESC LIMIT 1) AS v FROM d, h WHERE d.ts >= h.bought)
SELECT ts, round(sum(v), 4) AS value FROM g GROUP BY ts HAVING sum(v) > 0"""


@query(VALUE, "bars")
def win_34_portfolio_value(t: Tables):
    """Value of all holdings on each date, each from the day it was bought, prices carried on.

    A holding's value changes at its bars alone, so the portfolio is the running sum of these changes; no grid is built.
    """
    b = t.bars.join(holdings(t), "ticker").withColumn("at", F.greatest("ts", "bought"))
    newest = b.groupBy("ticker", "at").agg(F.max_by(F.col("close") * F.col("shares"), "ts").alias("v"))
    change = newest.select("at", (F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy("ticker").orderBy("at")), F.lit(0.0))).alias("change"))
    dates = t.bars.select(F.col("ts").alias("at"), F.lit(0.0).alias("change"), F.lit(1).alias("listed"))
    days = change.withColumn("listed", F.lit(0)).unionByName(dates).groupBy("at").agg(F.sum("change").alias("change"), F.max("listed").alias("listed"), F.lit("all").alias("portfolio"))
    run = F.sum("change").over(Window.partitionBy("portfolio").orderBy("at"))
    return days.withColumn("value", run).where("listed = 1 and value > 1e-6").select(F.col("at").alias("ts"), F.round("value", 4).alias("value"))


PERIODS = {"1D": "today - INTERVAL '1' DAY", "1W": "today - INTERVAL '7' DAY", "1M": "today - INTERVAL '1' MONTH", "3M": "today - INTERVAL '3' MONTH", "YTD": "date_trunc('year', today)", "1Y": "today - INTERVAL '1' YEAR"}
PERIOD_RETURNS = f"""WITH {HOLDINGS}, m AS (SELECT max(ts) AS today FROM bars),
c AS ({' UNION ALL '.join(f"SELECT '{p}' AS period, CAST({e} AS DATE) AS cut FROM m" for p, e in PERIODS.items())}),
a AS (SELECT period, cut, (SELECT min(ts) FROM bars WHERE ts >= cut) AS at FROM c),
v AS (SELECT period, h.ticker, h.shares * CASE WHEN h.bought > cut THEN h.cost ELSE (SELECT b.close FROM bars b WHERE b.ticker = h.ticker AND b.ts = a.at) END AS was, h.shares * (SELECT b.close FROM bars b WHERE b.ticker = h.ticker ORDER BY b.ts DESC LIMIT 1) AS now FROM a, h)
SELECT period, round(sum(now) - sum(was), 2) AS change, round((sum(now) - sum(was)) / sum(was) * 100, 4) AS pct FROM v GROUP BY period HAVING sum(was) > 0"""


@query(PERIOD_RETURNS, "bars")
def win_35_period_returns(t: Tables):
    """Change of the portfolio since the first listed day of each period; holdings bought later count at their cost."""
    today = t.bars.agg(F.max("ts").alias("today"))
    cuts = today.select(F.inline(F.array(*[F.struct(F.lit(p).alias("period"), F.expr(f"CAST({e} AS DATE)").alias("cut")) for p, e in PERIODS.items()])))
    # six cuts: the first listed day of each by an ordered fold over days, then joins by ticker and day
    days = t.bars.select("ts").distinct().crossJoin(F.broadcast(cuts)).where("ts >= cut").groupBy("period", "cut").agg(F.min("ts").alias("ts"))
    h, now = holdings(t), t.bars.groupBy("ticker").agg(F.max_by("close", "ts").alias("now"))
    each = h.join(now, "ticker").crossJoin(F.broadcast(days)).join(t.bars.select("ticker", "ts", "close"), ["ticker", "ts"], "left")
    was = F.sum(F.col("shares") * F.when(F.col("bought") > F.col("cut"), F.col("cost")).otherwise(F.col("close")))
    v = each.groupBy("period").agg(was.alias("was"), F.sum(F.col("shares") * F.col("now")).alias("now")).where("was > 0")
    return v.select("period", F.round(F.col("now") - F.col("was"), 2).alias("change"), F.round(ratio(F.col("now") - F.col("was"), "was") * 100, 4).alias("pct"))


BENCH = f"""WITH y AS (SELECT *, {LAST}, count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT *, max(ts) OVER (PARTITION BY ticker) AS today FROM bars) WHERE ts > today - INTERVAL '1' YEAR)
SELECT ticker, round((max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = 2 THEN close END) - 1) * 100, 2) AS change_1d, round((max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = 22 THEN close END) - 1) * 100, 2) AS change_1m,
  round((max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = n THEN close END) - 1) * 100, 2) AS change_ytd FROM y GROUP BY ticker HAVING count(*) >= 2"""


@query(BENCH, "bars")
def win_36_benchmark_change(t: Tables):
    """Change of the newest close to the one before, to that of 21 bars before and to the first of a year."""
    x = t.bars.withColumn("today", F.max("ts").over(Window.partitionBy("ticker"))).where("ts > today - INTERVAL '1' YEAR")
    x = x.withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc())))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    to = lambda base, name: F.round((ratio(at(1), base) - 1) * 100, 2).alias(name)
    return x.groupBy("ticker").agg(F.count("*").alias("n"), to(at(2), "change_1d"), to(at(22), "change_1m"), to(F.min_by("close", "ts"), "change_ytd")).where("n >= 2").drop("n")


FACTORS = ["market", "smb", "hml", "wml"]


def factor_regression(df: DataFrame, key: str = "ticker", y: str = "r", least: int = 30) -> DataFrame:
    """Least squares of y on FACTORS for each key: yearly alpha, betas, r_squared, yearly residual volatility, n_obs.

    Only the sums of products are gathered: a row of numbers for each key, whatever the length of its series.
    """
    names = ["one", *FACTORS]
    x = df.withColumn("one", F.lit(1.0)).where(" and ".join(f"{c} is not null" for c in [y, *FACTORS]))
    pairs = [(a, b) for k, a in enumerate([*names, y]) for b in [*names, y][k:]]
    sums = x.groupBy(key).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).where(F.col("one_one") >= least)
    kind = f"{key} string, alpha double, " + ", ".join(f"{f}_beta double" for f in FACTORS) + ", r_squared double, residual_vol double, n_obs long"

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                v = r._asdict()
                at = lambda a, b, v=v: v.get(f"{a}_{b}", v.get(f"{b}_{a}"))
                gram, right = np.array([[at(a, b) for b in names] for a in names]), np.array([at(a, y) for a in names])
                beta, n = np.linalg.lstsq(gram, right, rcond=None)[0], gram[0, 0]
                left = max(0.0, v[f"{y}_{y}"] - beta @ right)
                around = v[f"{y}_{y}"] - right[0] ** 2 / n
                rows.append((v[key], beta[0] * 252, *beta[1:], 1 - left / around if around else 0.0, np.sqrt(left / n) * np.sqrt(252), int(n)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return sums.mapInPandas(solve, kind)


@query()
def bt_08_factor_regression(t: Tables):
    """Each series against four factors built from the others: all, and three spreads of two series (0 on days without a bar)."""
    r = S.with_changes(t.bars).where("r is not null").select("ticker", "ts", "r")
    one = lambda name: F.coalesce(F.max(F.when(F.col("ticker") == name, F.col("r"))), F.lit(0.0))
    spread = lambda a, b: one(a) - one(b)
    f = r.groupBy("ts").agg(F.avg("r").alias("market"), spread("5-LOW", "1-URGENT").alias("smb"), spread("4-NOT SPECIFIED", "2-HIGH").alias("hml"), spread("3-MEDIUM", "1-URGENT").alias("wml"))
    return factor_regression(r.join(f, "ts"))


# --- validation ------------------------------------------------------------------------------------------------------

SPLITS, PURGE, EMBARGO = 6, 30, 0.01
PURGED = f"""WITH n AS (SELECT sector_id, row_number() OVER (PARTITION BY sector_id ORDER BY month, ticker) - 1 AS k, count(*) OVER (PARTITION BY sector_id) AS n FROM panel),
f AS (SELECT DISTINCT sector_id, n, fold, fold * (n // {SPLITS}) AS a, CASE WHEN fold < {SPLITS - 1} THEN (fold + 1) * (n // {SPLITS}) ELSE n END AS b FROM n, (SELECT unnest(range({SPLITS})) AS fold) WHERE n >= 200),
s AS (SELECT f.sector_id, fold, count(*) FILTER (k >= a AND k < b) AS test_rows, count(*) FILTER (k < greatest(0, a - {PURGE}) OR k >= least(f.n, b + greatest(1, CAST(floor(f.n * {EMBARGO}) AS BIGINT)))) AS train_rows,
  count(*) FILTER (k >= greatest(0, a - {PURGE}) AND k < a) AS purged, count(*) FILTER (k >= b AND k < least(f.n, b + greatest(1, CAST(floor(f.n * {EMBARGO}) AS BIGINT)))) AS embargoed FROM f JOIN n ON n.sector_id = f.sector_id GROUP BY f.sector_id, fold)
SELECT sector_id::BIGINT AS sector_id, fold::BIGINT AS fold, test_rows, train_rows, purged, embargoed FROM s WHERE train_rows >= 100 AND test_rows >= 20"""


@query(PURGED, "panel")
def ml_07_purged_folds(t: Tables):
    """Rows of each sector in order of time, dealt to folds: test, purged before it, embargoed after it, or training."""
    w = Window.partitionBy("sector_id")
    n = t.panel.select("sector_id", (F.row_number().over(w.orderBy("month", "ticker")) - 1).alias("k"), F.count("*").over(w).alias("n")).where("n >= 200")
    x = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))).withColumn("size", F.floor(F.col("n") / SPLITS))
    x = x.withColumn("a", F.col("fold") * F.col("size")).withColumn("b", F.when(F.col("fold") < SPLITS - 1, F.col("a") + F.col("size")).otherwise(F.col("n")))
    x = x.withColumn("p", F.greatest(F.lit(0), F.col("a") - PURGE)).withColumn("e", F.least("n", F.col("b") + F.greatest(F.lit(1), F.floor(F.col("n") * EMBARGO))))
    k = F.col("k")
    out = x.groupBy(F.col("sector_id").cast("long").alias("sector_id"), F.col("fold").cast("long").alias("fold")).agg(
        F.count_if((k >= F.col("a")) & (k < F.col("b"))).alias("test_rows"),
        F.count_if((k < F.col("p")) | (k >= F.col("e"))).alias("train_rows"),
        F.count_if((k >= F.col("p")) & (k < F.col("a"))).alias("purged"),
        F.count_if((k >= F.col("b")) & (k < F.col("e"))).alias("embargoed"),
    )
    return out.where("train_rows >= 100 and test_rows >= 20")


TRAIN, TEST, STEP = 24, 6, 6
FORWARD = f"""WITH d AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS k FROM (SELECT DISTINCT month FROM panel)),
x AS (SELECT p.month, p.ticker, p.pred, p.actual, d.k, (d.k - {TRAIN}) // {STEP} AS fold FROM panel p JOIN d ON d.month = p.month WHERE d.k >= {TRAIN}),
r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY pred) + (count(*) OVER (PARTITION BY month, pred) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY month ORDER BY actual) + (count(*) OVER (PARTITION BY month, actual) - 1) / 2.0 AS ra,
  avg(pred) OVER (PARTITION BY month) AS mp, avg(actual) OVER (PARTITION BY month) AS ma, row_number() OVER (PARTITION BY month ORDER BY pred DESC, ticker) AS top FROM x),
m AS (SELECT fold, month, CASE WHEN count(*) >= 5 THEN corr(rp, ra) END AS ic, avg(CASE WHEN sign(pred - mp) = sign(actual - ma) THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN top <= 10 THEN actual END) AS best, avg(actual) AS mean FROM r GROUP BY fold, month)
SELECT fold::BIGINT AS fold, count(*) AS months, round(avg(ic), 5) AS mean_ic, round(avg(hit), 5) AS hit_rate, round(avg(best), 6) AS top10, round(avg(best - mean), 6) AS spread FROM m GROUP BY fold"""


@query(FORWARD, "panel")
def ml_17_walk_forward_by_date(t: Tables):
    """Folds of six months after a training span of two years: rank correlation, hit rate, mean of the best ten, their spread."""
    months = t.panel.select("month").distinct().withColumn("all", F.lit(1)).withColumn("k", F.row_number().over(Window.partitionBy("all").orderBy("month")) - 1).drop("all")
    x = t.panel.join(F.broadcast(months), "month").where(F.col("k") >= TRAIN).withColumn("fold", F.floor((F.col("k") - TRAIN) / STEP))
    m = Window.partitionBy("month")
    mean_rank = lambda c: F.rank().over(m.orderBy(c)) + (F.count("*").over(Window.partitionBy("month", c)) - 1) / 2
    r = x.withColumns({"rp": mean_rank("pred"), "ra": mean_rank("actual"), "mp": F.avg("pred").over(m), "ma": F.avg("actual").over(m), "top": F.row_number().over(m.orderBy(F.col("pred").desc(), "ticker"))})
    same = F.signum(F.col("pred") - F.col("mp")) == F.signum(F.col("actual") - F.col("ma"))
    each = r.groupBy("fold", "month").agg(F.when(F.count("*") >= 5, F.corr("rp", "ra")).alias("ic"), F.avg(same.cast("int")).alias("hit"), F.avg(F.when(F.col("top") <= 10, F.col("actual"))).alias("best"), F.avg("actual").alias("mean"))
    return each.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("months"), F.round(F.avg("ic"), 5).alias("mean_ic"), F.round(F.avg("hit"), 5).alias("hit_rate"), r6(F.avg("best"), "top10"), r6(F.avg(F.col("best") - F.col("mean")), "spread"))


# --- names -----------------------------------------------------------------------------------------------------------

MAPPINGS = [("id", ["customer_id", "c_custkey"]), ("name", ["c_name", "c_custkey"]), ("balance", ["c_acctbal", "balance", "c_name"])]


def first_mapping(df: DataFrame, mappings: list[tuple[str, list[str]]]) -> DataFrame:
    """df by new names: each takes the first of its candidates that is there and not taken yet; names without one are left out."""
    taken: set[str] = set()
    chosen = []
    for name, candidates in mappings:
        found = next((c for c in candidates if c in df.columns and c not in taken), None)
        if found:
            taken.add(found)
            chosen.append(F.col(f"`{found}`").alias(name))
    return df.select(*chosen)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def set_07_first_mapping(t: Tables):
    return first_mapping(t.customer, MAPPINGS)
