"""Queries over one-shot alerts, bounded signals, position sizes, ranked composites and sector states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import clip, ratio
from tallyloom.operators import cleaning as C
from tallyloom.operators import indicators as N
from tallyloom.operators import signals as X
from tallyloom.plans.cross_section import r6
from tallyloom.plans.indicators import STATE
from tallyloom.plans.registry import query
from tallyloom.plans.series import W
from tallyloom.sources.catalog import SECTORS, Tables

#: condition and target of the alerts that every name has
ALERTS = [("above", 2000.0), ("below", 800.0), ("crosses_ma50", None), ("rsi_above_70", None), ("rsi_below_30", None), ("change_pct", 60.0)]
MET = """CASE condition WHEN 'above' THEN close >= target WHEN 'below' THEN close <= target WHEN 'crosses_ma50' THEN ma > -0.01 AND ma < 0.01
  WHEN 'rsi_above_70' THEN rsi_14 > 70 WHEN 'rsi_below_30' THEN rsi_14 < 30 WHEN 'change_pct' THEN abs(change) >= target END"""
SW = "PARTITION BY ticker ORDER BY snapshot_date"


@query(f"""WITH k AS (SELECT ticker, snapshot_date, close, rsi_14, (close / lag(close) OVER ({SW}) - 1) * 100 AS change, close / avg(close) OVER ({SW} ROWS 4 PRECEDING) - 1 AS ma FROM snapshots),
a AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {'NULL' if v is None else v}::DOUBLE)" for c, v in ALERTS)}) v(condition, target)),
f AS (SELECT concat(ticker, '/', condition) AS alert_id, snapshot_date, close FROM k, a WHERE {MET})
SELECT alert_id, min(snapshot_date) AS triggered_at, round(arg_min(close, snapshot_date), 6) AS triggered_price FROM f GROUP BY alert_id""", "snapshots")
def stm_06_one_shot_alerts(t: Tables):
    """Every alert fires at most once, at the first snapshot that meets it."""
    w = Window.partitionBy("ticker").orderBy("snapshot_date")
    ticks = t.snapshots.select(
        "ticker", "snapshot_date", "close", "rsi_14", ((ratio("close", F.lag("close").over(w)) - 1) * 100).alias("change_pct"),
        (ratio("close", F.avg("close").over(w.rowsBetween(-4, 0))) - 1).alias("price_vs_ma50"),
        *[F.lit(None).cast("double").alias(c) for c in ("price_vs_ma200", "volume", "avg_volume")],
    )
    kinds = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(v).cast("double").alias("target")) for c, v in ALERTS])
    alerts = t.snapshots.select("ticker").distinct().select("ticker", F.inline(kinds)).withColumn("alert_id", F.concat_ws("/", "ticker", "condition"))
    return X.one_shot(alerts, ticks, "snapshot_date").withColumn("triggered_price", F.round("triggered_price", 6))


@query("""WITH d AS (SELECT max(CAST(l_shipdate AS DATE)) AS last FROM lineitem), i AS (SELECT l_partkey AS pk, sum(CASE WHEN l_returnflag = 'N' AND CAST(l_shipdate AS DATE) >= last - 90 THEN l_quantity ELSE 0 END) AS b,
  sum(CASE WHEN l_returnflag = 'R' AND CAST(l_shipdate AS DATE) >= last - 90 THEN l_quantity ELSE 0 END) AS s FROM lineitem, d GROUP BY 1)
SELECT ticker, round(CASE WHEN b + s > 0 THEN 0.5 + 0.35 * (b - s) / (b + s) ELSE 0.5 END, 6) AS insider, round(CASE WHEN x IS NULL THEN 0.5 ELSE greatest(0.1, least(0.9, CASE WHEN x < 3 THEN 0.5 + (3 - x) / 3 * 0.4 WHEN x > 15 THEN 0.5 - (x - 15) / 15 * 0.4 ELSE 0.5 - (x - 3) / 12 * 0.2 END)) END, 6) AS short_interest
FROM (SELECT *, short_pct_float * 100 AS x FROM xsection) LEFT JOIN i USING (pk)""", "xsection")
def scr_43_insider_and_short(t: Tables):
    """Sales of flag A stand for planned ones, which don't count."""
    said = F.when(F.col("l_returnflag") == "R", "Sale").when(F.col("l_returnflag") == "A", "Sale (Automatic)").otherwise("Purchase")
    trades = t.lineitem.select(F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("day"), said.alias("text"), F.col("l_quantity").alias("shares"))
    last = trades.agg(F.max("day").alias("last"))  # one row
    insider = X.insider_signal(trades.crossJoin(F.broadcast(last)), F.col("last")).withColumnRenamed("ticker", "pk")
    x = t.xsection.join(insider, "pk", "left")
    return x.select("ticker", r6(F.coalesce("insider", F.lit(0.5)), "insider"), r6(X.short_interest_signal(F.col("short_pct_float") * 100), "short_interest"))


CAPITAL = 100_000.0
HALF = "greatest(0.01, least(0.25, (w - (1 - w) / 1.5) * 0.5))"
BOUGHT = "greatest(1, floor(round({} * 100000 / current_price, 6)))::BIGINT"


@query(f"""SELECT ticker, round({HALF}, 6) AS half_kelly, {BOUGHT.format(HALF)} AS kelly_shares, greatest(1, floor(round(1000 / (current_price * coalesce(nullif(volatility, 0), 0.02)), 6)))::BIGINT AS risk_shares,
{BOUGHT.format('0.1')} AS fixed_shares, {BOUGHT.format('0.05')} AS equal_shares FROM (SELECT *, piotroski_f / 10.0 AS w FROM xsection)""", "xsection")
def bt_14_sizing_rules(t: Tables):
    """Shares by half-Kelly (a tenth of the F-score as rate of wins), volatility, a tenth of the capital, and one in twenty."""
    half, price = X.kelly_fraction(F.col("piotroski_f") / 10, F.lit(1.5)), F.col("current_price")
    bought = lambda f: X.shares_for(f, price, CAPITAL)
    return t.xsection.select("ticker", r6(half, "half_kelly"), bought(half).alias("kelly_shares"), X.shares_by_risk(price, "volatility", CAPITAL).alias("risk_shares"), bought(F.lit(0.1)).alias("fixed_shares"), bought(F.lit(0.05)).alias("equal_shares"))


def window_rank(c: str) -> str:
    return f"CASE WHEN a.{c} IS NOT NULL AND count(b.{c}) >= 20 THEN (count(CASE WHEN b.{c} < a.{c} THEN 1 END) + (count(CASE WHEN b.{c} = a.{c} THEN 1 END) + 1) / 2.0) / count(b.{c}) END AS {c}_rank"


@query(f"""WITH m AS (SELECT ticker, ts, round(close / lag(close, 20) OVER ({W}) - 1, 9) AS momentum, volume, row_number() OVER ({W}) AS k FROM bars),
r AS (SELECT a.ticker, a.ts, {window_rank('momentum')}, {window_rank('volume')} FROM m a JOIN m b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 251 AND a.k GROUP BY a.ticker, a.ts, a.k, a.momentum, a.volume),
s AS (SELECT ticker, ts, round(0.6::DOUBLE * coalesce(momentum_rank, 0.5) + 0.4::DOUBLE * coalesce(volume_rank, 0.5), 9) AS score FROM r),
h AS (SELECT *, CASE WHEN count(score) OVER w >= 20 THEN round(quantile_cont(score, 0.6) OVER w, 9) END AS high FROM s WINDOW w AS ({W} ROWS 251 PRECEDING))
SELECT ticker, ts, round(score, 6) AS score, (CASE WHEN score < round(1 - coalesce(high, 0.4), 9) THEN -1 WHEN score > high THEN 1 ELSE 0 END)::BIGINT AS signal FROM h""", "bars")
def str_14_ranked_composite(t: Tables):
    x = t.bars.withColumn("momentum", F.round(S.returns("close", 20), 9))
    return X.factor_composite(x, {"momentum": 0.6, "volume": 0.4}).select("ticker", "ts", r6("score"), "signal")


#: the series that stands for each sector
PROXIES = {s: ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")[k % 5] for k, s in enumerate(SECTORS)}
POINTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.STATE_POINTS.items())


@query(f"""WITH st AS ({STATE}), p AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{b}')" for s, b in PROXIES.items())}) v(sector, proxy)),
x AS (SELECT x.ticker, coalesce(st.state, 'NEUTRAL') AS state, greatest(0.0, least(100.0, roe * 200 + CASE coalesce(st.state, 'NEUTRAL') {POINTS} END)) AS adjusted FROM xsection x LEFT JOIN p USING (sector) LEFT JOIN st ON st.ticker = p.proxy WHERE roe IS NOT NULL)
SELECT ticker, state, round(adjusted, 6) AS adjusted, rank() OVER (ORDER BY round(adjusted, 9) DESC) AS rank FROM x""", "bars", "xsection")
def scr_37_sector_states(t: Tables):
    """Points by the state of the sector's own series; a sector without one is neutral."""
    states = N.sector_state(t.bars).select(F.col("ticker").alias("proxy"), "state")  # a row a series
    x = t.xsection.where("roe is not null").withColumn("proxy", C.lookup(PROXIES, F.col("sector"), None)).join(states, "proxy", "left")
    state = F.coalesce("state", F.lit("NEUTRAL"))
    x = x.withColumn("state", state).withColumn("adjusted", clip(F.col("roe") * 200 + C.lookup(N.STATE_POINTS, F.col("state"), 0.0), 0.0, 100.0))
    rank = F.rank().over(Window.partitionBy("as_of").orderBy(F.round("adjusted", 9).desc()))
    return x.select("ticker", "state", r6("adjusted"), rank.cast("long").alias("rank"))
