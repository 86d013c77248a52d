"""Queries of broker files, names, published snapshots, stress tables and factor timing."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import names as N
from tallyloom.operators import options as OP
from tallyloom.operators import regime as RG
from tallyloom.operators import stress as ST
from tallyloom.operators import timing as TM
from tallyloom.plans.cross_section import r6
from tallyloom.plans.portfolio import SCENARIOS
from tallyloom.plans.registry import query
from tallyloom.sources import broker as B
from tallyloom.sources import publish as P
from tallyloom.sources import sinks as K
from tallyloom.sources.catalog import Tables
from tallyloom.sources.shared import shared_dir


def fresh(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"


COLUMNS = {n: n.replace(" ", "_") for n in SCENARIOS}
NAMED = {COLUMNS[n]: s for n, s in SCENARIOS.items()}


def impact_sql(shocks: dict[str, float]) -> str:
    whens = " ".join(f"WHEN '{s}' THEN {v}::DOUBLE" for s, v in shocks.items() if s != ST.DEFAULT)
    return f"round((CASE coalesce(sector, 'General') {whens} ELSE {shocks[ST.DEFAULT]}::DOUBLE END) * coalesce(beta, 1.0) * coalesce(weight, 0.0), 6)"


STRESS = f"""WITH h AS (SELECT coalesce(currency, '') AS book, ticker, sector, beta, market_cap / sum(market_cap) OVER (PARTITION BY coalesce(currency, '')) AS weight FROM xsection WHERE market_cap IS NOT NULL),
i AS (SELECT book, ticker, weight, coalesce(beta, 1.0) AS beta, {', '.join(f'{impact_sql(s)} AS {n}' for n, s in NAMED.items())} FROM h),
s AS (SELECT book, CASE WHEN grouping(ticker) = 1 THEN 'TOTAL' ELSE ticker END AS ticker, grouping(ticker) = 1 AS is_total, sum(weight) AS weight, CASE WHEN grouping(ticker) = 1 THEN 0.0 ELSE max(beta) END AS beta, {', '.join(f'round(sum({n}), 6) AS {n}' for n in NAMED)} FROM i GROUP BY ROLLUP (book, ticker) HAVING grouping(book) = 0)"""


def stress(t: Tables):
    held = t.xsection.where("market_cap is not null").select(F.coalesce("currency", F.lit("")).alias("book"), "ticker", "sector", "beta", F.col("market_cap").alias("value"))
    return ST.stress_table(ST.weighted(held), NAMED)


@query(STRESS + f" SELECT book, ticker, is_total, round(weight, 6) AS weight, round(beta, 6) AS beta, {', '.join(f'{n} + 0.0 AS {n}' for n in NAMED)} FROM s", "xsection")
def pf_11_stress_table(t: Tables):
    """Each holding's part in the loss of its book (one a currency) in four scenarios, and each book's total."""
    return stress(t).select("book", "ticker", "is_total", r6("weight"), r6("beta"), *NAMED)


SCENARIO_ROWS = " UNION ALL ".join(f"SELECT book, ticker, is_total, '{n}' AS scenario, {n} AS x FROM s" for n in NAMED)


@query(STRESS + f", l AS ({SCENARIO_ROWS}) SELECT book, scenario, round(max(x) FILTER (is_total) * 100, 1) AS total_impact, arg_min(ticker, (x, ticker)) FILTER (NOT is_total) AS worst, arg_min(ticker, (-x, ticker)) FILTER (NOT is_total) AS best, CASE WHEN max(x) FILTER (is_total) < -0.25 THEN 'high' WHEN max(x) FILTER (is_total) < -0.10 THEN 'medium' ELSE 'low' END AS level FROM l GROUP BY book, scenario", "xsection")
def pf_11_stress_summary(t: Tables):
    return ST.summary(stress(t), list(NAMED))


@query("SELECT s_suppkey, 'Bröd & Bär ' || s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'ISO-8859-1' WHEN 1 THEN 'UTF-8' WHEN 2 THEN 'UTF-8 with mark' ELSE 'UTF-16LE' END AS encoding, (s_suppkey + 0.5)::DOUBLE AS shares, round(s_acctbal, 2) AS current_price FROM supplier")
def src_07_mixed_encodings(t: Tables):
    """A folder of broker files in four encodings, read in one go: each file's own is found from its bytes."""
    path, mark = fresh(t), "﻿"
    number = lambda c: F.translate(F.format_number(c, 2), ",.", " ,")
    for k, (encoding, first) in enumerate([("ISO-8859-1", ""), ("UTF-8", ""), ("UTF-8", mark), ("UTF-16LE", mark)]):
        rows = t.supplier.where(F.col("s_suppkey") % 4 == k).select(F.concat(F.lit("Bröd & Bär "), "s_name").alias(f"{first}Värdepapper"), F.col("s_suppkey").cast("string").alias("ISIN"), number(F.col("s_suppkey") + 0.5).alias("Antal"), number("s_acctbal").alias("Kurs"))
        rows.coalesce(1).write.option("header", True).option("sep", ";").option("encoding", encoding).csv(f"{path}/{k}")
    found = B.read_broker(t.spark, f"{path}/*/*.csv")
    return found.select(F.col("isin").cast("long").alias("s_suppkey"), "name", "encoding", "shares", "current_price")


CLEAN = "regexp_replace(replace(replace(trim(lower({0})), ',', ''), '.', ''), ' +', ' ', 'g')"
ANY = lambda words: "(" + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + ")"


@query(f"""WITH l AS (SELECT lower(p_name || ' ' || p_type) AS listed, 'P' || lpad(CAST(min(p_partkey) AS VARCHAR), 9, '0') AS ticker FROM part GROUP BY 1),
n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, 1) || substr(p_name, 3) || ' ' || p_type WHEN 1 THEN upper(p_name) || '  ' || p_type ELSE p_name || ' ' || p_type || 'X, Inc.' END AS name FROM part),
c AS (SELECT *, {CLEAN.format('name')} AS clean FROM n), a AS (SELECT DISTINCT clean, list_distinct(string_split(clean, ' ')) AS ws FROM c),
m AS (SELECT clean, ticker, round(1 - levenshtein(clean, listed) / greatest(length(clean), length(listed)), 9) AS likeness FROM a, l
  WHERE len(list_filter(ws, lambda w: len(list_filter(string_split(listed, ' '), lambda v: levenshtein(w, v) <= 1)) > 0)) >= ceil(len(ws) * 2 / 3.0 - 1e-9)),
b AS (SELECT clean, arg_min(ticker, (-likeness, ticker)) AS ticker FROM m WHERE likeness >= 0.8 GROUP BY clean),
k AS (SELECT clean, max(CASE WHEN p_partkey % 50 = 7 THEN 'C' END) AS custom, max(CASE WHEN p_partkey % 50 = 8 THEN 'K' END) AS known FROM c GROUP BY clean),
r AS (SELECT p_partkey, name, CASE WHEN custom = 'C' THEN 'MINE' WHEN known = 'K' THEN NULL ELSE ticker END AS ticker, CASE WHEN custom = 'C' THEN 'custom' WHEN known = 'K' THEN 'known' WHEN ticker IS NOT NULL THEN 'listing' END AS found_by FROM c LEFT JOIN b USING (clean) LEFT JOIN k USING (clean))
SELECT *, CASE WHEN {ANY(N.FUND)} THEN 'fund' WHEN {ANY(N.ETF)} THEN 'etf' WHEN {ANY(N.CERTIFICATE)} THEN 'certificate' WHEN ticker IS NOT NULL THEN 'stock' ELSE 'unknown' END AS kind FROM r""")
def prj_13_tickers(t: Tables):
    """Misspelt, shouted and prolonged names of parts back to their listings, after a custom and a known map."""
    full = F.concat_ws(" ", "p_name", "p_type")
    listings = t.part.groupBy(F.lower(full).alias("name")).agg(F.concat(F.lit("P"), F.lpad(F.min("p_partkey").cast("string"), 9, "0")).alias("ticker"))
    kind = F.col("p_partkey") % 3
    short = F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 1000), F.lit(" "), "p_type")
    held = t.part.select("p_partkey", F.when(kind == 0, short).when(kind == 1, F.concat(F.upper("p_name"), F.lit("  "), "p_type")).otherwise(F.concat(full, F.lit("X, Inc."))).alias("name"))
    marked = lambda k: held.where(F.col("p_partkey") % 50 == k).groupBy(N.normal("name").alias("name"))
    custom = marked(7).agg(F.lit("MINE").alias("ticker"))
    known = marked(8).agg(F.lit(None).cast("string").alias("ticker"))
    return N.tickers(held, custom, known, listings)


@query("SELECT kind, snapshot_date, ticker, score_total, entry_signal FROM (SELECT snapshot_date, ticker, CASE WHEN score_total BETWEEN 0 AND 90 THEN score_total END AS score_total, entry_signal FROM snapshots WHERE ticker IS NOT NULL), (VALUES ('csv'), ('parquet')) k(kind)", "snapshots")
def snk_01_published_twins(t: Tables):
    """Two versions published one after the other, by the sanity rules; what readers of either kind then see."""
    path, rows = fresh(t), t.snapshots.select("snapshot_date", "ticker", "score_total", "entry_signal")

    def sane(df):
        return df.where("ticker is not null").withColumn("score_total", F.when(F.col("score_total").between(0, 90), F.col("score_total")))

    P.publish(rows.where("year(snapshot_date) <= 1995"), path, sane)
    P.publish(rows, path, sane)
    P.tidy(t.spark, path)
    kinds = {c: rows.schema[c].dataType for c in rows.columns}
    seen = lambda kind: P.read_published(t.spark, path, kind).select(F.lit(kind).alias("kind"), *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return seen("csv").unionByName(seen("parquet"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, true AS marked FROM nation")
def snk_03_marked_export(t: Tables):
    """An export for spreadsheets: its files begin with a byte-order mark, which readers take off the first name."""
    path = fresh(t)
    P.export_marked(t.nation.select("n_nationkey", "n_name"), path)
    files = t.spark.read.format("binaryFile").load(f"{path}/*.csv").agg(F.min(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))  # one row
    return K.read_csv(t.spark, path, sep=",").select("n_nationkey", "n_name").crossJoin(F.broadcast(files))


@query("SELECT snapshot_date, ticker, score_total FROM snapshots WHERE snapshot_date >= (SELECT max(snapshot_date) FROM snapshots) - INTERVAL 400 DAY", "snapshots")
def snk_05_retention(t: Tables):
    """What is left of a store by date once folders older than 400 days are gone."""
    path, rows = fresh(t), t.snapshots.select("snapshot_date", "ticker", "score_total")
    K.save_snapshot(rows, path)
    last = rows.agg(F.max("snapshot_date").alias("d")).first()["d"]
    P.retain(t.spark, path, last, 400)
    return t.spark.read.parquet(path).select(*rows.columns)


FACTORS = {"quality": "pred", "momentum": "before", "reversal": "-before"}
RANK = lambda c: f"CASE WHEN count({c}) OVER (PARTITION BY month) < 5 OR {c} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY month ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY month, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY month) * 100 END"
TIMING = f"""WITH p AS (SELECT month, ticker, actual, pred, lag(actual) OVER (PARTITION BY ticker ORDER BY month) AS before FROM panel), q AS (SELECT *, {', '.join(f'{c} AS x_{n}' for n, c in FACTORS.items())} FROM p),
r AS (SELECT month, ticker, actual, {', '.join(f'{RANK("x_" + n)} AS {n}' for n in FACTORS)} FROM q),
e AS ({' UNION ALL '.join(f"SELECT month, '{n}' AS factor, avg(actual) FILTER ({n} > 80) - avg(actual) FILTER ({n} <= 20) AS earned FROM r GROUP BY month" for n in FACTORS)}),
t AS (SELECT *, avg(earned) OVER (PARTITION BY factor ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lately FROM e),
g AS (SELECT *, round(greatest(coalesce(lately, 0), 0), 12) AS won FROM t),
w AS (SELECT month, factor, lately, CASE WHEN sum(won) OVER (PARTITION BY month) > 0 THEN won / sum(won) OVER (PARTITION BY month) ELSE 1 / 3.0 END AS weight FROM g)"""


def timing(t: Tables):
    x = t.panel.withColumn("before", F.lag("actual").over(Window.partitionBy("ticker").orderBy("month")))
    ranks = TM.factor_ranks(x, {n: F.expr(c) for n, c in FACTORS.items()})
    return ranks, TM.weights(TM.factor_returns(ranks, list(FACTORS)))


@query(TIMING + " SELECT month, factor, round(lately, 6) AS lately, round(weight, 6) AS weight FROM w", "panel")
def str_15_factor_timing(t: Tables):
    """Each month's weights of three factors from what they have earned in the six months before."""
    return timing(t)[1].select("month", "factor", r6("lately"), r6("weight"))


@query(TIMING + f" SELECT month, ticker, round(least(1, greatest(-1, {' + '.join(f"coalesce({n} / 100, 0.5) * (SELECT weight FROM w WHERE w.month = r.month AND factor = '{n}')" for n in FACTORS)})), 6) AS signal FROM r", "panel")
def str_15_timed_signals(t: Tables):
    ranks, weighted = timing(t)
    return TM.timed_signals(ranks, weighted, list(FACTORS)).select("month", "ticker", r6("signal"))


ROLES = {"market": "1-URGENT", "equal": "2-HIGH", "risky": "3-MEDIUM", "safe": "4-NOT SPECIFIED"}
FILL = lambda c: f"last_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}"
MEAN = lambda c, n: f"CASE WHEN count({c}) OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg({c}) OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
HELD = lambda x: f"greatest(0.0, least(1.0, {x}))"
HALF = lambda x: f"CASE WHEN {x} IS NULL THEN 0.5 ELSE {HELD(x)} END"
MACRO = f"""WITH d AS (SELECT ts, {', '.join(f"max(close) FILTER (ticker = '{name}') AS {role}" for role, name in ROLES.items())} FROM bars WHERE ticker IN ({', '.join(f"'{n}'" for n in ROLES.values())}) GROUP BY ts),
j AS (SELECT coalesce(d.ts, r.ts) AS ts, market, equal, risky, safe, r.long, r.short FROM d FULL JOIN rates r ON r.ts = d.ts),
f AS (SELECT ts, market, {', '.join(map(FILL, ('equal', 'risky', 'safe', 'long', 'short')))} FROM j),
m AS (SELECT *, equal / market AS width, risky / safe AS spread, market / lag(market) OVER (ORDER BY ts) - 1 AS r FROM f WHERE market IS NOT NULL),
x AS (SELECT ts, market / {MEAN('market', 200)} - 1 AS vs200, ({MEAN('r', 20).replace('avg(r)', 'stddev_samp(r)')}) * 20 AS fear, market / lag(market, 62) OVER (ORDER BY ts) - 1 AS r63, width / ({MEAN('width', 60)}) - 1 AS b, long - short AS c, spread / ({MEAN('spread', 20)}) - 1 AS cr FROM m),
s AS (SELECT ts, {HELD('0.5 + vs200 * 5')} AS trend, {HELD('1 - (fear - 15) / 15')} AS fear, {HELD('0.5 + r63 * 6.25')} AS momentum, {HALF('0.5 + b * 5')} AS breadth, {HALF('0.5 + c / 4')} AS curve, {HALF('0.5 + cr * 10')} AS credit FROM x WHERE vs200 IS NOT NULL AND fear IS NOT NULL),
t AS (SELECT *, trend * 0.30 + fear * 0.20 + momentum * 0.15 + breadth * 0.10 + curve * 0.10 + credit * 0.15 AS composite FROM s)"""


@query(MACRO.replace("market / CASE", "market / (CASE", 1).replace("END - 1 AS vs200", "END) - 1 AS vs200", 1) + " SELECT ts, round(composite, 10) AS composite, CASE WHEN composite >= 0.62 THEN 'BULL' WHEN composite <= 0.38 THEN 'BEAR' ELSE 'NEUTRAL' END AS regime, round(CASE WHEN composite >= 0.62 THEN least(0.85, composite) WHEN composite <= 0.38 THEN least(0.85, 1 - composite) ELSE 0.5 END, 10) AS confidence, round(curve, 10) AS curve, round(credit, 6) AS credit, round(breadth, 6) AS breadth FROM t", "bars", "rates")
def scr_39_macro_regime(t: Tables):
    """All six signals of the market's regime: four series of bars stand for the instruments, taxes and discounts for yields."""
    r = RG.macro_regimes(t.bars, t.rates, **ROLES)
    return r.select("ts", *[F.round(c, 10).alias(c) for c in ("composite", "confidence", "curve")], "regime", r6("credit"), r6("breadth"))


@query(None)
def opt_02_implied_from_prices(t: Tables):
    """The volatility that the last price of each contract implies; null where no volatility gives it."""
    return OP.implied_volatility(t.chain).select("contract", "last_price", F.round("implied", 6).alias("implied"))
