"""Queries of walk-forward optimisation and rolling portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import walkforward as WF
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

GRID = [(5, 20), (10, 30), (10, 50), (20, 60)]


def windows_sql(pairs: list[tuple[int, int]]) -> str:
    seg = "PARTITION BY ticker, segment, trains"
    mean = lambda n: f"CASE WHEN count(close) OVER ({seg} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER ({seg} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    grid = ", ".join(f"({f}, {s})" for f, s in pairs)
    lengths = sorted({n for p in pairs for n in p})
    of = lambda c: f"CASE {c} {' '.join(f'WHEN {n} THEN m{n}' for n in lengths)} END"
    return f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY ticker) // 5 AS size FROM bars),
sg AS (SELECT *, k // size + 1 AS segment, k % size < floor(size * 0.7) AS trains FROM k WHERE size > 0 AND k // size < 5),
m AS (SELECT *, close / lag(close) OVER ({seg} ORDER BY ts) - 1 AS r, {', '.join(f'{mean(n)} AS m{n}' for n in lengths)} FROM sg),
g AS (SELECT ticker, segment, trains, ts, r, fast, slow, CASE WHEN {of('fast')} > {of('slow')} THEN 1 WHEN {of('fast')} < {of('slow')} THEN -1 ELSE 0 END AS side FROM m, (VALUES {grid}) p(fast, slow)),
x AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY ticker, segment, trains, fast, slow ORDER BY ts) * r, 0) AS x FROM g),
e AS (SELECT ticker, segment, fast, slow, min(ts) FILTER (trains) AS train_start, max(ts) FILTER (trains) AS train_end, min(ts) FILTER (NOT trains) AS test_start, max(ts) FILTER (NOT trains) AS test_end,
  count(x) FILTER (trains) AS n_train, count(x) FILTER (NOT trains) AS oos_n, avg(x) FILTER (trains) / nullif(stddev_samp(x) FILTER (trains), 0) * sqrt(252) AS is_sharpe,
  avg(x) FILTER (NOT trains) / nullif(stddev_samp(x) FILTER (NOT trains), 0) * sqrt(252) AS oos_sharpe, product(1 + x) FILTER (NOT trains) - 1 AS oos_return FROM x GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY ticker, segment ORDER BY round(is_sharpe, 9) DESC NULLS LAST, fast, slow) AS place FROM e WHERE n_train >= 50 AND oos_n >= 10),
w AS (SELECT * FROM b WHERE place = 1)"""


@query(windows_sql(GRID) + " SELECT ticker, segment::BIGINT AS segment, train_start, train_end, test_start, test_end, fast::BIGINT AS fast, slow::BIGINT AS slow, round(is_sharpe, 5) AS is_sharpe, round(oos_sharpe, 5) AS oos_sharpe, round(oos_return, 5) AS oos_return, round(is_sharpe - oos_sharpe, 5) AS sharpe_drop FROM w", "bars")
def bt_12_walk_forward_windows(t: Tables):
    """Each series' best pair of window lengths in sample, and what it earns out of sample."""
    w = WF.optimised_windows(t.bars, GRID)
    return w.select("ticker", "segment", "train_start", "train_end", "test_start", "test_end", "fast", "slow", F.round("is_sharpe", 5).alias("is_sharpe"), F.round("oos_sharpe", 5).alias("oos_sharpe"), F.round("oos_return", 5).alias("oos_return"), F.round(F.col("is_sharpe") - F.col("oos_sharpe"), 5).alias("sharpe_drop"))


ALL_OUT = "o AS (SELECT x.* FROM x JOIN w USING (ticker, segment, fast, slow) WHERE NOT x.trains), c AS (SELECT ticker, avg(x) / nullif(stddev_samp(x), 0) * sqrt(252) AS combined FROM o GROUP BY ticker)"


@query(windows_sql(GRID) + f", {ALL_OUT} SELECT ticker, count(*) AS n_windows, round(avg(is_sharpe), 5) AS avg_is_sharpe, round(avg(oos_sharpe), 5) AS avg_oos_sharpe, round(avg(is_sharpe - oos_sharpe), 5) AS avg_drop, round(avg(oos_return), 5) AS avg_oos_return, round(any_value(combined), 5) AS combined_oos_sharpe, round(count(*) FILTER (oos_sharpe < 0) / count(*), 5) AS overfit_probability FROM w JOIN c USING (ticker) GROUP BY ticker", "bars")
def bt_12_walk_forward_summary(t: Tables):
    """How much of what was found in sample is left out of sample, by series."""
    s = WF.summary(WF.optimised_windows(t.bars, GRID))
    return s.select("ticker", "n_windows", *[F.round(c, 5).alias(c) for c in s.columns if c not in ("ticker", "n_windows")])


BACK = lambda n: f"close / lag(close, {n - 1}) OVER (PARTITION BY ticker ORDER BY ts) - 1"
HALF_YEAR = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"
RANKED = ", ".join(f"CASE WHEN {n} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY win, period ORDER BY {n} NULLS LAST) + (count(*) OVER (PARTITION BY win, period, {n}) - 1) / 2.0) * 100 / count({n}) OVER (PARTITION BY win, period) END AS rank_{n}, count({n}) OVER (PARTITION BY win, period) > 3 AS has_{n}" for n in WF.WEIGHTS)
TOTAL = " + ".join(f"CASE WHEN has_{n} THEN rank_{n} * {v} ELSE 0 END" for n, v in WF.WEIGHTS.items())
SHARE = " + ".join(f"CASE WHEN has_{n} THEN {v} ELSE 0 END" for n, v in WF.WEIGHTS.items())
PORTFOLIO = f"""WITH b AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS r FROM listings),
f AS (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS k, {', '.join(f'{BACK(k)} AS {n}' for n, k in WF.BACK.items())}, close / max(close) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS from_high,
  CASE WHEN count(r) OVER {HALF_YEAR} > 20 THEN stddev_samp(r) OVER {HALF_YEAR} * sqrt(252) END AS vol FROM b),
l AS (SELECT max(ts) AS last, CAST(CASE WHEN day(max(ts) - INTERVAL 4 YEAR) = 1 THEN max(ts) - INTERVAL 4 YEAR ELSE date_trunc('month', max(ts) - INTERVAL 4 YEAR) + INTERVAL 1 MONTH END AS DATE) AS start FROM listings),
d AS (SELECT win, period, CAST(last_day(start + to_months(CAST(12 * (win - 1) + period AS INTEGER))) AS DATE) AS day FROM l, range(1, 5) a(win), range(0, 12) p(period) WHERE start + to_months(CAST(12 * win AS INTEGER)) <= date_trunc('month', last)),
t AS (SELECT DISTINCT ticker FROM listings), m AS (SELECT ticker, win, period, day FROM t, d),
known AS (SELECT m.*, f.* EXCLUDE (ticker, ts, close, vol) FROM m ASOF JOIN f ON m.ticker = f.ticker AND m.day > f.ts),
priced AS (SELECT m.ticker, m.win, m.period, f.close AS entry, f.vol FROM m ASOF JOIN f ON m.ticker = f.ticker AND m.day <= f.ts),
j AS (SELECT m.ticker, m.win, m.period, m.day, known.* EXCLUDE (ticker, win, period, day), entry, vol, lead(entry) OVER (PARTITION BY m.ticker, m.win ORDER BY m.period) / entry - 1 AS gain FROM m LEFT JOIN known USING (ticker, win, period) LEFT JOIN priced USING (ticker, win, period)),
rk AS (SELECT *, {RANKED} FROM j WHERE k >= 63 AND period < 11),
sc AS (SELECT *, CASE WHEN {SHARE} > 0 THEN (50 + {TOTAL}) / ({SHARE}) ELSE 50 + {TOTAL} END AS score FROM rk),
pk AS (SELECT *, row_number() OVER (PARTITION BY win, period ORDER BY round(score, 9) DESC NULLS LAST, ticker) <= 5 AS picked, CASE WHEN ticker LIKE '%.ST' THEN 0.0025 ELSE 0.0055 END AS fee FROM sc),
g AS (SELECT win, period, day, count(*) FILTER (picked) AS n, sum(1 / vol) FILTER (picked) AS ws, sum((gain - fee) / vol) FILTER (picked) AS weighted, sum(gain - fee) FILTER (picked) AS plain, avg(gain) AS bench FROM pk GROUP BY ALL),
per AS (SELECT win, period, day, n, CASE WHEN ws > 0 THEN coalesce(weighted, 0) / ws ELSE plain / n END AS port, bench FROM g)"""


@query(PORTFOLIO + " SELECT win::INT AS window, period::INT AS period, day, n, round(port, 6) AS port_return, round(bench, 6) AS bench_return FROM per WHERE port IS NOT NULL", "listings")
def bt_19_rolling_portfolio(t: Tables):
    """Month by month out of sample: the best by past momentum, by inverse volatility, net of the venue's costs."""
    return WF.rolling_portfolio(t.listings).select("window", "period", "day", "n", r6("port_return"), r6("bench_return"))


@query(PORTFOLIO + ", s AS (SELECT win, count(*) AS n_periods, min(day) AS first_day, max(day) AS last_day, product(1 + port) - 1 - 0.015 / 12 * count(*) AS p, product(1 + bench) - 1 AS b FROM per WHERE port IS NOT NULL GROUP BY win) SELECT win::INT AS window, n_periods, first_day, last_day, round(p, 6) AS port_return, round(b, 6) AS bench_return, round(p - b, 6) AS alpha, p > b AS beats FROM s", "listings")
def bt_19_walk_forward_portfolio(t: Tables):
    """Each year's compounded result against the benchmark, with what companies that are gone would have cost."""
    w = WF.portfolio_windows(WF.rolling_portfolio(t.listings))
    return w.select("window", "n_periods", "first_day", "last_day", r6("port_return"), r6("bench_return"), r6("alpha"), "beats")
