"""Queries over one cross-section: cleaning, filters, factor scores, sectors, options on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.stats import clip, pct_rank, rank_metrics, ratio, row_mean
from tallyloom.operators import cleaning as C
from tallyloom.operators import factors as X
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables


def r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def as_sql(c: str, places: int = 6):
    """Rounded as other engines do, halves by the scaled number and not by its decimal digits."""
    return (F.round(F.col(c) * 10.0**places) / 10.0**places).alias(c)


def base(t: Tables):
    return C.with_groups(t.xsection)


# --- SQL of the same, built from parts -----------------------------------------------------------------------------


def case_map(key: str, table: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, (int, float)) else repr(v)}" for k, v in table.items()) + f" ELSE {default} END"


GROUP = case_map(r"regexp_extract(upper(ticker), '(\.[A-Z]+)$', 1)", C.VENUE_GROUPS, "'US'")
GROUPED = f"g AS (SELECT *, {GROUP} AS grp FROM xsection)"
USD = case_map("currency", C.USD, "1.0")
FIN = "coalesce(regexp_matches(sector, '(?i)(Financial|Real Estate|Insurance|Bank|REIT)'), false)"
WIN = (0.02, 0.98)
SQL_METRICS = {
    "m_fcf_yield": ("CASE WHEN enterprise_value > 0 AND free_cash_flow / enterprise_value > -0.5 THEN free_cash_flow / enterprise_value END", True, WIN),
    "m_ev": ("CASE WHEN ev_to_ebitda > 0 THEN ev_to_ebitda END", False, WIN),
    "m_pe": ("CASE WHEN coalesce(pe_forward, pe_trailing) > 0 THEN coalesce(pe_forward, pe_trailing) END", False, WIN),
    "m_pb": ("CASE WHEN price_to_book > 0 THEN price_to_book END", False, WIN),
    "m_ps": ("CASE WHEN price_to_sales > 0 THEN price_to_sales END", False, WIN),
    **{f"m_{c}": (c, True, WIN) for c in ("roe", "roa", "profit_margin", "operating_margin", "gross_margin", "return_12m", "return_6m", "return_3m", "pct_from_52w_high", "earnings_revision_rate", "earnings_surprise", "revenue_growth", "earnings_growth", "earnings_quarterly_growth")},
    "m_fcf_margin": ("CASE WHEN total_revenue > 0 AND abs(free_cash_flow / total_revenue) < 5 THEN free_cash_flow / total_revenue END", True, WIN),
    "m_debt": ("CASE WHEN debt_to_equity >= 0 THEN debt_to_equity END", False, WIN),
    "m_current": ("CASE WHEN current_ratio > 5 THEN 5 ELSE current_ratio END", True, WIN),
    "m_volatility": ("volatility", False, WIN),
    "m_beta": ("beta", False, WIN),
    "m_size": ("CASE WHEN market_cap > 0 THEN ln(market_cap) END", False, None),
    "m_dividend": ("CASE WHEN payout_ratio > 1 THEN 0.5 ELSE 1.0 END * least(coalesce(dividend_yield, 0.0), 0.15)", True, None),
    "m_short": ("short_pct_float", False, (0.0, 0.98)),
    "m_sentiment": ("coalesce(sentiment_raw, 0.0)", True, None),
}


def rank_sql(v: str, up: bool = True, part: str = "as_of") -> str:
    d = "" if up else "DESC "
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {v} {d}NULLS LAST) + (count({v}) OVER (PARTITION BY {part}, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY {part}) * 100 END"


def neutral_sql(columns: list[str], group: str, source: str, name: str) -> str:
    """Columns less their group's median: half the lower and half the upper middle value, summed as Spark does."""
    return f"{name} AS (SELECT * REPLACE ({', '.join(f'{c} - (0.5 * quantile_disc({c}, 0.5) OVER (PARTITION BY as_of, {group}) - 0.5 * quantile_disc(-{c}, 0.5) OVER (PARTITION BY as_of, {group})) AS {c}' for c in columns)}) FROM {source})"


def between(values: str, p: float) -> str:
    """A quantile of a sorted list: its two neighbours weighted as Spark does, so that both engines' last bits agree."""
    at = f"((len({values}) - 1) * {p}::DOUBLE)"
    low, high = (f"{values}[CAST({f}({at}) AS BIGINT) + 1]" for f in ("floor", "ceil"))
    return f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"


def metrics_sql(source: str, keep: str = "*") -> str:
    """CTEs mm, q, ww, rr: metrics, bounds, winsorized values, ranks."""
    m = ", ".join(f"{e} AS {n}" for n, (e, _, _) in SQL_METRICS.items())
    bounded = {n: b for n, (_, _, b) in SQL_METRICS.items() if b}
    lists = ", ".join(f"list_sort(list({n}) FILTER ({n} IS NOT NULL)) AS l_{n}" for n in bounded)
    q = ", ".join(f"{between(f'l_{n}', lo)} AS lo_{n}, {between(f'l_{n}', hi)} AS hi_{n}" for n, (lo, hi) in bounded.items())
    w = ", ".join(f"CASE WHEN {n} < lo_{n} THEN lo_{n} WHEN {n} > hi_{n} THEN hi_{n} ELSE {n} END AS {n}" for n in bounded)
    r = ", ".join(f"CASE WHEN count({n}) OVER (PARTITION BY as_of) >= 5 THEN {rank_sql(n, up)} END AS {n}" for n, (_, up, _) in SQL_METRICS.items())
    return f"mm AS (SELECT {keep}, {m} FROM {source}), ql AS (SELECT as_of, {lists} FROM mm GROUP BY as_of), q AS (SELECT as_of, {q} FROM ql), ww AS (SELECT mm.* REPLACE ({w}) FROM mm JOIN q USING (as_of)), rr AS (SELECT ww.* REPLACE ({r}) FROM ww)"


def mean_sql(*cs: str) -> str:
    return f"({' + '.join(f'coalesce({c}, 0)' for c in cs)}) / nullif({' + '.join(f'(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)' for c in cs)}, 0)"


DECAY = "CASE WHEN insider_days IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - greatest(insider_days, 0) / 180.0)) END"
MOOD = "((coalesce(sentiment_raw, 0.0) + 1) * 25 + m_sentiment * 0.5)"
EXEC = f"(CASE WHEN insider_executive_buy THEN least({MOOD} + 20 * {DECAY}, 95.0) ELSE {MOOD} END)"
SCORES = f"""ss AS (SELECT *, (0.70 * m_fcf_yield + 0.30 * m_ev) AS score_value,
  {mean_sql('m_roe', 'm_roa', 'm_profit_margin', 'm_operating_margin', 'm_gross_margin', 'm_fcf_margin')} AS score_quality,
  {mean_sql('m_return_12m', 'm_return_6m', 'm_return_3m', 'm_pct_from_52w_high', 'm_earnings_revision_rate', 'm_earnings_surprise')} AS score_momentum,
  {mean_sql('m_revenue_growth', 'm_earnings_growth', 'm_earnings_quarterly_growth', 'm_earnings_revision_rate', 'm_earnings_surprise')} AS score_growth,
  {mean_sql('m_debt', 'm_current', 'm_volatility', 'm_beta')} AS score_risk, m_size AS score_size, m_dividend AS score_dividend, m_fcf_yield AS score_fcf_yield,
  CASE WHEN insider_cluster THEN least({EXEC} + 30 * {DECAY}, 98.0) ELSE {EXEC} END AS score_sentiment,
  CASE WHEN m_short IS NOT NULL THEN least(m_short + CASE WHEN coalesce(short_pct_float, 0) > 0.20 THEN 10.0 ELSE 0.0 END, 99.0) END AS score_short_interest,
  CASE WHEN options_flow_signal > 0.8 THEN least(options_flow_signal * 100 + 10, 100.0) ELSE coalesce(options_flow_signal * 100, 50.0) END AS score_options_flow FROM rr)"""


def composite_sql(regime: str = "NEUTRAL") -> str:
    w = X.regime_weights(regime)
    per = {s: X.sector_weights(s, w) for s in X.SECTOR_DELTAS}
    weight = {n: case_map("sector", {s: repr(x[n]) for s, x in per.items()}, repr(w[n])).replace("'0", "0").replace("THEN '", "THEN ") for n in w}
    weight = {n: "CASE sector " + " ".join(f"WHEN '{s}' THEN {x[n]!r}" for s, x in per.items()) + f" ELSE {w[n]!r} END" for n in w}
    total = " + ".join(f"({weight[n]}) * coalesce(score_{n}, 0.0)" for n in w)
    used = " + ".join(f"CASE WHEN score_{n} IS NOT NULL THEN ({weight[n]}) ELSE 0.0 END" for n in w)
    whole = " + ".join(f"({weight[n]})" for n in w)
    contains = lambda names: "(" + " OR ".join(f"contains(lower(coalesce(industry, '')), '{n}')" for n in names) + ")"
    return f"""c1 AS (SELECT *, greatest(0.0, least(100.0, ({total}) * least(({whole}) / greatest({used}, 1e-6), 1.5))) AS raw_total,
  CASE WHEN {contains(X.HOLDING_INDUSTRIES)} THEN 'holding' WHEN {contains(X.COMMODITY_INDUSTRIES)} THEN 'commodity' ELSE 'standard' END AS company_type FROM ss),
c2 AS (SELECT *, raw_total * CASE company_type WHEN 'holding' THEN 0.85 WHEN 'commodity' THEN 0.90 ELSE 1.0 END AS score_total FROM c1),
c3 AS (SELECT *, rank() OVER (PARTITION BY as_of ORDER BY round(score_total, 9) DESC NULLS LAST) AS rnk FROM c2)"""


def scored_sql(regime: str = "NEUTRAL", sector: bool = True) -> str:
    steps = [GROUPED, neutral_sql(X.REGION_COLUMNS, "grp", "g", "n1")]
    source = "n1"
    if sector:
        steps.append(neutral_sql(X.SECTOR_COLUMNS, "coalesce(sector, 'Unknown')", "n1", "n2"))
        source = "n2"
    return "WITH " + ",\n".join([*steps, metrics_sql(source), SCORES, composite_sql(regime)])


TREND = "CASE WHEN coalesce(price_vs_ma200, 0.0) < 0 THEN 'DOWN' WHEN coalesce(price_vs_ma50, 0.0) < 0 THEN 'WARN' ELSE 'UP' END"
POSITIVE = " + ".join(f"(CASE WHEN {c} >= 60 THEN 1 ELSE 0 END)" for c in C.CONFIDENCE_SCORES)
BAD = f"((NOT {FIN} AND coalesce(price_to_book < 0, false)) OR (coalesce(debt_to_equity > 400, false) AND coalesce(free_cash_flow < 0, false)) OR recommendation_mean > 4.2 OR (NOT {FIN} AND coalesce(return_12m < -0.55, false)))"
SIGNAL = """CASE WHEN coalesce(score_total, 0) < 0 OR coalesce(score_total, 0) > 100 THEN 'NO_DATA'
  WHEN coalesce(price_vs_ma200, 0.0) < 0 OR coalesce(score_total, 0) < 55 THEN 'NONE'
  WHEN rsi_14 IS NULL OR rsi_14 > 75 OR rsi_14 < 30 THEN 'WAIT'
  WHEN score_total >= 72 AND rsi_14 BETWEEN 35 AND 68 AND pct_from_52w_high BETWEEN -0.18 AND -0.05 THEN 'STRONG'
  WHEN score_total >= 65 AND rsi_14 BETWEEN 35 AND 68 THEN 'OK' ELSE 'WAIT' END"""


# --- scorer ----------------------------------------------------------------------------------------------------------


@query(scored_sql() + f", f AS (SELECT *, {SIGNAL} AS entry_signal, {TREND} AS trend_signal, {POSITIVE} AS factors_positive FROM c3 WHERE NOT {BAD}) SELECT ticker, sector, round(score_total, 6) AS score_total, rnk::BIGINT AS rank, trend_signal, factors_positive::BIGINT AS factors_positive, entry_signal FROM f ORDER BY round(score_total, 9) DESC, ticker LIMIT 20", "xsection")
def flagship_top_signals(t: Tables):
    """Top 20 of the sector-neutral scorer after all filters, with signals."""
    out = C.signals(X.scored(base(t))).orderBy(F.round("score_total", 9).desc(), "ticker").limit(20)
    return out.select("ticker", "sector", as_sql("score_total"), F.col("rank").cast("long").alias("rank"), "trend_signal", F.col("factors_positive").cast("long").alias("factors_positive"), "entry_signal")


NAMES = list(X.FACTOR_WEIGHTS)


@query(scored_sql(sector=False) + f" SELECT ticker, {', '.join(f'round(score_{n}, 7) AS score_{n}' for n in [*NAMES, 'fcf_yield'])} FROM c3", "xsection")
def scr_05_16_factor_scores(t: Tables):
    """All factor scores on region-neutral fundamentals."""
    return X.factor_scores(X.neutralise_regions(base(t))).select("ticker", *[as_sql(f"score_{n}", 7) for n in [*NAMES, "fcf_yield"]])


@query(scored_sql() + " SELECT ticker, round(score_total, 6) AS score_total, company_type, rnk::BIGINT AS rank FROM c3", "xsection")
def scr_19_composite_sector_neutral(t: Tables):
    return X.scored(base(t)).select("ticker", as_sql("score_total"), "company_type", F.col("rank").cast("long").alias("rank"))


@query(scored_sql("BULL", sector=False) + " SELECT ticker, round(score_total, 6) AS score_total, rnk::BIGINT AS rank FROM c3", "xsection")
def scr_17_20_global_scorer_bull(t: Tables):
    return X.scored(base(t), "BULL", sector_neutral=False).select("ticker", as_sql("score_total"), F.col("rank").cast("long").alias("rank"))


@query(scored_sql("BEAR") + " SELECT ticker, round(score_total, 6) AS score_total FROM c3", "xsection")
def scr_18_sector_weights_bear(t: Tables):
    return X.scored(base(t), "BEAR").select("ticker", as_sql("score_total"))


@query(f"SELECT ticker, round({rank_sql('roe')}, 6) AS roe_rank, round({rank_sql('pe_trailing', False)}, 6) AS pe_rank FROM xsection", "xsection")
def scr_01_percentile_rank(t: Tables):
    return t.xsection.select("ticker", r6(pct_rank("roe", X.BY), "roe_rank"), r6(pct_rank("pe_trailing", X.BY, descending=True), "pe_rank"))


@query("WITH " + metrics_sql("xsection") + " SELECT ticker, round(m_roe, 6) AS m_roe, round(m_beta, 6) AS m_beta, round(m_short, 6) AS m_short FROM rr", "xsection")
def scr_02_winsorized_rank(t: Tables):
    chosen = {k: v for k, v in X.metrics().items() if k in ("m_roe", "m_beta", "m_short")}
    return rank_metrics(t.xsection, [*X.KEYS, "ticker"], X.BY, chosen).select("ticker", as_sql("m_roe"), as_sql("m_beta"), as_sql("m_short"))


@query(f"WITH {GROUPED}, {neutral_sql(X.REGION_COLUMNS, 'grp', 'g', 'n1')} SELECT ticker, grp AS exchange_group, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in X.REGION_COLUMNS)} FROM n1", "xsection")
def scr_03_region_neutral(t: Tables):
    return X.neutralise_regions(base(t)).select("ticker", "exchange_group", *[r6(c) for c in X.REGION_COLUMNS])


@query(f"WITH {GROUPED}, {neutral_sql(X.REGION_COLUMNS, 'grp', 'g', 'n1')}, {neutral_sql(X.SECTOR_COLUMNS, "coalesce(sector, 'Unknown')", 'n1', 'n2')} SELECT ticker, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in X.SECTOR_COLUMNS)} FROM n2", "xsection")
def scr_04_sector_neutral(t: Tables):
    return X.neutralise_sectors(X.neutralise_regions(base(t))).select("ticker", *[r6(c) for c in X.SECTOR_COLUMNS])


BLEND = """, b AS (SELECT *, CASE WHEN sector IS NOT NULL AND count(*) OVER (PARTITION BY as_of, sector) >= 4
  THEN (rank() OVER (PARTITION BY as_of, sector ORDER BY round(score_total, 9)) - 1) * 100.0 / count(*) OVER (PARTITION BY as_of, sector) END AS score_sector FROM c3)"""


@query(scored_sql() + BLEND + " SELECT ticker, round(score_sector, 6) AS score_sector, round(coalesce((score_total + score_sector) / 2, score_total), 6) AS score_blend, rank() OVER (PARTITION BY as_of ORDER BY round(coalesce((score_total + score_sector) / 2, score_total), 9) DESC)::BIGINT AS rank_blend FROM b", "xsection")
def scr_21_sector_blend(t: Tables):
    return X.sector_relative(X.scored(base(t))).select("ticker", as_sql("score_sector"), as_sql("score_blend"), F.col("rank_blend").cast("long").alias("rank_blend"))


@query(scored_sql() + " SELECT sector, count(*) AS n, round(avg(score_total), 6) AS mean_score, arg_max(ticker, (round(score_total, 9), -pk)) AS best_ticker, round(max(score_total), 6) AS best_score FROM c3 WHERE sector IS NOT NULL GROUP BY sector", "xsection")
def scr_22_sector_summary(t: Tables):
    return X.sector_summary(X.scored(base(t))).select("sector", "n", as_sql("mean_score"), "best_ticker", as_sql("best_score"))


@query(f"SELECT ticker, round({DECAY}, 6) AS decay FROM xsection", "xsection")
def scr_15_insider_decay(t: Tables):
    return t.xsection.select("ticker", r6(X.insider_decay(), "decay"))


# --- cleaning and flags ------------------------------------------------------------------------------------------------


@query(f"SELECT ticker, {GROUP} AS exchange_group FROM xsection", "xsection")
def prj_05_venue_group(t: Tables):
    return base(t).select("ticker", "exchange_group")


@query("SELECT ticker, round(CASE WHEN n IS NOT NULL AND NOT isinf(n) THEN n END, 6) AS number FROM (SELECT ticker, TRY_CAST(replace(regexp_replace(raw, '[\\s\\x{00a0}]', '', 'g'), ',', '.') AS DOUBLE) AS n FROM (SELECT ticker, CASE CAST(pk % 5 AS INT) WHEN 0 THEN ' ' || CAST(CAST(floor(current_price) AS BIGINT) AS VARCHAR) || ',5' WHEN 1 THEN '1 234,25' WHEN 2 THEN 'n/a' WHEN 3 THEN 'Infinity' ELSE CAST(pk AS VARCHAR) END AS raw FROM xsection))", "xsection")
def prj_01_numeric_coercion(t: Tables):
    raw = F.when(F.col("pk") % 5 == 0, F.concat(F.lit(" "), F.floor("current_price").cast("string"), F.lit(",5"))).when(F.col("pk") % 5 == 1, "1 234,25").when(F.col("pk") % 5 == 2, "n/a").when(F.col("pk") % 5 == 3, "Infinity").otherwise(F.col("pk").cast("string"))
    return t.xsection.withColumn("raw", raw).select("ticker", r6(C.to_number("raw"), "number"))


PE_BAD = "coalesce(pe_trailing <= 1 OR pe_trailing > 200, false)"
GM_BAD = f"(coalesce(gross_margin < 0, false) AND NOT {FIN})"


@query(
    f"""SELECT ticker, concat_ws(';', CASE WHEN {PE_BAD} THEN 'pe_out_of_range' END, CASE WHEN debt_to_equity < 0 THEN 'negative_debt_ratio' END, CASE WHEN debt_to_equity > 200 THEN 'extreme_debt_ratio' END,
  CASE WHEN current_ratio > 20 THEN 'extreme_current_ratio' END, CASE WHEN {GM_BAD} THEN 'negative_gross_margin' END) AS data_warnings,
  round(CASE WHEN NOT {PE_BAD} THEN pe_trailing END, 6) AS pe_trailing, round(CASE WHEN debt_to_equity < 0 THEN 0 WHEN debt_to_equity > 200 THEN NULL ELSE debt_to_equity END, 6) AS debt_to_equity,
  round(CASE WHEN {FIN} THEN NULL WHEN current_ratio < 0 THEN 0 WHEN current_ratio > 20 THEN NULL ELSE current_ratio END, 6) AS current_ratio,
  round(CASE WHEN NOT {FIN} AND NOT {GM_BAD} AND abs(gross_margin) <= 5 THEN gross_margin END, 6) AS gross_margin,
  round(CASE WHEN dividend_yield > 0.1 THEN dividend_yield / 100 WHEN dividend_yield >= 0 THEN dividend_yield END, 6) AS dividend_yield, round(market_cap * {USD}, 2) AS market_cap FROM xsection""",
    "xsection",
)
def prj_02_row_sanity(t: Tables):
    return C.sane(t.xsection).select("ticker", "data_warnings", *[r6(c) for c in ("pe_trailing", "debt_to_equity", "current_ratio", "gross_margin", "dividend_yield")], F.round("market_cap", 2).alias("market_cap"))


@query("WITH q AS (SELECT as_of, quantile_cont(pe_trailing, 0.02) AS lo, quantile_cont(pe_trailing, 0.98) AS hi FROM xsection GROUP BY as_of) SELECT ticker, round(CASE WHEN pe_trailing < lo THEN lo WHEN pe_trailing > hi THEN hi ELSE pe_trailing END, 6) AS pe FROM xsection JOIN q USING (as_of)", "xsection")
def prj_04_winsorize(t: Tables):
    bounds = t.xsection.groupBy("as_of").agg(F.percentile("pe_trailing", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    return t.xsection.join(bounds, "as_of").select("ticker", r6(clip("pe_trailing", F.col("q")[0], F.col("q")[1]), "pe"))


@query("SELECT ticker, concat(CASE WHEN NOT coalesce(abs(revenue_growth) <= 500, false) THEN 'EXTREME_GROWTH;' ELSE '' END, CASE WHEN NOT coalesce(abs(earnings_growth) <= 500, false) THEN 'EXTREME_EARNINGS_GROWTH;' ELSE '' END, CASE WHEN pe_forward < 2 THEN 'SUSPICIOUS_FWD_PE;' ELSE '' END, CASE WHEN pe_trailing IS NULL AND roe IS NULL AND return_12m IS NULL THEN 'MISSING_CRITICAL;' ELSE '' END) AS data_anomaly FROM xsection", "xsection")
def prj_06_anomaly_flags(t: Tables):
    return t.xsection.select("ticker", C.anomalies().alias("data_anomaly"))


FIELDS = ["pe_trailing", "price_to_book", "roe", "profit_margin", "revenue_growth", "debt_to_equity", "return_12m", "beta"]


@query(f"SELECT ticker, ({' + '.join(f'(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)' for c in FIELDS)}) / 8.0 AS data_quality FROM xsection", "xsection")
def prj_07_data_quality(t: Tables):
    return t.xsection.select("ticker", X.data_quality().alias("data_quality"))


TURNOVER = f"(avg_volume * current_price * {USD})"


@query(f"SELECT ticker, round(CASE WHEN {TURNOVER} > 0 THEN {TURNOVER} END, 4) AS turnover, coalesce({TURNOVER}, 0) < 50000 AS low_liquidity FROM xsection", "xsection")
def prj_08_09_turnover(t: Tables):
    return t.xsection.select("ticker", F.round(C.turnover_usd(), 4).alias("turnover"), C.low_liquidity().alias("low_liquidity"))


@query("SELECT ticker, CASE WHEN roe * 200 >= 80 THEN 5 WHEN roe * 200 >= 65 THEN 4 WHEN roe * 200 >= 50 THEN 3 WHEN roe * 200 >= 35 THEN 2 ELSE 1 END AS stars FROM xsection", "xsection")
def prj_11_stars(t: Tables):
    return t.xsection.select("ticker", C.stars(F.col("roe") * 200).alias("stars"))


@query(f"SELECT ticker, concat_ws('; ', CASE WHEN NOT {FIN} AND price_to_book < 0 THEN 'negative equity' END, CASE WHEN debt_to_equity > 400 AND free_cash_flow < 0 THEN 'debt and cash burn' END, CASE WHEN recommendation_mean > 4.2 THEN 'strong sell' END, CASE WHEN NOT {FIN} AND return_12m < -0.55 THEN 'falling knife' END) AS filter_reason FROM xsection WHERE {BAD}", "xsection")
def flt_01_quality_filter(t: Tables):
    return C.quality_filter(t.xsection)[1].select("ticker", "filter_reason")


@query(f"SELECT ticker, {TREND} AS trend_signal, coalesce(price_vs_ma200, 0.0) < 0 AS trend_capped FROM xsection", "xsection")
def flt_02_trend(t: Tables):
    return C.trend(t.xsection).select("ticker", "trend_signal", "trend_capped")


@query(scored_sql() + f" SELECT ticker, ({POSITIVE})::BIGINT AS factors_positive, CASE WHEN ({POSITIVE}) / 7.0 >= 0.70 THEN 'HIGH' WHEN ({POSITIVE}) / 7.0 >= 0.45 THEN 'MID' ELSE 'LOW' END AS confidence_label FROM c3", "xsection")
def flt_03_confidence(t: Tables):
    return C.confidence(X.scored(base(t))).select("ticker", F.col("factors_positive").cast("long").alias("factors_positive"), "confidence_label")


@query(scored_sql() + f" SELECT ticker, {SIGNAL} AS entry_signal FROM c3", "xsection")
def flt_04_entry_signal(t: Tables):
    return C.entry_signal(C.trend(X.scored(base(t)))).select("ticker", "entry_signal")


@query(scored_sql() + f" SELECT entry_signal, trend_signal, count(*) AS n FROM (SELECT {SIGNAL} AS entry_signal, {TREND} AS trend_signal FROM c3 WHERE NOT {BAD}) GROUP BY ALL", "xsection")
def flt_05_signal_counts(t: Tables):
    return C.signals(X.scored(base(t))).groupBy("entry_signal", "trend_signal").agg(F.count("*").alias("n"))


PRESET = {"pe_trailing": (5.0, 20.0), "roe": (0.1, None), "debt_to_equity": (None, 150.0), "currency": ("USD",), "not_there": (0, 1)}


@query("SELECT ticker, pe_trailing, roe FROM xsection WHERE pe_trailing BETWEEN 5 AND 20 AND roe >= 0.1 AND debt_to_equity <= 150 AND currency = 'USD'", "xsection")
def flt_09_screener_preset(t: Tables):
    return C.screen(t.xsection, PRESET).select("ticker", "pe_trailing", "roe")


@query("SELECT ticker, sector, rsi_14 FROM xsection WHERE rsi_14 BETWEEN 35 AND 60 AND sector IN ('Technology', 'Energy') AND regexp_matches(ticker, '\\.(ST|L)$') AND piotroski_f >= 4 AND pk IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)", "xsection")
def flt_10_interactive_filters(t: Tables):
    held = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("pk"))
    chosen = t.xsection.where(F.col("rsi_14").between(35, 60) & F.col("sector").isin("Technology", "Energy") & F.col("ticker").rlike(r"\.(ST|L)$") & (F.col("piotroski_f") >= 4))
    return chosen.join(held, "pk", "left_semi").select("ticker", "sector", "rsi_14")


@query("SELECT ticker FROM xsection WHERE roe >= 0.1 AND beta < 1.5 AND pe_trailing != 10", "xsection")
def flt_12_dsl_rules(t: Tables):
    return C.rule_filter(t.xsection, ["roe >= 0.1", "beta < 1.5", "pe_trailing != 10", "unheard_of > 3"]).select("ticker")


@query("SELECT ticker, coalesce(CASE WHEN current_price IS NULL OR current_price <= 0 THEN 'no price' END, CASE WHEN market_cap IS NULL THEN 'no market cap' END, CASE WHEN avg_volume IS NULL OR avg_volume < 1000 THEN 'no volume' END, CASE WHEN price_to_book < 0 THEN 'negative equity' END, CASE WHEN total_revenue <= 0 THEN 'no revenue' END, CASE WHEN pe_trailing > 500 THEN 'extreme P/E' END, CASE WHEN debt_to_equity > 800 THEN 'extreme debt' END) AS reason FROM xsection", "xsection")
def flt_13_hard_exclusion(t: Tables):
    return t.xsection.select("ticker", C.hard_exclusion().alias("reason"))


@query("SELECT ticker, length(ticker) BETWEEN 1 AND 12 AND regexp_matches(upper(ticker), '^[A-Z0-9][A-Z0-9\\-]*(\\.[A-Z]{1,3})?$') AS valid FROM xsection", "xsection")
def flt_14_ticker_shape(t: Tables):
    return t.xsection.select("ticker", C.looks_like_ticker().alias("valid"))


@query("SELECT c.ticker FROM xsection c WHERE avg_volume >= 2000 AND current_price > 950 AND NOT EXISTS (SELECT 1 FROM xsection h WHERE h.pk = c.pk AND h.sector = 'Energy')", "xsection")
def flt_15_candidate_validation(t: Tables):
    present = t.xsection.where("sector = 'Energy'").select("pk")
    return t.xsection.where("avg_volume >= 2000 AND current_price > 950").join(present, "pk", "left_anti").select("ticker")


@query("SELECT sector, count(*) AS n, round(avg(roe), 6) AS mean_roe, round(max(roe), 6) AS max_roe FROM xsection WHERE sector IS NOT NULL GROUP BY sector", "xsection")
def agg_01_by_sector(t: Tables):
    return t.xsection.where("sector is not null").groupBy("sector").agg(F.count("*").alias("n"), r6(F.avg("roe"), "mean_roe"), r6(F.max("roe"), "max_roe"))


@query("SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS n FROM xsection GROUP BY 1", "xsection")
def agg_02_value_counts(t: Tables):
    return t.xsection.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN roe < -0.1 THEN 0 WHEN roe >= 0.4 THEN 11 ELSE CAST(floor((roe + 0.1) / 0.05) AS BIGINT) + 1 END AS bin, count(*) AS n FROM xsection WHERE roe IS NOT NULL GROUP BY 1", "xsection")
def agg_03_histogram(t: Tables):
    bin_ = F.when(F.col("roe") < -0.1, 0).when(F.col("roe") >= 0.4, 11).otherwise(F.floor((F.col("roe") + 0.1) / 0.05) + 1)
    return t.xsection.where("roe is not null").groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT round(quantile_cont(roe, 0.5), 6) AS p50, round(quantile_cont(roe, 0.75), 6) AS p75, round(quantile_cont(roe, 0.9), 6) AS p90, round(quantile_cont(roe, 0.95), 6) AS p95 FROM xsection", "xsection")
def agg_04_quantiles(t: Tables):
    q = t.xsection.agg(F.percentile("roe", F.array(*[F.lit(p) for p in (0.5, 0.75, 0.9, 0.95)])).alias("q"))
    return q.select(*[r6(F.col("q")[k], f"p{p}") for k, p in enumerate((50, 75, 90, 95))])


COVERED = ["pe_trailing", "roe", "beta", "rsi_14"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, round(count({c}) * 100.0 / count(*), 6) AS pct, round(avg({c}), 6) AS mean FROM xsection" for c in COVERED), "xsection")
def agg_05_coverage(t: Tables):
    long = t.xsection.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in COVERED])))
    return long.groupBy("metric").agg(F.count("v").alias("n"), r6(F.count("v") * 100 / F.count("*"), "pct"), r6(F.avg("v"), "mean"))


@query("WITH p AS (SELECT sector, avg(return_3m) AS proxy FROM xsection GROUP BY sector), r AS (SELECT ticker, round(return_3m - proxy, 6) AS relative FROM xsection x JOIN p ON p.sector IS NOT DISTINCT FROM x.sector) SELECT ticker, relative, CASE WHEN relative > 0.05 THEN 'STRONG' WHEN relative < -0.05 THEN 'WEAK' ELSE 'IN_LINE' END AS label FROM r", "xsection")
def scr_35_relative_strength(t: Tables):
    """Three-month return less that of the sector, whose mean stands for a sector fund."""
    proxy = t.xsection.groupBy(F.col("sector").alias("its_sector")).agg(F.avg("return_3m").alias("proxy"))
    rel = t.xsection.join(proxy, F.col("sector").eqNullSafe(F.col("its_sector"))).select("ticker", r6(F.col("return_3m") - F.col("proxy"), "relative"))
    return rel.withColumn("label", F.when(F.col("relative") > 0.05, "STRONG").when(F.col("relative") < -0.05, "WEAK").otherwise("IN_LINE"))


@query("SELECT currency, round(sum(market_cap), 2) AS value, round(sum(market_cap) * 0.01, 2) AS impact_1, round(sum(market_cap) * 0.05, 2) AS impact_5, round(sum(market_cap) * 0.10, 2) AS impact_10 FROM xsection WHERE market_cap IS NOT NULL GROUP BY currency", "xsection")
def scr_42_fx_impact(t: Tables):
    v = F.sum("market_cap")
    return t.xsection.where("market_cap is not null").groupBy("currency").agg(F.round(v, 2).alias("value"), *[F.round(v * p, 2).alias(f"impact_{n}") for n, p in ((1, 0.01), (5, 0.05), (10, 0.10))])


TOP2 = ["roe", "beta", "return_6m", "return_3m"]


@query("SELECT ticker, list_sort([(coalesce(round(roe, 9), 0), 'roe'), (coalesce(round(beta, 9), 0), 'beta'), (coalesce(round(return_6m, 9), 0), 'return_6m'), (coalesce(round(return_3m, 9), 0), 'return_3m')])[4][2] AS best, list_sort([(coalesce(round(roe, 9), 0), 'roe'), (coalesce(round(beta, 9), 0), 'beta'), (coalesce(round(return_6m, 9), 0), 'return_6m'), (coalesce(round(return_3m, 9), 0), 'return_3m')])[1][2] AS worst FROM xsection", "xsection")
def scr_45_best_and_worst_factor(t: Tables):
    ordered = F.array_sort(F.array(*[F.struct(F.coalesce(F.round(c, 9), F.lit(0.0)).alias("v"), F.lit(c).alias("n")) for c in TOP2]))
    return t.xsection.select("ticker", ordered[3]["n"].alias("best"), ordered[0]["n"].alias("worst"))


@query("SELECT ticker, sector, roe FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY roe DESC NULLS LAST, ticker) AS k FROM xsection WHERE sector IS NOT NULL) WHERE k <= 3", "xsection")
def top_03_per_sector(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("sector").orderBy(F.col("roe").desc_nulls_last(), "ticker")
    return t.xsection.where("sector is not null").withColumn("k", F.row_number().over(w)).where("k <= 3").select("ticker", "sector", "roe")


@query("SELECT ticker, round(roe, 6) AS roe FROM xsection WHERE roe IS NOT NULL ORDER BY roe DESC, ticker LIMIT 10", "xsection")
def top_01_best(t: Tables):
    return t.xsection.where("roe is not null").orderBy(F.col("roe").desc(), "ticker").limit(10).select("ticker", r6("roe"))


@query("SELECT ticker FROM xsection ORDER BY ticker LIMIT 25 OFFSET 50", "xsection")
def top_05_page(t: Tables):
    return t.xsection.select("ticker").orderBy("ticker").offset(50).limit(25)


OPPORTUNITY = """(SELECT 'dip' AS kind, ticker FROM xsection WHERE pct_from_52w_high < -0.2 AND roe > 0.2 ORDER BY roe DESC, ticker LIMIT 4) UNION ALL
(SELECT 'breakout', ticker FROM xsection WHERE price_vs_ma50 > 0.1 AND return_3m > 0.1 ORDER BY return_3m DESC, ticker LIMIT 3) UNION ALL
(SELECT 'oversold', ticker FROM xsection WHERE rsi_14 < 30 AND roe > 0.1 ORDER BY rsi_14, ticker LIMIT 3)"""


@query(OPPORTUNITY, "xsection")
def top_02_opportunities(t: Tables):
    x = t.xsection
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "ticker")
    dip = kind(x.where("pct_from_52w_high < -0.2 AND roe > 0.2").orderBy(F.col("roe").desc(), "ticker").limit(4), "dip")
    up = kind(x.where("price_vs_ma50 > 0.1 AND return_3m > 0.1").orderBy(F.col("return_3m").desc(), "ticker").limit(3), "breakout")
    low = kind(x.where("rsi_14 < 30 AND roe > 0.1").orderBy("rsi_14", "ticker").limit(3), "oversold")
    return dip.unionByName(up).unionByName(low)


@query(f"SELECT ticker, round({mean_sql('rsi_14', 'roa', 'beta')}, 6) AS mean FROM xsection", "xsection")
def fn_05_row_mean(t: Tables):
    return t.xsection.select("ticker", r6(row_mean("rsi_14", "roa", "beta"), "mean"))


@query("SELECT ticker, round(free_cash_flow / nullif(market_cap, 0), 6) AS fcf_yield, round(sign(free_cash_flow) * ln(1 + abs(free_cash_flow)), 6) AS signed_log, round(sqrt(avg_volume), 6) AS root FROM xsection", "xsection")
def fn_01_math(t: Tables):
    return t.xsection.select("ticker", r6(ratio("free_cash_flow", "market_cap"), "fcf_yield"), r6(F.signum("free_cash_flow") * F.log1p(F.abs("free_cash_flow")), "signed_log"), r6(F.sqrt("avg_volume"), "root"))
