"""Queries over fundamentals: small-company filters and scores, accounting scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import fundamentals as A
from tallyloom.plans.cross_section import USD, as_sql, r6, rank_sql
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

BURN = "CASE WHEN operating_cashflow < 0 THEN -operating_cashflow / 12 END"
PASS = f"""current_price > 0 AND coalesce(avg_volume * current_price >= 150000, false) AND (market_cap IS NULL OR market_cap = 0 OR market_cap * {USD} / 0.095 BETWEEN 20e6 AND 10e9)
  AND (book_value IS NULL OR book_value >= 0) AND (debt_to_equity IS NULL OR debt_to_equity <= 300) AND (current_ratio IS NULL OR current_ratio >= 0.5)
  AND coalesce(total_cash / nullif({BURN}, 0) >= 6, true) AND (piotroski_f IS NULL OR piotroski_f > 2) AND (shares_change_pct IS NULL OR shares_change_pct <= 0.20)"""


@query(f"SELECT ticker FROM smallcap WHERE {PASS}", "smallcap")
def flt_06_small_cap_filters(t: Tables):
    return A.small_cap_filter(t.smallcap).select("ticker")


OR = lambda c, d: f"(CASE WHEN {c} IS NULL OR {c} = 0 THEN {d} ELSE {c} END)"
FLAGS = f"""list_filter([CASE WHEN {OR('debt_to_equity', 0)} > 150 THEN 'high debt' END, CASE WHEN {OR('current_ratio', 2)} < 1.0 THEN 'low liquidity' END, CASE WHEN {OR('piotroski_f', 5)} <= 3 THEN 'weak accounts' END,
  CASE WHEN {OR('gross_margin', 0)} < 0.15 THEN 'low gross margin' END, CASE WHEN {OR('dividend_yield', 0)} > 0.08 THEN 'suspect yield' END, CASE WHEN {OR('insider_pct', 0)} < 0.03 THEN 'few insiders' END,
  CASE WHEN {OR('free_cash_flow', 1)} < 0 THEN 'negative cash flow' END, CASE WHEN {OR('operating_cashflow', 1)} < 0 AND coalesce(total_cash, 0) > 0 AND coalesce(total_cash, 0) / (-{OR('operating_cashflow', 1)} / 12) < 18 THEN 'short runway' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT ticker, array_to_string({FLAGS}, ' * ') AS flags, len({FLAGS})::BIGINT AS n_flags FROM smallcap", "smallcap")
def flt_07_red_flags(t: Tables):
    return t.smallcap.withColumn("f", A.red_flags()).select("ticker", F.array_join("f", " * ").alias("flags"), F.size("f").cast("long").alias("n_flags"))


@query(f"SELECT ticker, round(total_cash / nullif({BURN}, 0), 6) AS months, CASE WHEN coalesce(operating_cashflow, 0) >= 0 THEN 'POSITIVE' WHEN total_cash / nullif({BURN}, 0) < 6 THEN 'CRITICAL' WHEN total_cash / nullif({BURN}, 0) < 12 THEN 'WARNING' ELSE 'OK' END AS status FROM smallcap", "smallcap")
def flt_08_cash_runway(t: Tables):
    m = A.runway_months()
    status = F.when(F.coalesce("operating_cashflow", F.lit(0.0)) >= 0, "POSITIVE").when(m < 6, "CRITICAL").when(m < 12, "WARNING").otherwise("OK")
    return t.smallcap.select("ticker", r6(m, "months"), status.alias("status"))


NET = "coalesce(insider_net_buy_6m, 0.0)"
RAW = {
    "r_own": ("coalesce(insider_pct, 0.0)", True),
    "r_net": (f"sign({NET}) * ln(1 + abs({NET}))", True),
    "r_conviction": (f"CASE WHEN market_cap > 0 AND {NET} > 0 THEN least(greatest({NET} / market_cap, 0.0), 0.10) * 1000 ELSE 0.0 END", True),
    "r_fcf": ("coalesce(s_fcf, median(s_fcf) OVER (PARTITION BY as_of))", True),
    "r_revenue": ("coalesce(revenue_growth, 0.0)", True),
    "r_earnings": ("coalesce(earnings_growth, 0.0)", True),
    "r_debt": ("coalesce(debt_to_equity, 100.0)", False),
    "r_current": ("coalesce(current_ratio, 1.0)", True),
    "r_value": ("coalesce(s_value, median(s_value) OVER (PARTITION BY as_of))", False),
    "r_momentum": ("coalesce(return_12m, 0.0) * 0.65 + coalesce(return_6m, 0.0) * 0.35", True),
    "r_liquidity": ("coalesce(avg_volume, 0.0) * coalesce(current_price, 0.0)", True),
}


def winsor_rank(source: str, raw: dict, tag: str) -> str:
    q = ", ".join(f"quantile_cont({n}, 0.05) AS lo_{n}, quantile_cont({n}, 0.95) AS hi_{n}" for n in raw)
    w = ", ".join(f"least(greatest({n}, lo_{n}), hi_{n}) AS {n}" for n in raw)
    r = ", ".join(f"{rank_sql(n, up)} AS {n}" for n, (_, up) in raw.items())
    return f"q{tag} AS (SELECT as_of, {q} FROM {source} GROUP BY as_of), w{tag} AS (SELECT {source}.* REPLACE ({w}) FROM {source} JOIN q{tag} USING (as_of)), k{tag} AS (SELECT w{tag}.* REPLACE ({r}) FROM w{tag})"


POINTS = "CASE coalesce(piotroski_f, 4) " + " ".join(f"WHEN {k} THEN {v}" for k, v in A.PIOTROSKI_POINTS.items()) + " ELSE 40.0 END"
SMALL = f"""WITH b AS (SELECT *, CASE WHEN market_cap > 0 AND free_cash_flow IS NOT NULL THEN greatest(free_cash_flow / market_cap, 0.0) END AS s_fcf,
  coalesce(CASE WHEN ev_to_ebitda > 0 THEN ev_to_ebitda END, CASE WHEN price_to_book > 0 THEN price_to_book END) AS s_value FROM smallcap),
m AS (SELECT *, {', '.join(f'{e} AS {n}' for n, (e, _) in RAW.items())} FROM b), {winsor_rank('m', RAW, '1')},
o AS (SELECT *, r_own * 0.7 + CASE WHEN coalesce(insider_pct, 0) > 0.20 THEN 6.0 ELSE 0.0 END AS r_own2 FROM k1), {winsor_rank('o', {'r_own2': ('', True)}, '2')},
s AS (SELECT *, greatest(0.0, least(100.0, r_own2 * 0.40 + r_net * 0.35 + (r_conviction * 0.6 + CASE WHEN insider_buy_count >= 3 THEN 20.0 WHEN insider_buy_count >= 2 THEN 5.0 ELSE 0.0 END * 0.4) * 0.25)) AS sc_insider,
  {POINTS} AS sc_piotroski, r_revenue * 0.6 + r_earnings * 0.4 AS sc_growth, r_debt * 0.55 + r_current * 0.45 AS sc_balance FROM k2),
z AS (SELECT *, greatest(0.0, least(110.0, sc_insider * 0.18 + r_fcf * 0.16 + sc_piotroski * 0.15 + sc_growth * 0.13 + sc_balance * 0.12 + r_value * 0.12 + r_momentum * 0.09 + r_liquidity * 0.05
  + CASE WHEN coalesce(total_cash, 0) > coalesce(total_debt, 0) THEN 5.0 ELSE 0.0 END + CASE WHEN coalesce(insider_pct, 0) > 0.20 THEN 3.0 ELSE 0.0 END + CASE WHEN coalesce(gross_margin, 0) > 0.40 THEN 3.0 ELSE 0.0 END
  - CASE WHEN coalesce(shares_change_pct, 0) > 0.10 THEN 10.0 ELSE 0.0 END - CASE WHEN coalesce(piotroski_f, 5) < 3 THEN 5.0 ELSE 0.0 END - CASE WHEN coalesce(debt_to_equity, 0) > 200 THEN 3.0 ELSE 0.0 END)) AS sc_total FROM s)
SELECT ticker, round(sc_insider, 6) AS sc_insider, round(r_fcf, 6) AS sc_fcf, round(sc_growth, 6) AS sc_growth, round(sc_balance, 6) AS sc_balance, round(r_value, 6) AS sc_value, round(sc_total, 6) AS sc_total,
  rank() OVER (PARTITION BY as_of ORDER BY round(sc_total, 9) DESC)::BIGINT AS sc_rank FROM z"""


@query(SMALL, "smallcap")
def scr_23_26_small_cap_scores(t: Tables):
    out = A.small_cap_scores(t.smallcap)
    return out.select("ticker", *[as_sql(c) for c in ("sc_insider", "sc_fcf", "sc_growth", "sc_balance", "sc_value", "sc_total")], F.col("sc_rank").cast("long").alias("sc_rank"))


YES = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
FIN = "coalesce(sector IN ('Financial Services', 'Real Estate', 'Insurance'), false)"
OCF = f"coalesce({OR('operating_cashflow', 'NULL')}, free_cash_flow)"
ASSETS = "CASE WHEN price_to_book > 0 THEN market_cap / price_to_book END"


def compare(c: str, better: str, level: str) -> str:
    return f"CASE WHEN {c}_was IS NOT NULL AND {c} IS NOT NULL THEN {YES(better)} ELSE {YES(level)} END"


PRIOR = """prior AS (SELECT ticker, CAST(as_of - INTERVAL '365' DAY AS DATE) AS snapshot_date, roa * 0.95 AS roa_was, debt_to_equity + 3 AS debt_to_equity_was, current_ratio - 0.1 AS current_ratio_was, gross_margin + 0.01 AS gross_margin_was, operating_margin - 0.01 AS operating_margin_was FROM smallcap WHERE pk % 3 = 0
  UNION ALL SELECT ticker, CAST(as_of - INTERVAL '700' DAY AS DATE), 9.0, 0.0, 99.0, 9.0, 9.0 FROM smallcap WHERE pk % 2 = 0)"""
F9 = f"""WITH {PRIOR}, n AS (SELECT s.*, p.* EXCLUDE (ticker, snapshot_date) FROM smallcap s LEFT JOIN (SELECT p.*, row_number() OVER (PARTITION BY p.ticker ORDER BY p.snapshot_date DESC) AS k FROM prior p JOIN smallcap x ON x.ticker = p.ticker AND datediff('day', p.snapshot_date, x.as_of) BETWEEN 180 AND 550) p ON p.ticker = s.ticker AND p.k = 1),
f AS (SELECT ticker, CASE WHEN {FIN} THEN {YES('roe > 0')} ELSE {YES('roa > 0')} END + {compare('roa', 'roa > roa_was', 'earnings_growth > 0')} + {YES(OCF + ' > 0')}
  + CASE WHEN ({ASSETS}) IS NOT NULL AND {OCF} IS NOT NULL AND roa IS NOT NULL THEN {YES(f'{OCF} / nullif({ASSETS}, 0) > roa')} ELSE {YES('market_cap > 0 AND free_cash_flow / market_cap > roa')} END
  + {compare('debt_to_equity', 'debt_to_equity < debt_to_equity_was', 'debt_to_equity < 100')} + CASE WHEN {FIN} THEN {YES('profit_margin > 0')} ELSE {compare('current_ratio', 'current_ratio > current_ratio_was', 'current_ratio > 1.5')} END
  + CASE WHEN insider_pct IS NOT NULL THEN {YES('insider_pct > 0.03')} ELSE 1 END
  + CASE WHEN {FIN} THEN {YES('roe > 0.10')} ELSE {compare('gross_margin', 'gross_margin > gross_margin_was', 'gross_margin > 0.30 AND (revenue_growth IS NULL OR revenue_growth > 0)')} END
  + CASE WHEN {FIN} THEN {YES('operating_margin > 0.05')} ELSE {compare('operating_margin', 'operating_margin > operating_margin_was', 'CASE WHEN revenue_growth IS NOT NULL THEN operating_margin > 0.10 AND revenue_growth > 0 ELSE operating_margin > 0.15 END')} END AS f FROM n)
SELECT ticker, f::BIGINT AS f_score, CASE WHEN f >= 7 THEN 'STRONG' WHEN f >= 4 THEN 'NEUTRAL' ELSE 'WEAK' END AS f_label FROM f"""


@query(F9, "smallcap")
def scr_29_f_score(t: Tables):
    x = t.smallcap
    a = x.where("pk % 3 = 0").select("ticker", F.date_sub("as_of", 365).alias("snapshot_date"), (F.col("roa") * 0.95).alias("roa"), (F.col("debt_to_equity") + 3).alias("debt_to_equity"), (F.col("current_ratio") - 0.1).alias("current_ratio"), (F.col("gross_margin") + 0.01).alias("gross_margin"), (F.col("operating_margin") - 0.01).alias("operating_margin"))
    b = x.where("pk % 2 = 0").select("ticker", F.date_sub("as_of", 700).alias("snapshot_date"), F.lit(9.0).alias("roa"), F.lit(0.0).alias("debt_to_equity"), F.lit(99.0).alias("current_ratio"), F.lit(9.0).alias("gross_margin"), F.lit(9.0).alias("operating_margin"))
    return A.f_score(x, a.unionByName(b)).select("ticker", F.col("f_score").cast("long").alias("f_score"), "f_label")


D = lambda a, b: f"(({a}) / nullif({b}, 0))"
INDICES = {
    "dsri": D(D("receivables", "total_revenue"), D("receivables_prev", "revenue_prev")),
    "gmi": D(f"1 - {D('cogs_prev', 'revenue_prev')}", f"1 - {D('cogs', 'total_revenue')}"),
    "aqi": D(f"1 - {D('receivables + ppe', 'assets')}", f"1 - {D('receivables_prev + ppe_prev', 'assets_prev')}"),
    "sgi": D("total_revenue", "revenue_prev"),
    "depi": D(D("depreciation_prev", "depreciation_prev + ppe_prev"), D("depreciation", "depreciation + ppe")),
    "sgai": D(D("sga", "total_revenue"), D("sga_prev", "revenue_prev")),
    "tata": D("net_income - operating_cashflow", "assets"),
    "lvgi": D(D("debt_now + liabilities", "assets"), D("debt_prev + liabilities_prev", "assets_prev")),
}
MS = f"""WITH i AS (SELECT ticker, {', '.join(f'{e} AS {n}' for n, e in INDICES.items())} FROM smallcap),
m AS (SELECT ticker, CASE WHEN {' + '.join(YES(f'{n} IS NOT NULL') for n in INDICES)} >= 3 THEN -4.84 + {' + '.join(f'coalesce({n} * ({w}), 0)' for n, w in A.BENEISH.items())} END AS m FROM i)
SELECT ticker, round(m, 5) AS m_score, CASE WHEN m > -1.78 THEN 'HIGH' WHEN m > -2.22 THEN 'GREY' WHEN m IS NOT NULL THEN 'LOW' ELSE 'UNKNOWN' END AS m_band FROM m"""


@query(MS, "smallcap")
def scr_33_m_score(t: Tables):
    return A.m_score(t.smallcap).select("ticker", F.round("m_score", 5).alias("m_score"), "m_band")


@query("SELECT ticker, greatest(0.0, least(100.0, roe * 200 + (CASE WHEN piotroski_f >= 7 THEN 8.0 WHEN piotroski_f <= 3 THEN -8.0 ELSE 0.0 END))) AS boosted FROM xsection WHERE roe IS NOT NULL", "xsection")
def scr_30_boost(t: Tables):
    from tallyloom.functions.stats import clip

    boost = F.when(F.col("piotroski_f") >= 7, 8.0).when(F.col("piotroski_f") <= 3, -8.0).otherwise(0.0)
    return t.xsection.where("roe is not null").select("ticker", clip(F.col("roe") * 200 + boost, 0.0, 100.0).alias("boosted"))


def early_view(t: Tables):
    c = F.col
    x = t.smallcap
    return x.select("as_of", "pk", "ticker", "sector", "market_cap", "free_cash_flow", "price_to_sales", c("total_revenue").alias("revenue_ttm"), (c("total_revenue") * (0.8 + c("pk") % 5 / 10.0)).alias("revenue_prev"), (c("total_revenue") * 0.7).alias("revenue_2y"), (c("total_revenue") * c("operating_margin")).alias("op_ttm"), (c("total_revenue") * 0.1).alias("op_prev"), "net_income", "operating_cashflow", "assets", "assets_prev", "piotroski_f", "roa")


GROW = "(revenue_ttm / nullif(revenue_prev, 0) - 1)"
MEAN = "((assets + assets_prev) / 2)"
INSURER = "coalesce(sector IN ('Financial Services', 'Insurance'), false)"
EARLY_RAW = {
    "e_fcf": ("CASE WHEN free_cash_flow < 0 THEN 0.0 ELSE free_cash_flow END / nullif(market_cap, 0)", True),
    "e_size": ("nullif(market_cap, 0)", False),
    "e_ps": (f"CASE WHEN price_to_sales > 0 AND NOT {INSURER} THEN price_to_sales END", False),
    "e_leverage": (f"CASE WHEN {GROW} > 0 AND revenue_prev > 0 AND op_prev > 0 AND op_ttm > 0 THEN least(greatest((op_ttm / op_prev - 1) / {GROW}, 0.0), 10.0) END", True),
    "e_accel": (f"CASE WHEN revenue_prev > 0 AND revenue_2y > 0 THEN {GROW} - (sqrt(revenue_ttm / revenue_2y) - 1) END", True),
    "e_accruals": (f"CASE WHEN {MEAN} > 0 THEN (net_income - operating_cashflow) / {MEAN} END", False),
}
COVER = " + ".join(f"(CASE WHEN {x} THEN 1 ELSE 0 END)" for x in ("free_cash_flow IS NOT NULL AND market_cap IS NOT NULL", "market_cap > 10000000", f"price_to_sales > 0 AND NOT {INSURER}", "revenue_prev > 0 AND op_prev > 0 AND op_ttm > 0", "revenue_prev > 0 AND revenue_2y > 0", f"net_income IS NOT NULL AND operating_cashflow IS NOT NULL AND {MEAN} > 0"))
EARLY = f"""WITH v AS (SELECT *, total_revenue AS revenue_ttm, total_revenue * (0.8 + (pk % 5) / 10.0) AS rp, total_revenue * 0.7 AS revenue_2y, total_revenue * operating_margin AS op_ttm, total_revenue * 0.1 AS op_prev FROM smallcap),
u AS (SELECT * EXCLUDE (revenue_prev, rp), rp AS revenue_prev FROM v), a0 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, (e, _) in EARLY_RAW.items())} FROM u),
a1 AS (SELECT * REPLACE ({', '.join(f'coalesce({n}, median({n}) OVER (PARTITION BY as_of)) AS {n}' for n in EARLY_RAW)}) FROM a0), {winsor_rank('a1', EARLY_RAW, '9')},
z AS (SELECT *, greatest(0.0, least(100.0, e_fcf * 0.25 + CASE WHEN market_cap >= 10000000 THEN e_size ELSE 50.0 END * 0.15 + e_ps * 0.15 + e_leverage * 0.20 + e_accel * 0.15 + e_accruals * 0.10)) AS s, {COVER} AS cover FROM k9)
SELECT ticker, round(s, 6) AS early_score, cover::BIGINT AS early_coverage, coalesce(s >= 59.5 AND piotroski_f >= 5 AND roa > 0 AND cover >= 3 AND free_cash_flow IS NOT NULL AND market_cap IS NOT NULL, false) AS early_candidate FROM z"""


@query(EARLY, "smallcap")
def scr_27_28_early_warning(t: Tables):
    return A.early_warning(early_view(t)).select("ticker", as_sql("early_score"), F.col("early_coverage").cast("long").alias("early_coverage"), "early_candidate")
