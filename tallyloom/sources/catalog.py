"""Tables and the derived views that market-style operators read.

Views are SQL text that Spark and other engines run alike; placeholders in braces
stand for tables or for earlier views, {lines} for the rows that a view groups, and names of LINES for its sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Sector names, by position.
SECTORS = ["Technology", "Healthcare", "Financial Services", "Consumer Cyclical", "Industrials", "Communication Services", "Consumer Defensive", "Energy", "Real Estate", "Basic Materials", "Utilities", "Conglomerates"]
# Industries, by position.
INDUSTRIES = ["software", "biotechnology", "asset management", "auto parts", "steel", "gold", "beverages", "oil & gas e&p", "reit - office"]
# Venue suffix and currency of each region key.
VENUES = [(".ST", "SEK"), ("", "USD"), (".HK", "HKD"), (".DE", "EUR"), (".L", "GBP")]

# Sums of doubles depend on the order of rows. Numbers of up to six decimals are summed as integers here, so that
# a mean that stands on a threshold stays there; a group with any other number keeps the plain mean.
_MILLIONTHS = "CASE WHEN abs(l_discount) <= 1000 AND rint(l_discount * 1000000e0) / 1000000e0 = l_discount THEN CAST(rint(l_discount * 1000000e0) AS BIGINT) END"
EXACT_MEAN = f"CASE WHEN count({_MILLIONTHS}) = count(l_discount) THEN sum({_MILLIONTHS}) / (count(l_discount) * 1000000e0) ELSE {{plain}} END"


def _case(key: str, values: list) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


VIEWS: dict[str, str] = {}

VIEWS["xsection"] = f"""
SELECT as_of, concat('T', lpad(CAST(pk AS STRING), 6, '0'), {_case('rk', [v for v, _ in VENUES])}) AS ticker, pname AS name,
  {_case('pk % 13', SECTORS)} AS sector, {_case('pk % 9', INDUSTRIES)} AS industry, {_case('rk', [c for _, c in VENUES])} AS currency,
  CAST(price AS DOUBLE) AS current_price,
  CASE WHEN pk % 29 = 0 THEN NULL ELSE cap * 1000.0e0 END AS market_cap,
  CASE WHEN pk % 31 = 0 THEN -1.0e0 ELSE cap * 1100.0e0 + (pk % 7) * 10000.0e0 END AS enterprise_value,
  CASE WHEN pk % 41 = 0 THEN NULL ELSE vol * 10.0e0 END AS avg_volume,
  CASE WHEN pk % 17 = 0 THEN NULL WHEN pk % 97 = 0 THEN 950.0e0 ELSE 4 + (pk * 37 % 401) / 10.0e0 END AS pe_trailing,
  CASE WHEN pk % 19 = 0 THEN NULL ELSE 1 + (pk * 53 % 389) / 10.0e0 END AS pe_forward,
  CASE WHEN pk % 23 = 0 THEN NULL ELSE (pk * 29 % 157) / 10.0e0 - 0.6e0 END AS price_to_book,
  CASE WHEN pk % 37 = 0 THEN NULL ELSE (pk * 43 % 211) / 20.0e0 END AS price_to_sales,
  CASE WHEN pk % 27 = 0 THEN NULL ELSE (pk * 31 % 263) / 10.0e0 - 1 END AS ev_to_ebitda,
  CASE WHEN pk % 21 = 0 THEN NULL ELSE cap * ((pk * 17 % 113) - 25) END AS free_cash_flow,
  cap * (pk % 11) * 100.0e0 AS total_debt, cap * (pk % 5) * 100.0e0 AS total_cash, cap * 400.0e0 AS total_revenue,
  CASE WHEN pk % 33 = 0 THEN NULL ELSE (pk * 61 % 523) - 5.0e0 END AS debt_to_equity,
  CASE WHEN pk % 34 = 0 THEN NULL ELSE (pk * 7 % 71) / 10.0e0 END AS current_ratio,
  CASE WHEN pk % 18 = 0 THEN NULL ELSE (pk * 13 % 101) / 200.0e0 - 0.1e0 END AS roe,
  CASE WHEN pk % 22 = 0 THEN NULL ELSE (pk * 11 % 89) / 400.0e0 - 0.05e0 END AS roa,
  1 - disc - 0.9e0 AS profit_margin, (pk * 19 % 97) / 240.0e0 - 0.05e0 AS operating_margin,
  CASE WHEN pk % 26 = 0 THEN -0.1e0 ELSE (pk * 23 % 103) / 200.0e0 + 0.2e0 END AS gross_margin,
  CASE WHEN pk % 39 = 0 THEN NULL WHEN pk % 101 = 0 THEN 700.0e0 ELSE (pk * 41 % 140) / 200.0e0 - 0.2e0 END AS revenue_growth,
  CASE WHEN pk % 42 = 0 THEN NULL ELSE (pk * 47 % 180) / 200.0e0 - 0.3e0 END AS earnings_growth,
  (pk * 59 % 160) / 200.0e0 - 0.3e0 AS earnings_quarterly_growth,
  CASE WHEN pk % 6 = 0 THEN NULL ELSE tax END AS dividend_yield, (pk * 3 % 31) / 20.0e0 AS payout_ratio,
  CASE WHEN pk % 16 = 0 THEN NULL WHEN cap_prior > 0 THEN cap_year / cap_prior - 1 END AS return_12m,
  (pk * 67 % 140) / 200.0e0 - 0.2e0 AS return_6m, (pk * 71 % 90) / 200.0e0 - 0.15e0 AS return_3m,
  volat AS volatility, CASE WHEN pk % 14 = 0 THEN NULL ELSE 0.5e0 + (pk * 5 % 31) / 20.0e0 END AS beta,
  -(pk * 73 % 61) / 200.0e0 AS pct_from_52w_high, (pk * 79 % 81) / 200.0e0 - 0.15e0 AS price_vs_ma200, (pk * 83 % 51) / 200.0e0 - 0.1e0 AS price_vs_ma50,
  CASE WHEN pk % 25 = 0 THEN NULL ELSE 20.0e0 + pk * 7 % 61 END AS rsi_14,
  CASE WHEN pk % 24 = 0 THEN NULL ELSE (pk * 89 % 201) / 100.0e0 - 1 END AS sentiment_raw,
  CASE WHEN pk % 28 = 0 THEN NULL ELSE (pk * 91 % 260) / 1000.0e0 END AS short_pct_float,
  CASE WHEN pk % 9 = 0 THEN NULL ELSE 0.1e0 + (pk * 97 % 81) / 100.0e0 END AS options_flow_signal,
  CASE WHEN pk % 5 = 0 THEN NULL ELSE (pk * 101 % 100) / 100.0e0 END AS earnings_surprise,
  CASE WHEN pk % 7 = 0 THEN NULL ELSE (pk * 103 % 100) / 200.0e0 - 0.2e0 END AS earnings_revision_rate,
  pk % 15 = 0 AS insider_executive_buy, pk % 35 = 0 AS insider_cluster,
  CASE WHEN pk % 30 = 0 THEN NULL ELSE CAST(pk * 7 % 240 AS INT) END AS insider_days,
  1 + (pk * 107 % 41) / 10.0e0 AS recommendation_mean, CAST(pk % 10 AS INT) AS piotroski_f, pk AS pk
FROM (
  SELECT l_partkey AS pk, any_value(p_name) AS pname, any_value(p_retailprice) AS price, CAST(l_partkey % 5 AS INT) AS rk, max(last_day) AS as_of,
    {{cap}} AS cap, {{vol}} AS vol, {{disc}} AS disc, {{tax}} AS tax,
    {{spread}} / {{mean_price}} AS volat,
    {{cap_year}} AS cap_year,
    {{cap_prior}} AS cap_prior
  FROM {{lines}}
  GROUP BY l_partkey)"""

VIEWS["smallcap"] = """
SELECT *, CASE WHEN pk % 11 = 0 THEN NULL ELSE (pk * 109 % 40) / 100e0 END AS insider_pct, CASE WHEN pk % 8 = 0 THEN NULL ELSE (pk * 113 % 2001 - 900) * 1000e0 END AS insider_net_buy_6m,
  CAST(pk % 5 AS INT) AS insider_buy_count, (pk * 127 % 90) - 4e0 AS book_value, CASE WHEN pk % 12 = 0 THEN NULL ELSE market_cap * ((pk * 131 % 100) - 30) / 1000e0 END AS operating_cashflow,
  (pk * 137 % 40) / 100e0 - 0.1e0 AS shares_change_pct, total_revenue * 0.9e0 AS revenue_prev, total_revenue * (0.5e0 + (pk % 5) / 20e0) AS cogs, total_revenue * (0.52e0 + (pk % 4) / 20e0) * 0.9e0 AS cogs_prev,
  total_revenue * (0.1e0 + (pk % 7) / 50e0) AS receivables, total_revenue * 0.12e0 AS receivables_prev, market_cap * 0.8e0 AS assets, market_cap * 0.7e0 AS assets_prev,
  CASE WHEN pk % 10 = 0 THEN NULL ELSE market_cap * 0.3e0 END AS ppe, market_cap * 0.28e0 AS ppe_prev, market_cap * 0.02e0 AS depreciation, market_cap * 0.025e0 AS depreciation_prev,
  total_revenue * 0.2e0 AS sga, total_revenue * 0.19e0 AS sga_prev, total_debt * 1.05e0 AS debt_now, total_debt AS debt_prev, total_cash AS liabilities, total_cash * 0.9e0 AS liabilities_prev, market_cap * roe * 0.1e0 AS net_income
FROM {xsection}"""

VIEWS["bars"] = """
SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS ts, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, avg(o_totalprice) AS close, count(*) AS volume
FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)"""

VIEWS["listings"] = f"""
SELECT concat(n_name, {_case('n_regionkey', [v for v, _ in VENUES])}) AS ticker, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS close, count(*) AS volume
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey, CAST(o_orderdate AS DATE)"""

VIEWS["rates"] = """
SELECT CAST(l_shipdate AS DATE) AS ts, round(avg(l_tax) * 100, 6) AS long, round(avg(l_discount) * 60, 6) AS short FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)"""

VIEWS["panel"] = """
SELECT month, ticker, pred, actual, CAST(ticker % 11 AS INT) AS sector_id FROM (
  SELECT month, ticker, pred, total, (ticker * 7919 % 1009) / 1009e0 + total / 1000000e0 AS actual
  FROM (SELECT date_trunc('month', CAST(o_orderdate AS DATE)) AS month_ts, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month,
      o_custkey AS ticker, avg(o_totalprice) AS pred, sum(o_totalprice) AS total FROM {orders}
    GROUP BY date_trunc('month', CAST(o_orderdate AS DATE)), o_custkey))"""

VIEWS["snapshots"] = """
SELECT month AS snapshot_date, concat('C', CAST(ticker AS STRING)) AS ticker, CAST(floor(round(pred, 4) / 100) % 101 AS DOUBLE) AS score_total,
  CAST((ticker * 37 + month(month) * 13 + year(month) * 5) % 71 AS DOUBLE) + 15 AS rsi_14, pred / 100 AS close, sector_id,
  CASE WHEN floor(round(pred, 4) / 100) % 101 >= 80 THEN 'STRONG' WHEN floor(round(pred, 4) / 100) % 101 >= 60 THEN 'OK' ELSE 'WAIT' END AS entry_signal FROM {panel}"""

VIEWS["ledger"] = """
SELECT l_suppkey AS ticker, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS kind, l_quantity AS shares, l_extendedprice / l_quantity AS price,
  CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_shipdate AS DATE) + INTERVAL '3653' DAY AS DATE) ELSE CAST(l_shipdate AS DATE) END AS day,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) + INTERVAL '3653' DAY ELSE CAST(l_shipdate AS DATE) END,
    l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq
FROM {lineitem}"""

VIEWS["chain"] = """
SELECT CAST(p_brand AS STRING) AS ticker, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, CAST(p_size * 10 AS DOUBLE) AS strike,
  CAST(30 * (1 + p_partkey % 6) AS INT) AS days, p_partkey AS contract, CAST(sum(l_quantity) AS BIGINT) AS open_interest, CAST(sum(l_linenumber) * 10 AS BIGINT) AS volume,
  {tax} * 100 AS last_price, 0.1e0 + {disc} AS iv, 250e0 AS spot
FROM {lines} GROUP BY p_brand, p_partkey, p_size"""

#: By view: the rows that it groups, what it groups them by, and its sums of numbers that aren't whole.
LINES: dict[str, tuple[str, str, dict[str, str]]] = {
    "xsection": (
        """{lineitem} JOIN {part} ON l_partkey = p_partkey
    CROSS JOIN (SELECT max(CAST(l_shipdate AS DATE)) AS last_day FROM {lineitem}) m""",
        "l_partkey",
        {
            "cap": "sum(l_extendedprice)",
            "vol": "sum(l_quantity)",
            "disc": "avg(l_discount)",
            "tax": "avg(l_tax)",
            "spread": "stddev_samp(l_extendedprice)",
            "mean_price": "avg(l_extendedprice)",
            "cap_year": "sum(CASE WHEN CAST(l_shipdate AS DATE) > last_day - INTERVAL '365' DAY THEN l_extendedprice ELSE 0 END)",
            "cap_prior": "sum(CASE WHEN CAST(l_shipdate AS DATE) <= last_day - INTERVAL '365' DAY AND CAST(l_shipdate AS DATE) > last_day - INTERVAL '730' DAY THEN l_extendedprice ELSE 0 END)",
        },
    ),
    "chain": ("{lineitem} JOIN {part} ON l_partkey = p_partkey", "p_brand, p_partkey, p_size", {"tax": "avg(l_tax)", "disc": "avg(l_discount)"}),
}


def grouped(name: str, in_order: bool, mean: str) -> str:
    """A view's SQL with the rows that it groups and their sums; mean is put for the mean discount, {plain} in it for the plain one.

    in_order: each group's numbers are added in the order of the table's rows, as one thread of an engine adds them, however
    the rows are dealt out.  Means that are equal but for their last bits rank apart, so that other orders give other ranks.
    """
    rows, by, sums = LINES[name]
    totals = {c: f"max_by(run_{c}, its_line)" if in_order else f"{e}" for c, e in sums.items()}
    if in_order:
        running = ", ".join(f"{e} OVER run AS run_{c}" for c, e in sums.items())
        rows = f"(SELECT *, {running}, count(*) OVER run AS its_line FROM {rows} WINDOW run AS (PARTITION BY {by} ORDER BY its_file, its_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) its_lines"
    totals["disc"] = mean.replace("{plain}", totals["disc"])
    body = VIEWS[name].replace("{lines}", rows)
    for c, total in totals.items():
        body = body.replace("{" + c + "}", total)
    return body


def text(name: str, source, in_order: bool = False, mean: str = "{plain}") -> str:
    """SQL of a view; source(table) is what stands for a table, with columns its_file and its_row if sums are in_order."""
    body = grouped(name, in_order, mean) if name in LINES else VIEWS[name]
    for other in VIEWS:
        if "{" + other + "}" in body:
            body = body.replace("{" + other + "}", f"({text(other, source, in_order, mean)}) {other}_rows")
    for table in TABLES:
        body = body.replace("{" + table + "}", source(table))
    return body


class Tables:
    """Tables and views of a folder of parquet files, each read when first used."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def view(self, name: str, in_order: bool = True, mean: str = "{plain}") -> DataFrame:
        def source(table: str) -> str:
            rows = f"parquet.`{self.path}/{table}.parquet`"
            return f"(SELECT *, _metadata.file_path AS its_file, _metadata.row_index AS its_row FROM {rows}) {table}" if in_order and table == "lineitem" else rows

        return self.spark.sql(text(name, source, in_order, mean))

    def exact(self, name: str) -> DataFrame:
        """A view whose mean discounts don't depend on the order of rows, for fixed thresholds on margins."""
        return self.view(name, in_order=False, mean=EXACT_MEAN)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def oracle(body: str, *views: str) -> str:
    """SQL for another engine: the views as common table expressions, then the query."""
    ctes = ",\n".join(f"{v} AS ({text(v, lambda t: t).replace('STRING', 'VARCHAR')})" for v in views)
    if not ctes:
        return body.strip()
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
