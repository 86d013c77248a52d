"""Cleaning rules, derived flags, signals and predicate filters on the cross-section."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import known

# Venue suffixes by group, first match wins, none is US.
VENUE_GROUPS = {
    ".ST": "Nordic", ".HE": "Nordic", ".CO": "Nordic", ".OL": "Nordic",
    ".L": "UK",
    ".DE": "Europe", ".PA": "Europe", ".AS": "Europe", ".MI": "Europe", ".MC": "Europe", ".VI": "Europe", ".WA": "Europe", ".LS": "Europe", ".SW": "Europe",
    ".TO": "Canada", ".AX": "Australia", ".T": "Japan",
    ".HK": "Asia", ".TW": "Asia", ".KS": "Asia",
    ".NS": "India", ".BO": "India",
    ".SA": "LatAm", ".MX": "LatAm",
    ".SI": "Singapore",
}
# US dollars for one unit of a currency.
USD = {
    "SEK": 0.095, "NOK": 0.093, "DKK": 0.143, "EUR": 1.08, "GBP": 1.27, "JPY": 0.0065, "HKD": 0.128, "KRW": 0.00073, "TWD": 0.031,
    "AUD": 0.65, "CAD": 0.73, "INR": 0.012, "BRL": 0.18, "MXN": 0.052, "CHF": 1.12, "SGD": 0.74, "CNY": 0.138, "USD": 1.0,
}
MIN_TURNOVER = 50_000.0
FINANCIAL = "(?i)(Financial|Real Estate|Insurance|Bank|REIT)"


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def venue_group(ticker: str = "ticker") -> Column:
    return lookup(VENUE_GROUPS, F.regexp_extract(F.upper(ticker), r"(\.[A-Z]+)$", 1), "US")


def with_groups(df: DataFrame) -> DataFrame:
    return df.withColumn("exchange_group", venue_group())


def to_number(c: str) -> Column:
    """Numbers out of dirty text: blanks and thousands marks go, decimal commas become points, infinities are missing."""
    n = F.regexp_replace(F.regexp_replace(F.col(c), r"[\s\u00a0]", ""), ",", ".").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def is_financial() -> Column:
    return known(F.col("sector").rlike(FINANCIAL))


def sane(df: DataFrame) -> DataFrame:
    """Row rules: implausible ratios become missing or are held to their floor; warnings say which."""
    pe_bad = known((F.col("pe_trailing") <= 1) | (F.col("pe_trailing") > 200))
    de, cr = F.col("debt_to_equity"), F.col("current_ratio")
    gross_bad = known(F.col("gross_margin") < 0) & ~is_financial()
    warnings = F.filter(
        F.array(
            F.when(pe_bad, "pe_out_of_range"),
            F.when(known(de < 0), "negative_debt_ratio"),
            F.when(known(de > 200), "extreme_debt_ratio"),
            F.when(known(cr > 20), "extreme_current_ratio"),
            F.when(gross_bad, "negative_gross_margin"),
        ),
        lambda x: x.isNotNull(),
    )
    return df.withColumns(
        {
            "data_warnings": F.array_join(warnings, ";"),
            "pe_trailing": F.when(~pe_bad, F.col("pe_trailing")),
            "debt_to_equity": F.when(de < 0, 0.0).when(~known(de > 200), de),
            "current_ratio": F.when(is_financial(), F.lit(None)).when(cr < 0, 0.0).when(~known(cr > 20), cr),
            "gross_margin": F.when(~is_financial() & ~gross_bad & (F.abs("gross_margin") <= 5), F.col("gross_margin")),
            "profit_margin": F.when(F.abs("profit_margin") <= 5, F.col("profit_margin")),
            "dividend_yield": F.when(F.col("dividend_yield") >= 0, F.when(F.col("dividend_yield") > 0.1, F.col("dividend_yield") / 100).otherwise(F.col("dividend_yield"))),
            "market_cap": F.col("market_cap") * lookup(USD, F.col("currency"), 1.0),
        }
    )


def anomalies() -> Column:
    """Flags, each closed by a semicolon; an unknown growth counts as extreme."""
    part = lambda cond, name: F.when(cond, f"{name};").otherwise("")
    return F.concat(
        part(~known(F.abs("revenue_growth") <= 500), "EXTREME_GROWTH"),
        part(~known(F.abs("earnings_growth") <= 500), "EXTREME_EARNINGS_GROWTH"),
        part(known(F.col("pe_forward") < 2), "SUSPICIOUS_FWD_PE"),
        part(F.col("pe_trailing").isNull() & F.col("roe").isNull() & F.col("return_12m").isNull(), "MISSING_CRITICAL"),
    )


def turnover_usd() -> Column:
    t = F.col("avg_volume") * F.col("current_price") * lookup(USD, F.col("currency"), 1.0)
    return F.when(t > 0, t)


def low_liquidity() -> Column:
    return F.coalesce(turnover_usd(), F.lit(0.0)) < MIN_TURNOVER


def quality_reasons() -> Column:
    """Why a row should go: an array, empty for clean rows."""
    return F.filter(
        F.array(
            F.when(~is_financial() & known(F.col("price_to_book") < 0), "negative equity"),
            F.when(known(F.col("debt_to_equity") > 400) & known(F.col("free_cash_flow") < 0), "debt and cash burn"),
            F.when(known(F.col("recommendation_mean") > 4.2), "strong sell"),
            F.when(~is_financial() & known(F.col("return_12m") < -0.55), "falling knife"),
        ),
        lambda x: x.isNotNull(),
    )


def quality_filter(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, eliminated rows with filter_reason)."""
    marked = df.withColumn("reasons", quality_reasons())
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0).withColumn("filter_reason", F.array_join("reasons", "; ")).drop("reasons")


def trend(df: DataFrame) -> DataFrame:
    long, short = F.coalesce("price_vs_ma200", F.lit(0.0)), F.coalesce("price_vs_ma50", F.lit(0.0))
    return df.withColumn("trend_signal", F.when(long < 0, "DOWN").when(short < 0, "WARN").otherwise("UP")).withColumn("trend_capped", long < 0)


CONFIDENCE_SCORES = ["score_value", "score_quality", "score_momentum", "score_growth", "score_risk", "score_sentiment", "score_dividend"]


def confidence(df: DataFrame) -> DataFrame:
    n = reduce(lambda a, b: a + b, [known(F.col(c) >= 60).cast("int") for c in CONFIDENCE_SCORES])
    share = n / F.lit(float(len(CONFIDENCE_SCORES)))
    return df.withColumn("factors_positive", n).withColumn("confidence_pct", share).withColumn("confidence_label", F.when(share >= 0.70, "HIGH").when(share >= 0.45, "MID").otherwise("LOW"))


def entry_signal(df: DataFrame) -> DataFrame:
    """One ordered decision list; a missing RSI waits."""
    score, rsi = F.coalesce("score_total", F.lit(0.0)), F.col("rsi_14")
    rsi_ok = known(rsi.between(35, 68))
    signal = (
        F.when((score < 0) | (score > 100), "NO_DATA")
        .when(F.col("trend_capped") | known(F.col("price_vs_ma200") < 0) | (score < 55), "NONE")
        .when(rsi.isNull() | (rsi > 75) | (rsi < 30), "WAIT")
        .when((score >= 72) & rsi_ok & known(F.col("pct_from_52w_high").between(-0.18, -0.05)), "STRONG")
        .when((score >= 65) & rsi_ok, "OK")
        .otherwise("WAIT")
    )
    return df.withColumn("entry_signal", signal)


def signals(df: DataFrame) -> DataFrame:
    """Quality filter, trend, confidence and entry signal, in this order."""
    return entry_signal(confidence(trend(quality_filter(df)[0])))


def hard_exclusion() -> Column:
    """First reason that rules a candidate out, or null."""
    return F.coalesce(
        F.when(F.col("current_price").isNull() | (F.col("current_price") <= 0), "no price"),
        F.when(F.col("market_cap").isNull(), "no market cap"),
        F.when(F.col("avg_volume").isNull() | (F.col("avg_volume") < 1000), "no volume"),
        F.when(F.col("price_to_book") < 0, "negative equity"),
        F.when(F.col("total_revenue") <= 0, "no revenue"),
        F.when(F.col("pe_trailing") > 500, "extreme P/E"),
        F.when(F.col("debt_to_equity") > 800, "extreme debt"),
    )


def screen(df: DataFrame, preset: dict[str, Sequence]) -> DataFrame:
    """Rows within closed ranges (None leaves a side open); one value means equality; columns that df lacks are passed by."""
    tests = []
    for name, bounds in preset.items():
        if name not in df.columns:
            continue
        if len(bounds) == 1:
            tests.append(F.col(name) == bounds[0])
            continue
        low, high = bounds
        tests.append(F.col(name).isNotNull())
        if low is not None:
            tests.append(F.col(name) >= low)
        if high is not None:
            tests.append(F.col(name) <= high)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


OPERATORS = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def rule_filter(df: DataFrame, rules: list[str]) -> DataFrame:
    """Rows that meet rules such as "roe >= 0.1"; a missing value fails, an unknown column is passed by."""
    for rule in rules:
        name, op, value = rule.split(None, 2)
        if op not in OPERATORS:
            raise ValueError(f"unknown comparison: {op}")
        if name in df.columns:
            df = df.where(known(getattr(F.col(name), OPERATORS[op])(F.lit(float(value)))))
    return df


def looks_like_ticker(c: str = "ticker") -> Column:
    return known(F.length(c).between(1, 12) & F.upper(c).rlike(r"^[A-Z0-9][A-Z0-9\-]*(\.[A-Z]{1,3})?$"))


def stars(score: Column) -> Column:
    return F.when(score >= 80, 5).when(score >= 65, 4).when(score >= 50, 3).when(score >= 35, 2).otherwise(1)
