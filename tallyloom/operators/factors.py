"""Cross-sectional factor scores, composite, ranks and sector views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import MIN_VALID, clip, demean_by_median, known, rank_metrics, ratio, row_mean
from tallyloom.sources.shared import written

# a row is known by its pk: beyond 999,999 tickers repeat
KEYS, BY = ["as_of", "pk"], ["as_of"]
NEUTRAL = 50.0
MAX_SCALE = 1.5
WINSOR = (0.02, 0.98)

# Factor weights and their changes by market regime and by sector.
FACTOR_WEIGHTS = {
    "value": 0.2134,
    "quality": 0.1746,
    "momentum": 0.1746,
    "growth": 0.1261,
    "risk": 0.0873,
    "size": 0.0485,
    "dividend": 0.0485,
    "sentiment": 0.0770,
    "short_interest": 0.0300,
    "options_flow": 0.0200,
}
REGIME_DELTAS = {
    "BULL": {"momentum": 0.05, "growth": 0.05, "risk": -0.05, "value": -0.05},
    "BEAR": {"quality": 0.15, "risk": 0.10, "value": 0.10, "momentum": -0.20, "growth": -0.15},
    "NEUTRAL": {},
}
SECTOR_DELTAS = {
    "Financial Services": {"quality": 0.05, "value": 0.03, "growth": -0.05, "momentum": -0.03},
    "Technology": {"growth": 0.06, "momentum": 0.05, "value": -0.06, "dividend": -0.04},
    "Communication Services": {"growth": 0.04, "momentum": 0.03, "dividend": -0.04},
    "Utilities": {"dividend": 0.06, "quality": 0.03, "momentum": -0.05, "growth": -0.04},
    "Real Estate": {"dividend": 0.06, "value": 0.02, "growth": -0.04, "momentum": -0.02},
    "Energy": {"value": 0.04, "momentum": -0.04, "growth": -0.02},
    "Basic Materials": {"value": 0.04, "momentum": -0.03, "growth": -0.02},
    "Consumer Defensive": {"quality": 0.04, "dividend": 0.04, "momentum": -0.04},
    "Consumer Cyclical": {"momentum": 0.04, "growth": 0.04, "value": -0.03},
    "Healthcare": {"growth": 0.04, "quality": 0.03, "value": -0.04},
    "Industrials": {"momentum": 0.03, "quality": 0.03, "value": -0.03},
}
# Columns neutralised by venue group, then by sector.
REGION_COLUMNS = ["pe_trailing", "pe_forward", "price_to_book", "ev_to_ebitda", "roe", "roa", "profit_margin", "operating_margin", "gross_margin", "debt_to_equity", "current_ratio", "free_cash_flow"]
SECTOR_COLUMNS = ["pe_forward", "pe_trailing", "price_to_book", "ev_to_ebitda", "roe", "roa", "profit_margin", "operating_margin", "revenue_growth", "earnings_growth", "debt_to_equity", "current_ratio"]
# Industries whose composite is discounted.
HOLDING_INDUSTRIES = ["asset management", "diversified investments", "investment trusts", "closed-end fund", "exchange traded fund", "capital markets"]
COMMODITY_INDUSTRIES = ["gold", "silver", "copper", "other precious metals & mining", "steel", "aluminum", "uranium", "oil & gas e&p"]
HOLDING_DISCOUNT, COMMODITY_DISCOUNT = 0.85, 0.90


def regime_weights(regime: str = "NEUTRAL") -> dict[str, float]:
    """Factor weights under a market regime; they sum to one."""
    w = {k: v + REGIME_DELTAS[regime].get(k, 0.0) for k, v in FACTOR_WEIGHTS.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def sector_weights(sector: str, base: dict[str, float]) -> dict[str, float]:
    """Weights of a sector: base plus its changes, not below zero, summing to one."""
    deltas = SECTOR_DELTAS.get(sector)
    if not deltas:
        return base
    w = {k: max(0.0, v + deltas.get(k, 0.0)) for k, v in base.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total else base


def neutralise_regions(df: DataFrame) -> DataFrame:
    """Fundamentals less the median of their venue group."""
    return demean_by_median(df, REGION_COLUMNS, [*BY, "exchange_group"])


def neutralise_sectors(df: DataFrame) -> DataFrame:
    """Fundamentals less the median of their sector (nulls form a sector of their own)."""
    return demean_by_median(df, SECTOR_COLUMNS, [*BY, F.coalesce("sector", F.lit("Unknown"))])


def positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def fcf_yield() -> Column:
    y = ratio("free_cash_flow", positive("enterprise_value"))
    return F.when(y > -0.5, y)


def metrics() -> dict[str, tuple]:
    """Ranked metrics: expression, whether more is better, winsor bounds."""
    margin = ratio("free_cash_flow", positive("total_revenue"))
    capped = F.least(F.coalesce("dividend_yield", F.lit(0.0)), F.lit(0.15))
    return {
        "m_fcf_yield": (fcf_yield(), True, WINSOR),
        "m_ev": (positive("ev_to_ebitda"), False, WINSOR),
        "m_pe": (F.when(F.coalesce("pe_forward", "pe_trailing") > 0, F.coalesce("pe_forward", "pe_trailing")), False, WINSOR),
        "m_pb": (positive("price_to_book"), False, WINSOR),
        "m_ps": (positive("price_to_sales"), False, WINSOR),
        **{f"m_{c}": (F.col(c), True, WINSOR) for c in ("roe", "roa", "profit_margin", "operating_margin", "gross_margin")},
        "m_fcf_margin": (F.when(F.abs(margin) < 5, margin), True, WINSOR),
        **{f"m_{c}": (F.col(c), True, WINSOR) for c in ("return_12m", "return_6m", "return_3m", "pct_from_52w_high", "earnings_revision_rate", "earnings_surprise")},
        **{f"m_{c}": (F.col(c), True, WINSOR) for c in ("revenue_growth", "earnings_growth", "earnings_quarterly_growth")},
        "m_debt": (F.when(F.col("debt_to_equity") >= 0, F.col("debt_to_equity")), False, WINSOR),
        "m_current": (clip("current_ratio", high=5.0), True, WINSOR),
        "m_volatility": (F.col("volatility"), False, WINSOR),
        "m_beta": (F.col("beta"), False, WINSOR),
        "m_size": (F.ln(positive("market_cap")), False, None),
        "m_dividend": (F.when(known(F.col("payout_ratio") > 1), capped * 0.5).otherwise(capped), True, None),
        "m_short": (F.col("short_pct_float"), False, (0.0, 0.98)),
        "m_sentiment": (F.coalesce("sentiment_raw", F.lit(0.0)), True, None),
    }


def insider_decay(days: str = "insider_days") -> Column:
    """1 on the day, falling to 0 after 180 days; 1 if the day isn't known."""
    return F.coalesce(clip(1.0 - clip(days, low=0) / 180.0, 0.0, 1.0), F.lit(1.0))


def weighted(parts: list[tuple[float, Column]], seen: list[Column]) -> Column:
    """Weighted mean over the parts whose flag is set for the whole cross-section; null if a part is null."""
    used = reduce(lambda a, b: a + b, [F.when(s, F.lit(w)).otherwise(0.0) for (w, _), s in zip(parts, seen, strict=True)])
    total = reduce(lambda a, b: a + b, [F.when(s, c * w).otherwise(0.0) for (w, c), s in zip(parts, seen, strict=True)])
    return F.try_divide(total, F.nullif(used, F.lit(0.0)))


def factor_scores(df: DataFrame) -> DataFrame:
    """df plus score_* columns from 0 to 100.  df is read for values, quantiles and scores: write it before if it is dear to work out."""
    all_metrics = metrics()
    ranked = rank_metrics(df, KEYS, BY, all_metrics)
    has = ("m_fcf_yield", "m_ev", "m_pe", "m_pb", "m_ps")
    # a metric is ranked if there are enough values of it in the cross-section; a row a date
    flags = df.groupBy(*BY).agg(*[(F.count(all_metrics[m][0]) >= MIN_VALID).alias(f"has_{m}") for m in has])
    out = df.join(ranked, KEYS).join(flags, BY)
    seen = lambda *ms: [F.col(f"has_{m}") for m in ms]
    primary = weighted([(0.70, F.col("m_fcf_yield")), (0.30, F.col("m_ev"))], seen("m_fcf_yield", "m_ev"))
    fallback = weighted([(0.40, F.col("m_pe")), (0.35, F.col("m_pb")), (0.25, F.col("m_ps"))], seen("m_pe", "m_pb", "m_ps"))
    value = F.when(F.col("has_m_fcf_yield") | F.col("has_m_ev"), primary).when(F.col("has_m_pe") | F.col("has_m_pb") | F.col("has_m_ps"), fallback).otherwise(NEUTRAL)
    raw = F.coalesce("sentiment_raw", F.lit(0.0))
    mood = (raw + 1) * 25 + F.col("m_sentiment") * 0.5
    after_exec = F.when(known(F.col("insider_executive_buy")), F.least(mood + 20 * insider_decay(), F.lit(95.0))).otherwise(mood)
    sentiment = F.when(known(F.col("insider_cluster")), F.least(after_exec + 30 * insider_decay(), F.lit(98.0))).otherwise(after_exec)
    flow = F.coalesce(F.col("options_flow_signal") * 100, F.lit(NEUTRAL))
    boost = F.when(F.coalesce("short_pct_float", F.lit(0.0)) > 0.20, 10.0).otherwise(0.0)
    return out.withColumns(
        {
            "score_value": value,
            "score_quality": row_mean("m_roe", "m_roa", "m_profit_margin", "m_operating_margin", "m_gross_margin", "m_fcf_margin"),
            "score_momentum": row_mean("m_return_12m", "m_return_6m", "m_return_3m", "m_pct_from_52w_high", "m_earnings_revision_rate", "m_earnings_surprise"),
            "score_growth": row_mean("m_revenue_growth", "m_earnings_growth", "m_earnings_quarterly_growth", "m_earnings_revision_rate", "m_earnings_surprise"),
            "score_risk": row_mean("m_debt", "m_current", "m_volatility", "m_beta"),
            "score_size": F.col("m_size"),
            "score_dividend": F.col("m_dividend"),
            "score_fcf_yield": F.col("m_fcf_yield"),
            "score_sentiment": sentiment,
            "score_short_interest": F.when(F.col("m_short").isNotNull(), F.least(F.col("m_short") + boost, F.lit(99.0))),
            "score_options_flow": F.when(known(F.col("options_flow_signal") > 0.8), F.least(flow + 10, F.lit(100.0))).otherwise(flow),
        }
    ).drop(*[f"has_{m}" for m in has], *metrics())


def company_kind() -> Column:
    low = F.lower(F.coalesce("industry", F.lit("")))
    contains = lambda names: reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in names])
    return F.when(contains(HOLDING_INDUSTRIES), "holding").when(contains(COMMODITY_INDUSTRIES), "commodity").otherwise("standard")


def composite(df: DataFrame, regime: str = "NEUTRAL") -> DataFrame:
    """df plus score_total, company_type and rank.

    Missing scores are left out and the rest scaled up, at most by MAX_SCALE; weights depend on the sector.
    """
    base = regime_weights(regime)
    names = list(FACTOR_WEIGHTS)
    per_sector = {s: sector_weights(s, base) for s in SECTOR_DELTAS}

    def weight(name: str) -> Column:
        table = F.create_map(*[F.lit(x) for s, w in per_sector.items() for x in (s, w[name])])
        return F.coalesce(table[F.col("sector")], F.lit(base[name]))

    score = {n: F.col(f"score_{n}") for n in names}
    total = reduce(lambda a, b: a + b, [weight(n) * F.coalesce(score[n], F.lit(0.0)) for n in names])
    used = reduce(lambda a, b: a + b, [F.when(score[n].isNotNull(), weight(n)).otherwise(0.0) for n in names])
    whole = reduce(lambda a, b: a + b, [weight(n) for n in names])
    scale = F.least(whole / F.greatest(used, F.lit(1e-6)), F.lit(MAX_SCALE))
    out = df.withColumn("raw_total", clip(total * scale, 0.0, 100.0)).withColumn("company_type", company_kind())
    discount = F.when(F.col("company_type") == "holding", HOLDING_DISCOUNT).when(F.col("company_type") == "commodity", COMMODITY_DISCOUNT).otherwise(1.0)
    out = out.withColumn("score_total", F.col("raw_total") * discount).drop("raw_total")
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*BY).orderBy(F.round("score_total", 9).desc_nulls_last())))


def scored(df: DataFrame, regime: str = "NEUTRAL", sector_neutral: bool = True) -> DataFrame:
    """The whole scorer: neutralise, score the factors, combine.

    The cross-section is worked out once and written, as it is once more when it is neutral: all else reads those.
    """
    out = neutralise_regions(written(df, "cross-section"))
    if sector_neutral:
        out = neutralise_sectors(out)
    return composite(factor_scores(written(out, "neutral")), regime)


def data_quality() -> Column:
    fields = ["pe_trailing", "price_to_book", "roe", "profit_margin", "revenue_growth", "debt_to_equity", "return_12m", "beta"]
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in fields]) / F.lit(float(len(fields)))


def sector_relative(df: DataFrame, score: str = "score_total", least: int = 4) -> DataFrame:
    """Half the score, half the share of sector peers strictly below it; small or unknown sectors keep the score."""
    by = Window.partitionBy(*BY, "sector")
    below = (F.rank().over(by.orderBy(F.round(score, 9))) - 1) / F.count("*").over(by) * 100
    fits = F.col("sector").isNotNull() & (F.count("*").over(by) >= least)
    out = df.withColumn("score_sector", F.when(fits, below)).withColumn("score_blend", F.when(F.col("score_sector").isNotNull(), (F.col(score) + F.col("score_sector")) / 2).otherwise(F.col(score)))
    return out.withColumn("rank_blend", F.rank().over(Window.partitionBy(*BY).orderBy(F.round("score_blend", 9).desc_nulls_last())))


def sector_summary(df: DataFrame, score: str = "score_total") -> DataFrame:
    """Count, mean, best ticker and best score by sector."""
    best = F.struct(F.round(score, 9).alias("s"), (-F.col("pk")).alias("k"))
    return df.where("sector is not null").groupBy("sector").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.max_by("ticker", best).alias("best_ticker"), F.max(score).alias("best_score"))


