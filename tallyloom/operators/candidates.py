"""Candidate quality: additive rules, dilution, the combined verdict; rate sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import clip, known

# Sectors that the rules treat apart.
TECH = ["Technology", "Information Technology", "Software", "Semiconductors", "Communication Services", "Internet Content & Information"]
FINANCIAL = ["Financial Services", "Banks", "Insurance", "Capital Markets", "Asset Management", "Consumer Finance", "Mortgage Finance", "Financial", "Diversified Financials"]
PAYERS = ["Utilities", "Real Estate", "REITs", "Diversified REITs", "Specialty REITs"]
# Rate sensitivity from 1 to 10 and duration in years, by sector.
RATES = {
    "Real Estate": (9, 8.0),
    "Utilities": (8, 7.0),
    "Financial Services": (7, 5.0),
    "Banks": (7, 4.5),
    "Insurance": (6, 5.0),
    "Consumer Cyclical": (6, 3.0),
    "Homebuilding": (8, 6.0),
    "REITs": (9, 8.5),
    "Energy": (5, 3.5),
    "Basic Materials": (5, 3.0),
    "Industrials": (4, 3.5),
    "Technology": (3, 2.0),
    "Healthcare": (3, 2.5),
    "Consumer Defensive": (2, 2.5),
    "Communication": (3, 3.0),
    "Unknown": (5, 4.0),
}


def percent(c: str) -> Column:
    """A share as a percentage; values from 2 on are percentages already."""
    return F.when(F.abs(c) < 2, F.col(c) * 100).otherwise(F.col(c))


def steps(*rules: tuple[Column, float]) -> Column:
    """Points of the first rule that is known to hold, else 0."""
    out = F.lit(0.0)
    for cond, points in reversed(rules):
        out = F.when(known(cond), F.lit(float(points))).otherwise(out)
    return out


def quality_score() -> Column:
    """From 50, points for profit, growth, debt, cash, analysts, price and owners, held between 0 and 100."""
    tech, financial, payer = (known(F.col("sector").isin(s)) for s in (TECH, FINANCIAL, PAYERS))
    roe, margin, gross, growth, eps, owners = (percent(c) for c in ("roe", "profit_margin", "gross_margin", "revenue_growth", "earnings_growth", "insider_pct"))
    debt, pe = F.col("debt_to_equity") / 100, F.coalesce("pe_forward", "pe_trailing")
    parts = [
        steps((roe > 15, 8), (roe > 8, 4), (roe < 0, -10)),
        steps((margin > 15, 6), (margin > 5, 3), (margin < 0, -8)),
        steps((gross > 40, 5), (gross > 20, 2), ((gross < 10) & tech, -6)),
        steps((growth > 20, 8), (growth > 5, 4), (growth < -10, -8), (growth < 0, -4)),
        steps((eps > 20, 5), (eps < -20, -5)),
        steps((financial | (debt < 0), 0), (debt < 0.3, 5), (debt < 0.8, 2), (debt > 2.0, -8)),
        steps((F.col("free_cash_flow") > 0, 7), (F.col("free_cash_flow") < 0, -6)),
        steps((F.col("recommendation_mean") <= 2.0, 6), (F.col("recommendation_mean") <= 2.5, 3), (F.col("recommendation_mean") >= 4.0, -8)),
        steps(((pe > 60) & tech & (F.coalesce(growth, F.lit(0.0)) < 15), -5), (tech | (pe <= 0), 0), (pe > 30, -3), (pe < 12, 4)),
        steps((F.col("price_to_book") < 0, -10), ((F.col("price_to_book") > 8) & ~tech, -3)),
        steps((owners > 20, 4), (owners > 5, 2)),
        steps((tech & (gross > 60), 5), (payer & (F.col("dividend_yield") > 0), 4)),
    ]
    return F.round(clip(sum(parts, F.lit(50.0)), 0.0, 100.0), 1)


def verdicts(df: DataFrame) -> DataFrame:
    """df plus quality_score after deductions, dilution_pct, excluded, tier and confidence_delta; needs m_score and its inputs."""
    c = F.col
    growth = F.abs("shares_change_pct")
    out = df.withColumn("dilution_pct", F.coalesce(F.when(growth < 2, growth * 100).otherwise(growth), F.lit(0.0)))
    likely, possible = known(c("m_score") > -1.00), known(c("m_score") > -1.78)
    heavy, much = c("dilution_pct") > 30, c("dilution_pct") > 15
    score = F.greatest(F.lit(0.0), quality_score() - F.when(likely, 30).when(possible, 15).otherwise(0))
    score = F.greatest(F.lit(0.0), score - F.when(heavy, 25).when(much, 12).otherwise(0))
    out = out.withColumn("quality_score", F.round(score, 1)).withColumn("excluded", likely | heavy)
    flagged = possible | much
    delta = F.when(likely, -0.35).when(possible, -0.20).otherwise(0.0) + F.when(heavy, -0.20).when(much, -0.10).otherwise(0.0)
    out = out.withColumn("tier", F.when((c("quality_score") >= 65) & ~flagged, "HIGH").when(c("quality_score") >= 40, "MEDIUM").otherwise("SPECULATIVE"))
    return out.withColumn("confidence_delta", F.round(delta + F.when(c("tier") == "HIGH", 0.15).when(c("tier") == "SPECULATIVE", -0.20).otherwise(0.0), 3))
