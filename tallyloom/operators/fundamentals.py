"""Accounting scores and the small-company scorer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import clip, known, rank_metrics, ratio
from tallyloom.operators.cleaning import USD, lookup
from tallyloom.operators.factors import BY, KEYS, positive

# Thresholds and weights of the small-company scorer.
SMALL = {"turnover": 150_000.0, "cap_min": 20e6, "cap_max": 10e9, "debt": 300.0, "current": 0.5, "runway": 6.0, "piotroski": 2, "dilution": 0.20}
SMALL_WEIGHTS = {"insider": 0.18, "fcf": 0.16, "piotroski": 0.15, "growth": 0.13, "balance": 0.12, "value": 0.12, "momentum": 0.09, "liquidity": 0.05}
PIOTROSKI_POINTS = {0: 5.0, 1: 5.0, 2: 10.0, 3: 15.0, 4: 40.0, 5: 55.0, 6: 70.0, 7: 85.0, 8: 95.0, 9: 100.0}
# Published coefficients of the manipulation score.
BENEISH = {"dsri": 0.920, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}
BENEISH_BASE = -4.84
FINANCIALS = ["Financial Services", "Real Estate", "Insurance"]


def runway_months() -> Column:
    """Months of cash at the present burn; null if nothing is burnt or cash isn't known."""
    burn = F.when(F.col("operating_cashflow") < 0, -F.col("operating_cashflow") / 12)
    return ratio("total_cash", burn)


def small_cap_filter(df: DataFrame) -> DataFrame:
    """Rows that pass every hard filter; what isn't known passes, but for price and turnover."""
    passes = lambda c, cond: F.col(c).isNull() | cond
    cap_sek = F.col("market_cap") * lookup(USD, F.col("currency"), 1.0) / USD["SEK"]
    tests = [
        known(F.col("current_price") > 0),
        known(F.col("avg_volume") * F.col("current_price") >= SMALL["turnover"]),
        F.col("market_cap").isNull() | (F.col("market_cap") == 0) | cap_sek.between(SMALL["cap_min"], SMALL["cap_max"]),
        passes("book_value", F.col("book_value") >= 0),
        passes("debt_to_equity", F.col("debt_to_equity") <= SMALL["debt"]),
        passes("current_ratio", F.col("current_ratio") >= SMALL["current"]),
        F.coalesce(runway_months() >= SMALL["runway"], F.lit(True)),
        passes("piotroski_f", F.col("piotroski_f") > SMALL["piotroski"]),
        passes("shares_change_pct", F.col("shares_change_pct") <= SMALL["dilution"]),
    ]
    return df.where(reduce(lambda a, b: a & b, tests))


def or_default(c: str, value) -> Column:
    """Missing and zero both take the default."""
    return F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(value)).otherwise(F.col(c))


def red_flags() -> Column:
    ocf, cash = or_default("operating_cashflow", 1.0), F.coalesce("total_cash", F.lit(0.0))
    short = (ocf < 0) & (cash > 0) & known(ratio(cash, -ocf / 12) < 18)
    return F.filter(
        F.array(
            F.when(or_default("debt_to_equity", 0.0) > 150, "high debt"),
            F.when(or_default("current_ratio", 2.0) < 1.0, "low liquidity"),
            F.when(or_default("piotroski_f", 5) <= 3, "weak accounts"),
            F.when(or_default("gross_margin", 0.0) < 0.15, "low gross margin"),
            F.when(or_default("dividend_yield", 0.0) > 0.08, "suspect yield"),
            F.when(or_default("insider_pct", 0.0) < 0.03, "few insiders"),
            F.when(or_default("free_cash_flow", 1.0) < 0, "negative cash flow"),
            F.when(short, "short runway"),
        ),
        lambda x: x.isNotNull(),
    )


def small_cap_scores(df: DataFrame) -> DataFrame:
    """sc_* scores, sc_total (0 to 110), sc_rank: missing values take the median, bounds are 5 and 95 %."""
    bounds = (0.05, 0.95)
    w = Window.partitionBy(*BY)
    fill = lambda c: F.coalesce(c, F.median(c).over(w))
    net = F.coalesce("insider_net_buy_6m", F.lit(0.0))
    conviction = F.when((F.col("market_cap") > 0) & (net > 0), clip(net / F.col("market_cap"), 0.0, 0.10) * 1000).otherwise(0.0)
    base = df.withColumns(
        {
            "s_fcf_raw": clip(F.when(F.col("market_cap") > 0, ratio("free_cash_flow", "market_cap")), low=0.0),
            "s_value_raw": F.coalesce(positive("ev_to_ebitda"), positive("price_to_book")),
        }
    )
    base = base.withColumns({"s_fcf_fill": fill(F.col("s_fcf_raw")), "s_value_fill": fill(F.col("s_value_raw"))})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first = {
        "r_own": (zero("insider_pct"), True, bounds),
        "r_net": (F.signum(net) * F.log1p(F.abs(net)), True, bounds),
        "r_conviction": (conviction, True, bounds),
        "r_fcf": (F.col("s_fcf_fill"), True, bounds),
        "r_revenue": (zero("revenue_growth"), True, bounds),
        "r_earnings": (zero("earnings_growth"), True, bounds),
        "r_debt": (F.coalesce("debt_to_equity", F.lit(100.0)), False, bounds),
        "r_current": (F.coalesce("current_ratio", F.lit(1.0)), True, bounds),
        "r_value": (F.col("s_value_fill"), False, bounds),
        "r_momentum": (zero("return_12m") * 0.65 + zero("return_6m") * 0.35, True, bounds),
        "r_liquidity": (zero("avg_volume") * zero("current_price"), True, bounds),
    }
    out = base.join(rank_metrics(base, KEYS, BY, first), KEYS)
    own = F.col("r_own") * 0.7 + F.when(zero("insider_pct") > 0.20, 6.0).otherwise(0.0)
    out = out.withColumn("s_own", own)
    out = out.join(rank_metrics(out, KEYS, BY, {"r_own2": (F.col("s_own"), True, bounds)}), KEYS)
    cluster = F.when(F.col("insider_buy_count") >= 3, 20.0).when(F.col("insider_buy_count") >= 2, 5.0).otherwise(0.0)
    points = F.create_map(*[F.lit(x) for kv in PIOTROSKI_POINTS.items() for x in kv])
    out = out.withColumns(
        {
            "sc_insider": clip(F.col("r_own2") * 0.40 + F.col("r_net") * 0.35 + (F.col("r_conviction") * 0.6 + cluster * 0.4) * 0.25, 0.0, 100.0),
            "sc_fcf": F.col("r_fcf"),
            "sc_piotroski": F.coalesce(points[F.coalesce("piotroski_f", F.lit(4))], F.lit(40.0)),
            "sc_growth": F.col("r_revenue") * 0.6 + F.col("r_earnings") * 0.4,
            "sc_balance": F.col("r_debt") * 0.55 + F.col("r_current") * 0.45,
            "sc_value": F.col("r_value"),
            "sc_momentum": F.col("r_momentum"),
            "sc_liquidity": F.col("r_liquidity"),
        }
    )
    bonus = F.when(zero("total_cash") > zero("total_debt"), 5.0).otherwise(0.0) + F.when(zero("insider_pct") > 0.20, 3.0).otherwise(0.0) + F.when(zero("gross_margin") > 0.40, 3.0).otherwise(0.0)
    penalty = F.when(zero("shares_change_pct") > 0.10, 10.0).otherwise(0.0) + F.when(F.coalesce("piotroski_f", F.lit(5)) < 3, 5.0).otherwise(0.0) + F.when(zero("debt_to_equity") > 200, 3.0).otherwise(0.0)
    total = reduce(lambda a, b: a + b, [F.col(f"sc_{n}") * w for n, w in SMALL_WEIGHTS.items()])
    out = out.withColumn("sc_total", clip(total + bonus - penalty, 0.0, 110.0))
    return out.withColumn("sc_rank", F.rank().over(Window.partitionBy(*BY).orderBy(F.round("sc_total", 9).desc_nulls_last())))


def f_score(df: DataFrame, prior: DataFrame) -> DataFrame:
    """Nine accounting criteria against the newest earlier row 180 to 550 days old, else against fixed levels.

    prior: ticker, snapshot_date, roa, debt_to_equity, current_ratio, gross_margin, operating_margin.
    """
    fields = ["roa", "debt_to_equity", "current_ratio", "gross_margin", "operating_margin"]
    was = prior.select("ticker", "snapshot_date", *[F.col(c).alias(f"{c}_was") for c in fields])
    age = F.datediff("as_of", "snapshot_date")
    near = df.select("ticker", "as_of").join(was, "ticker").where(age.between(180, 550))
    newest = near.groupBy("ticker", "as_of").agg(F.max_by(F.struct(*[f"{c}_was" for c in fields]), "snapshot_date").alias("was"))
    x = df.join(newest, ["ticker", "as_of"], "left")
    c, old = F.col, lambda n: F.col("was")[f"{n}_was"]
    fin = known(c("sector").isin(*FINANCIALS))
    yes = lambda cond: known(cond).cast("int")
    ocf = or_default("operating_cashflow", None)
    ocf = F.coalesce(ocf, c("free_cash_flow"))
    assets = F.when(c("price_to_book") > 0, ratio("market_cap", "price_to_book"))
    compare = lambda n, better, level: F.when(old(n).isNotNull() & c(n).isNotNull(), yes(better)).otherwise(yes(level))
    growing = c("revenue_growth") > 0
    parts = {
        "f1": F.when(fin, yes(c("roe") > 0)).otherwise(yes(c("roa") > 0)),
        "f2": compare("roa", c("roa") > old("roa"), c("earnings_growth") > 0),
        "f3": yes(F.coalesce(ocf, c("free_cash_flow")) > 0),
        "f4": F.when(assets.isNotNull() & ocf.isNotNull() & c("roa").isNotNull(), yes(ratio(ocf, assets) > c("roa"))).otherwise(yes(ratio("free_cash_flow", positive("market_cap")) > c("roa"))),
        "f5": compare("debt_to_equity", c("debt_to_equity") < old("debt_to_equity"), c("debt_to_equity") < 100),
        "f6": F.when(fin, yes(c("profit_margin") > 0)).otherwise(compare("current_ratio", c("current_ratio") > old("current_ratio"), c("current_ratio") > 1.5)),
        "f7": F.when(c("insider_pct").isNotNull(), yes(c("insider_pct") > 0.03)).otherwise(1),
        "f8": F.when(fin, yes(c("roe") > 0.10)).otherwise(compare("gross_margin", c("gross_margin") > old("gross_margin"), (c("gross_margin") > 0.30) & (c("revenue_growth").isNull() | growing))),
        "f9": F.when(fin, yes(c("operating_margin") > 0.05)).otherwise(compare("operating_margin", c("operating_margin") > old("operating_margin"), F.when(c("revenue_growth").isNotNull(), (c("operating_margin") > 0.10) & growing).otherwise(c("operating_margin") > 0.15))),
    }
    total = reduce(lambda a, b: a + b, parts.values())
    out = x.withColumn("f_score", total)
    return out.withColumn("f_label", F.when(F.col("f_score") >= 7, "STRONG").when(F.col("f_score") >= 4, "NEUTRAL").otherwise("WEAK")).drop("was")


def m_score(df: DataFrame, least: int = 3) -> DataFrame:
    """Manipulation score from eight year-on-year indices; null with under least of them."""
    c = F.col
    idx = {
        "dsri": ratio(ratio("receivables", "total_revenue"), ratio("receivables_prev", "revenue_prev")),
        "gmi": ratio(1 - ratio("cogs_prev", "revenue_prev"), 1 - ratio("cogs", "total_revenue")),
        "aqi": ratio(1 - ratio(c("receivables") + c("ppe"), "assets"), 1 - ratio(c("receivables_prev") + c("ppe_prev"), "assets_prev")),
        "sgi": ratio("total_revenue", "revenue_prev"),
        "depi": ratio(ratio("depreciation_prev", c("depreciation_prev") + c("ppe_prev")), ratio("depreciation", c("depreciation") + c("ppe"))),
        "sgai": ratio(ratio("sga", "total_revenue"), ratio("sga_prev", "revenue_prev")),
        "tata": ratio(c("net_income") - c("operating_cashflow"), "assets"),
        "lvgi": ratio(ratio(c("debt_now") + c("liabilities"), "assets"), ratio(c("debt_prev") + c("liabilities_prev"), "assets_prev")),
    }
    out = df.withColumns({f"i_{n}": e for n, e in idx.items()})
    n = reduce(lambda a, b: a + b, [c(f"i_{k}").isNotNull().cast("int") for k in idx])
    total = reduce(lambda a, b: a + b, [F.coalesce(c(f"i_{k}") * w, F.lit(0.0)) for k, w in BENEISH.items()])
    out = out.withColumn("m_score", F.when(n >= least, total + BENEISH_BASE))
    return out.withColumn("m_band", F.when(c("m_score") > -1.78, "HIGH").when(c("m_score") > -2.22, "GREY").when(c("m_score").isNotNull(), "LOW").otherwise("UNKNOWN"))


# Weights of the early-warning score and its gates.
EARLY_WEIGHTS = {"fcf": 0.25, "size": 0.15, "ps": 0.15, "leverage": 0.20, "accel": 0.15, "accruals": 0.10}
EARLY_FLAG, EARLY_CANDIDATE, EARLY_MIN_CAP = 70.0, 59.5, 10_000_000.0


def early_warning(df: DataFrame) -> DataFrame:
    """Six sub-scores (missing values take the median), their weighted total, coverage, flag and candidate.

    df: as_of, pk, market_cap, free_cash_flow, price_to_sales, revenue_ttm, revenue_prev, revenue_2y, op_ttm, op_prev, net_income,
    operating_cashflow, assets, assets_prev, sector, piotroski_f, roa.
    """
    c, w, bounds = F.col, Window.partitionBy(*BY), (0.05, 0.95)
    cap = F.when(c("market_cap") != 0, c("market_cap"))
    growth = ratio("revenue_ttm", "revenue_prev") - 1
    op_growth = ratio("op_ttm", "op_prev") - 1
    levered = (growth > 0) & (c("revenue_prev") > 0) & (c("op_prev") > 0) & (c("op_ttm") > 0)
    insurer = known(c("sector").isin("Financial Services", "Insurance"))
    twice = (c("revenue_prev") > 0) & (c("revenue_2y") > 0)
    mean_assets = (c("assets") + c("assets_prev")) / 2
    raw = {
        "e_fcf": (ratio(F.when(c("free_cash_flow") < 0, 0.0).otherwise(c("free_cash_flow")), cap), True),
        "e_size": (cap, False),
        "e_ps": (F.when(~insurer, positive("price_to_sales")), False),
        "e_leverage": (F.when(levered, clip(ratio(op_growth, growth), 0.0, 10.0)), True),
        "e_accel": (F.when(twice, growth - (F.sqrt(ratio("revenue_ttm", "revenue_2y")) - 1)), True),
        "e_accruals": (F.when(mean_assets > 0, ratio(c("net_income") - c("operating_cashflow"), mean_assets)), False),
    }
    base = df.withColumns({f"{n}_raw": e for n, (e, _) in raw.items()})
    base = base.withColumns({f"{n}_raw": F.coalesce(f"{n}_raw", F.median(f"{n}_raw").over(w)) for n in raw})
    out = base.join(rank_metrics(base, KEYS, BY, {n: (c(f"{n}_raw"), up, bounds) for n, (_, up) in raw.items()}), KEYS)
    out = out.withColumn("e_size", F.when(known(cap >= EARLY_MIN_CAP), c("e_size")).otherwise(50.0))
    total = reduce(lambda a, b: a + b, [c(f"e_{n}") * x for n, x in EARLY_WEIGHTS.items()])
    there = [
        c("free_cash_flow").isNotNull() & c("market_cap").isNotNull(),
        c("market_cap") > EARLY_MIN_CAP,
        positive("price_to_sales").isNotNull() & ~insurer,
        (c("revenue_prev") > 0) & (c("op_prev") > 0) & (c("op_ttm") > 0),
        twice,
        c("net_income").isNotNull() & c("operating_cashflow").isNotNull() & (mean_assets > 0),
    ]
    coverage = reduce(lambda a, b: a + b, [known(t).cast("int") for t in there])
    out = out.withColumn("early_score", clip(total, 0.0, 100.0)).withColumn("early_coverage", coverage)
    gate = known((c("piotroski_f") >= 5) & (c("roa") > 0)) & (c("early_coverage") >= 3) & c("free_cash_flow").isNotNull() & c("market_cap").isNotNull()
    return out.withColumn("early_flag", known(c("early_score") >= EARLY_FLAG) & gate).withColumn("early_candidate", known(c("early_score") >= EARLY_CANDIDATE) & gate)
