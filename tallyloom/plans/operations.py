"""Queries of running the thing: models, folds, alerts, lookups, audits."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import average_rank, known, normal_cdf, pct_rank, quantile_bucket, ratio
from tallyloom.operators import candidates as K
from tallyloom.operators import cleaning as C
from tallyloom.operators import factors as X
from tallyloom.operators import regime as R
from tallyloom.plans.cross_section import case_map, r6
from tallyloom.plans.registry import query
from tallyloom.plans.series import CH, W, roll
from tallyloom.sources.catalog import Tables

REGIME = f"""WITH {CH}, x AS (SELECT ticker, ts, close / nullif({roll('avg', 'close', 200)}, 0) - 1 AS m, {roll('stddev_samp', 'r', 20)} * 20 AS f, close / lag(close, 62) OVER ({W}) - 1 AS mo, volume / nullif({roll('avg', 'volume', 60)}, 0) - 1 AS b FROM ch),
c AS (SELECT ticker, ts, greatest(0.0, least(1.0, 0.5 + m * 5)) * 0.30 + greatest(0.0, least(1.0, 1 - (f - 15) / 15)) * 0.20 + greatest(0.0, least(1.0, 0.5 + mo * 6.25)) * 0.15 + coalesce(greatest(0.0, least(1.0, 0.5 + b * 5)), 0.5) * 0.10 + 0.05 + 0.075 AS c FROM x WHERE m IS NOT NULL AND f IS NOT NULL AND mo IS NOT NULL)
SELECT ticker, ts, round(c, 6) AS composite, CASE WHEN c >= 0.62 THEN 'BULL' WHEN c <= 0.38 THEN 'BEAR' ELSE 'NEUTRAL' END AS regime FROM c"""


@query(REGIME, "bars")
def scr_39_market_regime(t: Tables):
    return R.regimes(t.bars).where("composite is not null").select("ticker", "ts", r6("composite"), "regime")


SENSITIVITY, DURATION = ({s: v[k] for s, v in K.RATES.items()} for k in (0, 1))
SENS, DUR = (f"CASE sector {' '.join(f"WHEN '{s}' THEN {x}" for s, x in table.items())} ELSE {table['Unknown']} END" for table in (SENSITIVITY, DURATION))


@query(f"WITH w AS (SELECT coalesce(currency, '') AS currency, round(sum(market_cap * {SENS}) / sum(market_cap), 1) AS sensitivity, round(sum(market_cap * {DUR}) / sum(market_cap), 1) AS duration FROM xsection WHERE market_cap IS NOT NULL GROUP BY 1) SELECT *, round(-duration, 1) AS impact_of_one_point, CASE WHEN sensitivity >= 7 THEN 'high' WHEN sensitivity >= 5 THEN 'medium' ELSE 'low' END AS level FROM w", "xsection")
def scr_41_rate_sensitivity(t: Tables):
    """Value-weighted sensitivity and duration of the holdings in each currency."""
    x = t.xsection.where("market_cap is not null").withColumn("currency", F.coalesce("currency", F.lit("")))
    weighted = lambda table, name: F.round(ratio(F.sum(F.col("market_cap") * C.lookup(table, F.col("sector"), table["Unknown"])), F.sum("market_cap")), 1).alias(name)
    w = x.groupBy("currency").agg(weighted(SENSITIVITY, "sensitivity"), weighted(DURATION, "duration"))
    level = F.when(F.col("sensitivity") >= 7, "high").when(F.col("sensitivity") >= 5, "medium").otherwise("low")
    return w.select("*", F.round(-F.col("duration"), 1).alias("impact_of_one_point"), level.alias("level"))


@query("SELECT month, ticker, greatest(0, CAST(ceil((k - 1) * 5 / nullif(n - 1, 0)) AS BIGINT) - 1) AS label FROM (SELECT month, ticker, row_number() OVER (PARTITION BY month ORDER BY actual, ticker) AS k, count(*) OVER (PARTITION BY month) AS n FROM panel) WHERE n >= 5", "panel")
def lbl_04_quintiles(t: Tables):
    m = Window.partitionBy("month")
    x = t.panel.withColumn("k", F.row_number().over(m.orderBy("actual", "ticker"))).withColumn("n", F.count("*").over(m)).where("n >= 5")
    return x.select("month", "ticker", quantile_bucket(F.col("k"), F.col("n"), 5).cast("long").alias("label"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY sector_id ORDER BY month, ticker) - 1 AS k, count(*) OVER (PARTITION BY sector_id) AS n FROM panel), f AS (SELECT *, least(5, k // greatest(1, n // 6)) AS fold FROM n) SELECT sector_id::BIGINT AS sector_id, fold::BIGINT AS fold, count(*) AS rows, min(month) AS first_month, max(month) AS last_month FROM f GROUP BY 1, 2", "panel")
def ml_07_combinatorial_folds(t: Tables):
    """Six blocks in order of time in each sector, from row numbers."""
    w = Window.partitionBy("sector_id")
    x = t.panel.withColumn("k", F.row_number().over(w.orderBy("month", "ticker")) - 1).withColumn("n", F.count("*").over(w))
    fold = F.least(F.lit(5), F.floor(F.col("k") / F.greatest(F.lit(1), F.floor(F.col("n") / 6))))
    return x.withColumn("fold", fold.cast("long")).groupBy(F.col("sector_id").cast("long").alias("sector_id"), "fold").agg(F.count("*").alias("rows"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


EULER = 0.5772156649
# Acklam's rational approximation of the inverse normal: relative error under 1.2e-9.
MIDDLE = ([-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00], [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0])
TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00], [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0])


def normal_quantile(p):
    """Value under which a standard normal number is with probability p, 0 < p < 1."""

    def over(coefficients, x):
        up, down = (functools.reduce(lambda value, c: value * x + c, rest, F.lit(first)) for first, *rest in coefficients)
        return up / down

    q = p - 0.5
    low = over(TAIL, F.sqrt(-2 * F.ln(p)))
    high = -over(TAIL, F.sqrt(-2 * F.ln(1 - p)))
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(q * over(MIDDLE, q * q))


@query(None)
def ml_08_deflated_sharpe(t: Tables):
    """Probability that a Sharpe ratio beats the best of all sectors' by chance, by sector.

    Each sector is a trial.  probability expects the largest by the mixture of two quantiles and simple by one quantile
    in standard errors.
    """
    s = t.panel.groupBy("sector_id").agg(ratio(F.avg("actual"), F.stddev_samp("actual")).alias("sharpe"), F.count("*").alias("n"), F.skewness("actual").alias("skew"), (F.kurtosis("actual") + 3).alias("kurt"))
    trials = F.greatest(F.lit(2.0), F.col("trials"))
    expected = (1 - EULER) * normal_quantile(1 - 1 / trials) + EULER * normal_quantile(1 - 1 / (trials * math.e))
    most = s.agg(F.count("*").cast("double").alias("trials")).select("trials", expected.alias("expected"), normal_quantile(1 - 0.5 / F.col("trials")).alias("quantile"))
    s = s.crossJoin(F.broadcast(most))
    sr, skew, kurt = F.col("sharpe"), F.col("skew"), F.col("kurt")
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr**2
    z = (sr * F.sqrt(F.col("n") - 1.0) - F.col("expected")) / F.sqrt(F.when(spread > 0, spread).otherwise(1e-8))
    variance = (1 + sr**2 / 2 - skew * sr + (kurt - 3) / 4 * sr**2) / (F.col("n") - 1.0)
    error = F.greatest(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(1e-8))
    simple = normal_cdf(sr / error - F.col("quantile"))
    few = F.col("n") < 2
    return s.select("sector_id", "sharpe", F.when(few | (sr <= 0), 0.0).otherwise(normal_cdf(z)).alias("probability"), F.when(few, 0.0).otherwise(simple).alias("simple"), F.col("trials").cast("long").alias("trials"))


@query("SELECT month, ticker, round(coalesce((rank() OVER (PARTITION BY month ORDER BY p NULLS LAST) + (count(p) OVER (PARTITION BY month, p) - 1) / 2.0) / nullif(count(p) OVER (PARTITION BY month), 0) * 100 * CASE WHEN p IS NULL THEN NULL ELSE 1 END, 0), 6) AS ml_rank FROM (SELECT month, ticker, CASE WHEN ticker % 9 = 0 THEN NULL ELSE pred END AS p FROM panel)", "panel")
def ml_11_masked_rank(t: Tables):
    """Rows without features are masked before the rank and get 0."""
    x = t.panel.withColumn("p", F.when(F.col("ticker") % 9 != 0, F.col("pred")))
    return x.select("month", "ticker", r6(F.coalesce(pct_rank("p", ["month"]), F.lit(0.0)), "ml_rank"))


ENSEMBLE = """WITH r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY pred) + (count(*) OVER (PARTITION BY month, pred) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY month ORDER BY actual) + (count(*) OVER (PARTITION BY month, actual) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY month ORDER BY ticker % 97) + (count(*) OVER (PARTITION BY month, ticker % 97) - 1) / 2.0 AS rq FROM panel), i AS (SELECT greatest(corr(rp, ra), 0) AS a, greatest(corr(rq, ra), 0) AS b FROM r)
SELECT month, ticker, round((pred / 500000 * (a + 0.01) + (ticker % 97) / 97.0 * (b + 0.01)) / (a + b + 0.02), 6) AS blended FROM panel, i"""


@query(ENSEMBLE, "panel")
def ml_12_weighted_ensemble(t: Tables):
    """Members weighted by their rank correlation with the outcome, floored and normalised."""
    x = t.panel.withColumn("other", (F.col("ticker") % 97).cast("double"))
    r = x.withColumns({"rp": average_rank("pred", ["month"]), "ra": average_rank("actual", ["month"]), "rq": average_rank("other", ["month"])})
    i = r.agg(F.greatest(F.corr("rp", "ra"), F.lit(0.0)).alias("a"), F.greatest(F.corr("rq", "ra"), F.lit(0.0)).alias("b"))
    both = x.crossJoin(F.broadcast(i))
    value = (F.col("pred") / 500000 * (F.col("a") + 0.01) + F.col("other") / 97 * (F.col("b") + 0.01)) / (F.col("a") + F.col("b") + 0.02)
    return both.select("month", "ticker", r6(value, "blended"))


KIND = "CASE WHEN " + " OR ".join(f"contains(lower(coalesce(industry, '')), '{n}')" for n in X.HOLDING_INDUSTRIES) + " THEN 'holding' WHEN " + " OR ".join(f"contains(lower(coalesce(industry, '')), '{n}')" for n in X.COMMODITY_INDUSTRIES) + " THEN 'commodity' ELSE 'standard' END"


@query(f"SELECT {KIND} AS company_type, count(*) AS n FROM xsection GROUP BY 1", "xsection")
def prj_10_company_kinds(t: Tables):
    return t.xsection.groupBy(X.company_kind().alias("company_type")).agg(F.count("*").alias("n"))


@query("SELECT ticker AS \"Ticker\", sector AS \"Sector\", round(pe_trailing, 6) AS \"PE\" FROM xsection", "xsection")
def prj_12_display_names(t: Tables):
    names = {"ticker": "Ticker", "sector": "Sector", "pe_trailing": "PE"}
    return t.xsection.withColumn("pe_trailing", F.round("pe_trailing", 6)).select(*[F.col(c).alias(n) for c, n in names.items()])


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'fund' WHEN contains(lower(p_type), 'steel') THEN 'bond' ELSE 'stock' END AS kind, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS clean FROM part")
def prj_13_names(t: Tables):
    low = F.lower("p_type")
    return t.part.select("p_partkey", F.when(F.contains(low, F.lit("brass")), "fund").when(F.contains(low, F.lit("steel")), "bond").otherwise("stock").alias("kind"), F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " ")).alias("clean"))


MARGINS = ["roe", "roa", "gross_margin", "operating_margin"]
SANE = ", ".join(
    [
        *[f"round(CASE WHEN {c} >= 6 AND {c} <= 200 THEN {c} END, 6) AS {c}" for c in ("pe_trailing", "pe_forward")],
        "round(CASE WHEN dividend_yield < 0 THEN NULL WHEN dividend_yield > 0.1 THEN dividend_yield / 100 ELSE dividend_yield END, 6) AS dividend_yield",
        "round(CASE WHEN debt_to_equity > 200 THEN NULL WHEN debt_to_equity < 0 THEN 0 ELSE debt_to_equity END, 6) AS debt_to_equity",
        "round(CASE WHEN current_ratio > 20 THEN NULL WHEN current_ratio < 0 THEN 0 ELSE current_ratio END, 6) AS current_ratio",
        *[f"round(CASE WHEN abs({c}) <= 5 THEN {c} END, 6) AS {c}" for c in MARGINS],
    ]
)


@query(f"SELECT ticker, {SANE} FROM xsection", "xsection")
def prj_03_save_sanity(t: Tables):
    c = F.col
    held = lambda x, most: F.when(c(x) <= most, F.greatest(c(x), F.lit(0.0)))
    columns = {x: F.when(c(x).between(6, 200), c(x)) for x in ("pe_trailing", "pe_forward")}
    columns["dividend_yield"] = F.when(c("dividend_yield") > 0.1, c("dividend_yield") / 100).when(c("dividend_yield") >= 0, c("dividend_yield"))
    columns |= {"debt_to_equity": held("debt_to_equity", 200), "current_ratio": held("current_ratio", 20)}
    columns |= {x: F.when(F.abs(x) <= 5, c(x)) for x in MARGINS}
    return t.xsection.select("ticker", *[r6(e, n) for n, e in columns.items()])


@query("WITH b AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) > 0.4) SELECT ticker, CASE WHEN pk IN (SELECT l_partkey FROM b) THEN 'blacklisted' ELSE 'failed lookup' END AS reason FROM xsection WHERE pk IN (SELECT l_partkey FROM b) OR market_cap IS NULL OR avg_volume IS NULL", "xsection")
def flt_17_blacklisted(t: Tables):
    """Parts that mostly come back stand for the blacklist, names without size or volume for failed lookups."""
    back = F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    listed = t.lineitem.groupBy(F.col("l_partkey").alias("pk")).agg(back.alias("back")).where("back > 0.4").select("pk", F.lit(True).alias("listed"))
    x = t.xsection.join(listed, "pk", "left").where("listed or market_cap is null or avg_volume is null")
    return x.select("ticker", F.when(F.col("listed"), "blacklisted").otherwise("failed lookup").alias("reason"))


@query("WITH d AS (SELECT *, score_total - lag(score_total) OVER (PARTITION BY ticker ORDER BY snapshot_date) AS delta FROM snapshots) SELECT ticker, snapshot_date, delta FROM d WHERE delta <> 0", "snapshots")
def flt_16_changed_rows(t: Tables):
    d = F.col("score_total") - F.lag("score_total").over(Window.partitionBy("ticker").orderBy("snapshot_date"))
    return t.snapshots.withColumn("delta", d).where("delta <> 0").select("ticker", "snapshot_date", "delta")


@query("SELECT s.ticker, s.snapshot_date, s.score_total - p.score_total AS delta FROM snapshots s LEFT JOIN snapshots p ON upper(s.ticker) = upper(p.ticker) AND p.snapshot_date = s.snapshot_date - INTERVAL 1 MONTH", "snapshots")
def jn_07_08_previous_scores(t: Tables):
    s = t.snapshots
    p = s.select(F.upper("ticker").alias("key"), F.add_months("snapshot_date", 1).alias("snapshot_date"), F.col("score_total").alias("was"))
    return s.withColumn("key", F.upper("ticker")).join(p, ["key", "snapshot_date"], "left").select("ticker", "snapshot_date", (F.col("score_total") - F.col("was")).alias("delta"))


@query("WITH a AS (SELECT user_id AS pk, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS net, count(*) AS n FROM events GROUP BY 1) SELECT ticker, round(coalesce(net, 0), 4) AS net, coalesce(n, 0) AS n FROM xsection LEFT JOIN a USING (pk)", "xsection")
def jn_05_insider_totals(t: Tables):
    a = t.events.groupBy(F.col("user_id").alias("pk")).agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("net"), F.count("*").alias("n"))
    return t.xsection.join(a, "pk", "left").select("ticker", F.round(F.coalesce("net", F.lit(0.0)), 4).alias("net"), F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS k FROM events) SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean, sum(CASE WHEN value > 200 THEN 1 ELSE 0 END)::BIGINT AS slow, round(max(value), 6) AS slowest FROM k WHERE k <= 100 GROUP BY event_type")
def agg_16_19_stage_performance(t: Tables):
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), "event_id")
    k = t.events.withColumn("k", F.row_number().over(w)).where("k <= 100")
    return k.groupBy("event_type").agg(F.count("*").alias("calls"), r6(F.avg("value"), "mean"), F.count_if(F.col("value") > 200).alias("slow"), r6(F.max("value"), "slowest"))


@query("WITH w AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, avg(value - 50) AS pnl FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS weeks, round(avg(pnl), 6) AS mean, round(median(pnl), 6) AS median, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(52), 5) AS sharpe, arg_max(week, (round(pnl, 9), week)) AS best FROM w GROUP BY event_type")
def agg_17_weekly_statistics(t: Tables):
    w = t.events.groupBy("event_type", F.trunc(F.col("ts").cast("date"), "WEEK").alias("week")).agg(F.avg(F.col("value") - 50).alias("pnl"))
    return w.groupBy("event_type").agg(F.count("*").alias("weeks"), r6(F.avg("pnl"), "mean"), r6(F.median("pnl"), "median"), F.round(ratio(F.avg("pnl"), F.stddev_samp("pnl")) * F.sqrt(F.lit(52.0)), 5).alias("sharpe"), F.max_by("week", F.struct(F.round("pnl", 9), "week")).alias("best"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_18_grouped_lists(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.count("*").alias("n"))


@query("SELECT ticker, sector FROM xsection WHERE sector IN ('Technology', 'Energy', 'Utilities') ORDER BY CASE sector WHEN 'Energy' THEN 0 WHEN 'Utilities' THEN 1 ELSE 2 END, roe DESC NULLS LAST, ticker LIMIT 40", "xsection")
def top_04_custom_order(t: Tables):
    place = C.lookup({"Energy": 0, "Utilities": 1}, F.col("sector"), 2)
    return t.xsection.where(F.col("sector").isin("Technology", "Energy", "Utilities")).orderBy(place, F.col("roe").desc_nulls_last(), "ticker").limit(40).select("ticker", "sector")


@query("WITH c AS (SELECT count(*) AS peers FROM xsection WHERE sector = 'Utilities' AND piotroski_f >= 8) SELECT ticker, round(roe + CASE WHEN peers < 3 AND sector = 'Utilities' THEN 0.1 ELSE 0 END, 6) AS score FROM xsection, c WHERE roe IS NOT NULL ORDER BY roe + CASE WHEN peers < 3 AND sector = 'Utilities' THEN 0.1 ELSE 0 END DESC, ticker LIMIT 15", "xsection")
def top_06_boosted_replacements(t: Tables):
    x = t.xsection.where("roe is not null")
    peers = t.xsection.where("sector = 'Utilities' and piotroski_f >= 8").agg(F.count("*").alias("peers"))
    score = F.col("roe") + F.when((F.col("peers") < 3) & (F.col("sector") == "Utilities"), 0.1).otherwise(0.0)
    return x.crossJoin(F.broadcast(peers)).withColumn("score", score).orderBy(F.col("score").desc(), "ticker").limit(15).select("ticker", r6("score"))


@query("SELECT event_type, user_id, CAST(ts AS DATE) AS day, value >= 100 AS up FROM events WHERE abs(value - 50) >= 100 GROUP BY ALL")
def stm_07_big_moves(t: Tables):
    return t.events.where(F.abs(F.col("value") - 50) >= 100).select("event_type", "user_id", F.to_date("ts").alias("day"), (F.col("value") >= 100).alias("up")).distinct()


@query("SELECT CASE WHEN age < 7 THEN 'fresh' WHEN age < 14 THEN 'aging' ELSE 'stale' END AS tier, count(*) AS n FROM (SELECT datediff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age FROM events) GROUP BY 1")
def stm_11_age_tiers(t: Tables):
    age = F.datediff(F.lit("2024-01-31").cast("date"), "ts")
    return t.events.groupBy(F.when(age < 7, "fresh").when(age < 14, "aging").otherwise("stale").alias("tier")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT event_id, user_id, value, ts, lag(value) OVER w AS before, lag(ts) OVER w AS before_ts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)) SELECT event_id, coalesce(abs(value / nullif(before, 0) - 1) <= 0.2 OR date_trunc('month', ts) = date_trunc('month', before_ts) AND value < before, false) AS routine FROM l")
def stm_14_routine_traders(t: Tables):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts")
    l = t.events.withColumns({"before": F.lag("value").over(w), "before_ts": F.lag("ts").over(w)})  # noqa: E741
    same_month = F.trunc(F.col("ts").cast("date"), "MM") == F.trunc(F.col("before_ts").cast("date"), "MM")
    near = known(F.abs(ratio("value", "before") - 1) <= 0.2)
    return l.select("event_id", (near | known(same_month & (F.col("value") < F.col("before")))).alias("routine"))


@query("SELECT c_custkey, upper(substr(c_name, 1, 4)) AS code, length(trim(c_name))::BIGINT AS size, concat_ws('-', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS tag, c_name LIKE '%1%' AS has_one FROM customer")
def fn_03_06_strings(t: Tables):
    return t.customer.select("c_custkey", F.upper(F.substring("c_name", 1, 4)).alias("code"), F.length(F.trim("c_name")).cast("long").alias("size"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("tag"), F.contains("c_name", F.lit("1")).alias("has_one"))


@query("SELECT event_type, round(skewness(value), 4) AS skew, round(quantile_cont(value, 0.25), 6) AS q1, round(regr_slope(value, user_id), 6) AS slope FROM events GROUP BY event_type")
def fn_02_statistics(t: Tables):
    from tallyloom.functions.stats import sample_skew

    return t.events.groupBy("event_type").agg(F.round(sample_skew("value"), 4).alias("skew"), r6(F.percentile("value", F.lit(0.25)), "q1"), r6(F.regr_slope("value", "user_id"), "slope"))


@query(f"SELECT ticker, ({case_map('currency', {'SEK': 1, 'EUR': 2}, '0')})::BIGINT AS code FROM xsection", "xsection")
def fn_07_map_lookup(t: Tables):
    return t.xsection.select("ticker", C.lookup({"SEK": 1, "EUR": 2}, F.col("currency"), 0).cast("long").alias("code"))
