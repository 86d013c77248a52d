"""Cross-sectional statistics as column expressions and table transformations.

Missing values are nulls.  Every window is partitioned (by date, group or metric),
so many cross-sections are worked on side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_VALID = 5


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(cond: Column) -> Column:
    """A condition whose unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def clip(x, low=None, high=None) -> Column:
    """x held between bounds; null stays null (least and greatest alone would skip it)."""
    x = col(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low) if isinstance(low, (int, float)) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if isinstance(high, (int, float)) else high)
    return F.when(x.isNotNull(), out)


def ratio(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def row_mean(*columns) -> Column:
    """Mean of the values that are there; null if none is."""
    cs = [col(c) for c in columns]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return ratio(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs]), n)


def average_rank(x, by: list, descending: bool = False) -> Column:
    """Ranks from 1, ties sharing their mean rank; null for nulls.

    The first and the last place among ties come from one ordered window, so a rank is one shuffle and one sort.
    """
    x = col(x)
    order = Window.partitionBy(*by).orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())
    last = F.count(x).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + last) / 2)


def pct_rank(x, by: list, descending: bool = False) -> Column:
    """Average rank as a percentage of the values that are there."""
    return average_rank(x, by, descending) / F.count(col(x)).over(Window.partitionBy(*by)) * 100


def demean_by_median(df: DataFrame, columns: list[str], by: list) -> DataFrame:
    """columns less the median of their group (null keys form one): a row of medians for each group, joined back.

    df is read twice: write it before if it is dear to work out.
    """
    keys = {f"its_key_{k}": col(b) for k, b in enumerate(by)}
    medians = df.select(*[c.alias(k) for k, c in keys.items()], *columns).groupBy(*keys).agg(*[F.median(c).alias(f"median_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(medians[k]) for k, c in keys.items()])
    return df.join(medians, same).withColumns({c: F.col(c) - F.col(f"median_{c}") for c in columns}).drop(*keys, *[f"median_{c}" for c in columns])


def points(columns: dict[str, tuple[float, float]]) -> list[float]:
    return sorted({p for pair in columns.values() for p in pair})


def melt(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, metric, value: one row for each metric; nulls are kept."""
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])
    return df.select(*keys, F.inline(entries))


def rank_metrics(df: DataFrame, keys: list[str], by: list[str], metrics: dict[str, tuple]) -> DataFrame:
    """keys plus a percentile rank for each metric, all ranked side by side in one shuffle.

    metrics: name -> (expression, ascending, (low, high) or None to leave values as they are).  A metric with under
    MIN_VALID values in its cross-section is null throughout.
    """
    long = melt(df, keys, {n: m[0] for n, m in metrics.items()})
    up = F.lit(False)
    for n, m in metrics.items():
        if m[1]:
            up = up | (F.col("metric") == n)
    bounded = {n: m[2] for n, m in metrics.items() if m[2]}
    if bounded:
        p = points(bounded)
        q = long.groupBy(*by, "metric").agg(F.percentile("value", F.array(*[F.lit(x) for x in p])).alias("q"))
        lows = F.create_map(*[x for n, (lo, _) in bounded.items() for x in (F.lit(n), F.lit(p.index(lo)))])
        highs = F.create_map(*[x for n, (_, hi) in bounded.items() for x in (F.lit(n), F.lit(p.index(hi)))])
        q = q.select(*by, "metric", F.col("q")[lows[F.col("metric")]].alias("low"), F.col("q")[highs[F.col("metric")]].alias("high"))
        held = F.when(F.col("low").isNull(), F.col("value")).otherwise(clip("value", F.col("low"), F.col("high")))
        long = long.join(q, [*by, "metric"], "left").withColumn("value", held).drop("low", "high")
    signed = long.withColumn("value", F.when(up, F.col("value")).otherwise(-F.col("value")))
    n = F.count("value").over(Window.partitionBy(*by, "metric"))
    ranked = signed.withColumn("score", F.when(n >= MIN_VALID, pct_rank("value", [*by, "metric"])))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in metrics])


def quantile_bucket(rank: Column, n: Column, q: int) -> Column:
    """Bucket (0 to q - 1) of a rank from 1 to n, cut at interpolated quantiles, edges to the left."""
    return F.greatest(F.lit(0), F.ceil(((rank - 1) * q) / F.nullif(n - 1, F.lit(0))).cast("int") - 1)


def sample_skew(c) -> Column:
    n = F.count(col(c)).cast("double")
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c) -> Column:
    n = F.count(col(c)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(c)) + 6))


def normal_cdf(x) -> Column:
    """Standard normal distribution: the complementary error function by a rational approximation (error < 1.2e-7)."""
    x = col(x)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the approximation, from the constant term up.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    tail = t * F.exp(-z * z + poly) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)
