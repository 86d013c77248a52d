"""Evaluation of predictions (month, ticker, pred, actual) without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import average_rank, pct_rank, quantile_bucket, ratio



def month():
    return Window.partitionBy("month")


def rank_ic(panel: DataFrame, least: int = 5) -> DataFrame:
    """Spearman correlation of prediction and outcome by month, where there are enough rows and distinct values."""
    ranked = panel.withColumn("rp", average_rank("pred", ["month"])).withColumn("ra", average_rank("actual", ["month"]))
    fit = ranked.groupBy("month").agg(F.count("*").alias("n"), F.covar_pop("rp", "ra").alias("c"), F.stddev_pop("rp").alias("sp"), F.stddev_pop("ra").alias("sa"))
    return fit.where((F.col("n") >= least) & (F.col("sp") > 0) & (F.col("sa") > 0)).select("month", ratio("c", F.col("sp") * F.col("sa")).alias("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.agg(n.alias("n"), mean.alias("mean"), std.alias("std"), ratio(mean, std).alias("ir"), (ratio(mean, std) * F.sqrt(n)).alias("t"))


def ic_decay(ic: DataFrame) -> DataFrame:
    """Mean of three months and distance from the mean in deviations; one row a month, so a single window is small."""
    whole = ic.agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"))
    ma = F.avg("ic").over(Window.orderBy("month").rowsBetween(-2, 0))
    return ic.crossJoin(F.broadcast(whole)).withColumn("ma3", ma).withColumn("z", ratio(F.col("ic") - F.col("m"), "s"))


def placed(panel: DataFrame) -> DataFrame:
    return panel.withColumn("rn", F.row_number().over(month().orderBy("pred", "ticker"))).withColumn("n", F.count("*").over(month())).where("n >= 5")


def bucket_returns(panel: DataFrame, q: int) -> DataFrame:
    b = placed(panel).withColumn("bucket", quantile_bucket(F.col("rn"), F.col("n"), q))
    return b.groupBy("month", "bucket").agg(F.avg("actual").alias("a")).groupBy("bucket").agg(F.count("*").alias("months"), F.avg("a").alias("mean"))


def quintile_spread(panel: DataFrame) -> DataFrame:
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    top, bottom = F.col("rn") > F.col("n") - k, F.col("rn") <= k
    return placed(panel).groupBy("month").agg((F.avg(F.when(top, F.col("actual"))) - F.avg(F.when(bottom, F.col("actual")))).alias("spread"))


def decay_weights(panel: DataFrame, half_life_days: float = 730.0) -> DataFrame:
    last = panel.agg(F.max("month").alias("last"))
    w = panel.crossJoin(F.broadcast(last)).withColumn("w", F.exp(-F.ln(F.lit(2.0)) * F.datediff("last", "month") / half_life_days))
    mean = w.agg(F.avg("w").alias("mean_w"))
    return w.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("w") / F.col("mean_w"))


def fold_calendar(panel: DataFrame, first: str, n: int, months: int = 6, embargo: int = 35) -> DataFrame:
    """fold, start, stop, train_end: tests follow each other, training ends an embargo before."""
    spark = panel.sparkSession
    start = F.add_months(F.lit(first).cast("date"), (F.col("id") * months).cast("int"))
    return spark.range(n).select(F.col("id").alias("fold"), start.alias("start")).withColumn("stop", F.add_months("start", months)).withColumn("train_end", F.date_sub("start", embargo))


def fold_sizes(panel: DataFrame, first: str, n: int) -> DataFrame:
    by_month = panel.groupBy("month").agg(F.count("*").alias("rows"))
    folds = F.broadcast(fold_calendar(panel, first, n))
    both = by_month.join(folds, (F.col("month") < F.col("train_end")) | F.col("month").between(F.col("start"), F.date_sub("stop", 1)))
    train = F.sum(F.when(F.col("month") < F.col("train_end"), F.col("rows")).otherwise(0))
    test = F.sum(F.when(F.col("month") >= F.col("start"), F.col("rows")).otherwise(0))
    return both.groupBy("fold").agg(train.alias("n_train"), test.alias("n_test"))


def conformal(calibration: DataFrame, points: DataFrame, pred: str, actual: str, alpha: float) -> DataFrame:
    """points with low and high: prediction plus and minus a quantile of the residuals seen in calibration."""
    q = calibration.agg(F.percentile(F.abs(F.col(actual) - F.col(pred)), F.lit(1 - alpha)).alias("q"))
    return points.crossJoin(F.broadcast(q)).withColumn("low", F.col(pred) - F.col("q")).withColumn("high", F.col(pred) + F.col("q"))


def disagreement(panel: DataFrame, a: str, b: str, limit: float = 20.0) -> DataFrame:
    gap = F.abs(pct_rank(a, ["month"]) - pct_rank(b, ["month"]))
    return panel.withColumn("uncertainty", gap).withColumn("flagged", F.col("uncertainty") > limit)


def boosted_ic(panel: DataFrame, cut: str) -> DataFrame:
    """Train boosted trees before cut, less an embargo; rank IC by month after it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=["pred", "sector_id"], outputCol="features").transform(panel.where("pred is not null"))
    train = rows.where(F.col("month") < F.date_sub(F.lit(cut).cast("date"), 35))
    model = GBTRegressor(labelCol="actual", predictionCol="guess", maxIter=5, maxDepth=3, seed=42).fit(train)
    tested = model.transform(rows.where(F.col("month") >= F.lit(cut).cast("date"))).select("month", "ticker", F.col("guess").alias("pred"), "actual")
    return rank_ic(tested)
