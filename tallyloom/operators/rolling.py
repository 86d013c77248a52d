"""Models refitted on a rolling window of dates, and what their features are worth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import average_rank, ratio
from tallyloom.operators.evaluation import fold_calendar


def windows(panel: DataFrame, train: int, test: int) -> DataFrame:
    """month, fold, role: each date with the folds that train or test on it; a row for a date and fold, whatever the panel's size.

    Fold k trains on train dates from date k * test on, and tests on the test dates after them.
    """
    place = F.row_number().over(Window.orderBy("month")) - 1  # over distinct dates
    dates = panel.select("month").distinct().select("month", place.alias("i"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - train - test + 1) / test)), F.floor(F.col("i") / test)
    folds = dates.select("month", "i", F.explode(F.sequence(first, last)).alias("fold"))
    return folds.select("month", "fold", F.when(F.col("i") < F.col("fold") * test + train, "train").otherwise("test").alias("role"))


def rolling_backtest(panel: DataFrame, train: int = 24, test: int = 3, top: int = 10, least_train: int = 500, least_test: int = 10) -> DataFrame:
    """fold, n_train, n_test, ic, hit_rate, top_return, max_drawdown of a line fitted to (pred, actual) in each fold.

    Fits take sums by date first, so a row is read once however many folds train on it.  ic is the mean rank correlation
    by date, top_return the mean outcome of the tickers best placed on their last date, max_drawdown that of the mean outcome.
    """
    rows, w = panel.where("pred is not null and actual is not null"), F.broadcast(windows(panel, train, test))
    x, y = F.col("pred"), F.col("actual")
    sums = rows.groupBy("month").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    s = sums.join(w.where("role = 'train'"), "month").groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    slope = ratio(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    fit = s.where(F.col("n") >= least_train).withColumn("slope", slope).select("fold", F.col("n").alias("n_train"), "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("base"))
    tested = rows.join(w.where("role = 'test'"), "month").join(F.broadcast(fit), "fold").withColumn("guess", F.col("base") + F.col("slope") * F.col("pred"))

    ranked = tested.withColumn("rg", average_rank("guess", ["month"])).withColumn("ra", average_rank("actual", ["month"]))
    by_date = ranked.groupBy("fold", "n_train", "month").agg(F.count("*").alias("n"), F.corr("rg", "ra").alias("ic"), F.count_if((F.col("guess") > 0) == (F.col("actual") > 0)).alias("hits"), F.avg("actual").alias("mean"))
    run = Window.partitionBy("fold").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    equity = by_date.withColumn("equity", F.exp(F.sum(F.log1p("mean")).over(run))).withColumn("lost", F.col("equity") / F.max("equity").over(run) - 1)
    folds = equity.groupBy("fold", "n_train").agg(F.sum("n").alias("n_test"), F.avg(F.when(F.col("n") >= 5, F.col("ic"))).alias("ic"), (F.sum("hits") / F.sum("n")).alias("hit_rate"), F.min("lost").alias("max_drawdown"))

    latest = tested.groupBy("fold", "ticker").agg(F.max_by(F.struct("guess", "actual"), "month").alias("z"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.round("z.guess", 12).desc(), "ticker"))
    best = latest.withColumn("place", place).where(F.col("place") <= top).groupBy("fold").agg(F.avg("z.actual").alias("top_return"))
    return folds.join(best, "fold").where(F.col("n_test") >= least_test)


def shuffled(rows: DataFrame, feature: str, key: list[str], repeats: int, blocks: int) -> DataFrame:
    """rows once for each repeat, feature replaced by that of the next row in a random order of the row's random block.

    Blocks keep any one sort small; order and blocks are hashes of the key, so that a rerun shuffles alike.
    """
    x = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    x = x.withColumn("block", F.pmod(F.xxhash64("turn", *key), F.lit(blocks)))
    place = Window.partitionBy("turn", "block").orderBy(F.xxhash64(F.lit("order"), "turn", *key), *key)
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.when(F.row_number().over(place) == F.count("*").over(whole.orderBy("block")), F.first(feature).over(place)).otherwise(F.lead(feature).over(place))
    return x.withColumn("moved", moved).withColumn(feature, F.col("moved")).drop("moved", "block")


def permutation_importance(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], features: list[str], key: list[str], repeats: int = 5, blocks: int = 64) -> DataFrame:
    """feature, importance: mean growth of the squared error, as a share of it, when the feature is shuffled; predict adds guess to rows with actual."""
    error = F.avg((F.col("guess") - F.col("actual")) ** 2)
    base = predict(rows).agg(error.alias("base"))  # one row
    parts = [predict(shuffled(rows, f, key, repeats, blocks)).groupBy("turn").agg(error.alias("error")).select(F.lit(f).alias("feature"), "error") for f in features]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.crossJoin(F.broadcast(base)).where("base >= 1e-12").groupBy("feature").agg(F.avg(ratio(F.col("error") - F.col("base"), "base")).alias("importance"))


def partial_dependence(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], features: list[str], feature: str, points: int = 50) -> DataFrame:
    """at, guess: the prediction along the feature, from its 2nd to its 98th percentile (the whole range if they meet), others at their mean."""
    cut = lambda p: F.percentile(feature, F.lit(p))
    flat = F.abs(cut(0.98) - cut(0.02)) < 1e-10
    low, high = F.when(flat, F.min(feature)).otherwise(cut(0.02)), F.when(flat, F.max(feature)).otherwise(cut(0.98))
    one = rows.agg(low.alias("low"), high.alias("high"), *[F.avg(f).alias(f) for f in features])
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / (points - 1)
    grid = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).withColumn("at", at).withColumn(feature, F.col("at"))
    return predict(grid).select("at", "guess")


def meta_scores(primary: DataFrame, labels: DataFrame, features: list[str], first: str, folds: int, months: int = 6, embargo: int = 35, least_rank: float = 90.0, trees: int = 20) -> DataFrame:
    """fold, ticker, ts, label, probability that a buy (rank of least_rank and more) reaches its target, from a model of earlier buys.

    primary: ticker, ts, rank and features (nulls count as 0); labels: ticker, ts, label.  Each fold trains on buys up to
    an embargo before its first day, both classes weighing alike, and scores those of its months; folds that lack a
    class or test rows in their past are left out.  One distributed fit a fold; the driver holds counts and models only.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    buys = primary.where(F.col("rank") >= least_rank).join(labels.where("label is not null"), ["ticker", "ts"])
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(buys.fillna(0.0, features)).select("ticker", "ts", F.col("label").cast("double").alias("label"), "features")
    out = None
    for f in fold_calendar(primary, first, folds, months, embargo).orderBy("fold").collect():  # a row a fold
        train = rows.where(F.col("ts") < F.lit(f["train_end"]))
        sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # two rows
        if len(sizes) < 2:
            continue
        weight = F.when(F.col("label") == 1.0, sum(sizes.values()) / (2 * sizes[1.0])).otherwise(sum(sizes.values()) / (2 * sizes[0.0]))
        model = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.05, seed=42).fit(train.withColumn("weight", weight))
        test = rows.where((F.col("ts") >= F.lit(f["start"])) & (F.col("ts") < F.lit(f["stop"])))
        part = model.transform(test).select(F.lit(f["fold"]).alias("fold"), "ticker", "ts", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("probability"))
        out = part if out is None else out.union(part)
    return out if out is not None else rows.limit(0).select(F.lit(0).cast("long").alias("fold"), "ticker", "ts", F.col("label").cast("int").alias("label"), F.lit(0.0).alias("probability"))
