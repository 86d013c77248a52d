"""Combinatorial purged cross-validation: folds as rows, a weighted model for each combination, out-of-sample paths."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import average_rank, ratio
from tallyloom.operators.ranker import cuts

# Rows before a test block whose outcome reaches into it, share of rows left out after it, half-life of weights in years.
PURGE, EMBARGO, HALF_LIFE = 30, 0.01, 2.0
#: Bins of a feature that trees cut between.
BINS = 16


def positions(panel: DataFrame) -> DataFrame:
    """panel with position (from 0, by month, then ticker) and total: numbers inside each month, after all of the months before.

    Months are few, so only their counts are summed in order; no task sees all rows.
    """
    months = panel.groupBy("month").agg(F.count("*").alias("n"))
    order = Window.orderBy("month")  # a row a month
    before = months.select("month", (F.sum("n").over(order) - F.col("n")).alias("rows_before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("month").orderBy("ticker")) - 1
    return panel.withColumn("row_inside", inside).join(before, "month").withColumn("position", F.col("rows_before") + F.col("row_inside")).drop("row_inside", "rows_before")


def paths(blocks: int, tests: int) -> list[tuple[int, tuple[int, ...], dict[int, int]]]:
    """(combination, its test blocks, the path that each of them belongs to): path p takes each block from the p-th combination that tests it."""
    seen, out = [0] * blocks, []
    for number, chosen in enumerate(combinations(range(blocks), tests)):
        out.append((number, chosen, {b: seen[b] for b in chosen}))
        for b in chosen:
            seen[b] += 1
    return out


def placed(panel: DataFrame, blocks: int = 6) -> DataFrame:
    """panel with position, total, size (rows of a block) and block: rows stand in order of time in blocks of equal size, the last one takes what is left."""
    x = positions(panel).withColumn("size", F.floor(F.col("total") / blocks))
    return x.withColumn("block", F.least(F.lit(blocks - 1), F.floor(F.col("position") / F.greatest("size", F.lit(1)))).cast("int"))


def role(chosen: tuple[int, ...], blocks: int, purge: int = PURGE, embargo: float = EMBARGO) -> Column:
    """What a placed row does if the chosen blocks are tested: test, purged, embargo or train."""
    at, size, wait = F.col("position"), F.col("size"), F.greatest(F.lit(1), F.floor(F.col("total") * embargo))
    near, after = F.lit(False), F.lit(False)
    for b in chosen:
        start, stop = size * b, (F.col("total") if b == blocks - 1 else size * (b + 1))
        near = near | ((at >= start - purge) & (at < start))
        after = after | ((at >= stop) & (at < stop + wait))
    return F.when(F.col("block").isin(*chosen), "test").when(near, "purged").when(after, "embargo").otherwise("train")


def path_of(way: dict[int, int]) -> Column:
    """The path that a tested block belongs to; null for other blocks."""
    return F.coalesce(*[F.when(F.col("block") == b, F.lit(p)) for b, p in way.items()]).cast("int")


def combinatorial_folds(panel: DataFrame, blocks: int = 6, tests: int = 2, purge: int = PURGE, embargo: float = EMBARGO) -> DataFrame:
    """A row for each row and combination of test blocks: combination, role (train, test, purged or embargo), block and path (test rows only).

    Next to each run of test blocks, the purge rows before it and the share of all rows after it train nothing.
    """
    cells = [F.struct(F.lit(n).alias("combination"), role(chosen, blocks, purge, embargo).alias("role"), path_of(way).alias("path")) for n, chosen, way in paths(blocks, tests)]
    return placed(panel, blocks).select(*[F.col(f"`{c}`") for c in panel.columns], "position", "block", F.inline(F.array(*cells)))


def training_rows(panel: DataFrame, target: str = "actual", low: float = -0.9, high: float = 5.0) -> DataFrame:
    """Rows with a plausible outcome, target_cs (the outcome less its month's mean) and weight (halved by age, mean one)."""
    x = panel.where(F.col(target).between(low, high))
    last = x.agg(F.max("month").alias("last"))
    x = x.withColumn("target_cs", F.col(target) - F.avg(target).over(Window.partitionBy("month"))).crossJoin(F.broadcast(last))  # one row
    return x.withColumn("weight", F.exp(-F.ln(F.lit(2.0)) / HALF_LIFE * F.datediff("last", "month") / 365.25)).drop("last")


def cell_of(features: list[str], at: dict[str, list[float]]) -> dict[str, Column]:
    """A bin for each feature: 1 and how many of its cuts lie under the value."""
    return {f"its_bin_{k}": reduce(lambda n, c, f=f: n + (F.col(f) > c).cast("double"), at[f], F.lit(1.0)) for k, f in enumerate(features)}


def boosted(train: DataFrame, features: list[str], seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Boosted trees on weighted rows; gives a function that adds guess.

    Trees that cut between bins and fit squares see of rows in the same bins only their weight and their mean outcome.  So
    they are fitted on a row for each cell of bins, at most BINS ** len(features) of them, whatever the number of rows;
    what is left of the squares inside a cell is the same on both sides of each cut.  Bins are quantiles of the rows.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = train.fillna(0.0, features)
    bins = cell_of(features, cuts(rows, features, BINS))
    weight = F.sum("weight")
    cells = rows.groupBy(*[c.alias(n) for n, c in bins.items()]).agg(weight.alias("its_weight"), ratio(F.sum(F.col("weight") * F.col("target_cs")), weight).alias("its_mean"))
    gather = VectorAssembler(inputCols=list(bins), outputCol="its_features")
    kept = gather.transform(cells).select("its_features", "its_weight", "its_mean").cache()
    # two spare bins, so that each of the cells' own is cut off from the next
    model = GBTRegressor(featuresCol="its_features", labelCol="its_mean", weightCol="its_weight", predictionCol="guess", maxIter=4, maxDepth=3, maxBins=BINS + 2, seed=seed).fit(kept)
    kept.unpersist()
    return lambda rows: model.transform(gather.transform(rows.fillna(0.0, features).withColumns(bins))).drop("its_features", *bins)


def side_by_side(tested: Callable[..., DataFrame], items: list, at_once: int = 4) -> DataFrame | None:
    """The rows that tested gives for all items, their models fitted some at a time, so that small jobs don't wait for each other."""
    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(tested, items))
    return reduce(DataFrame.unionByName, parts) if parts else None


def out_of_sample(panel: DataFrame, features: list[str], blocks: int = 6, tests: int = 2, fit=boosted, least_train: int = 100, least_test: int = 20) -> DataFrame:
    """Each combination's model on its test rows: month, ticker, target_cs, guess, combination, block, path.

    The placed rows are kept once, and each combination takes its own of them, so what is kept doesn't grow with the combinations.
    """
    kept = placed(training_rows(panel), blocks).select("month", "ticker", "target_cs", "weight", *features, "position", "total", "size", "block").cache()
    ways = paths(blocks, tests)
    count = lambda chosen, name: F.count(F.when(role(chosen, blocks) == name, 1))
    sizes = kept.agg(*[count(chosen, name).alias(f"{name}_{n}") for n, chosen, _ in ways for name in ("train", "test")]).first()
    numbers = [w for w in ways if sizes[f"train_{w[0]}"] >= least_train and sizes[f"test_{w[0]}"] >= least_test]

    def tested(way: tuple) -> DataFrame:
        number, chosen, places = way
        own = kept.withColumns({"role": role(chosen, blocks), "combination": F.lit(number), "path": path_of(places)})
        return fit(own.where("role = 'train'"), features)(own.where("role = 'test'")).select("month", "ticker", "target_cs", "guess", "combination", "block", "path")

    found = side_by_side(tested, numbers)
    empty = kept.limit(0).select("month", "ticker", "target_cs", F.lit(0.0).alias("guess"), F.lit(0).alias("combination"), "block", F.lit(0).alias("path"))
    return found if found is not None else empty


def path_scores(tested: DataFrame, by: str = "path", least: int = 5) -> DataFrame:
    """By path: the rank correlation of guess and outcome, as the mean over months, the months, rows and the share of right signs.

    Months of too few rows or of one guess or outcome have no correlation.  Rows are shuffled and sorted by outcome once;
    guesses are ranked by their counts, as trees give few different ones.
    """
    own = [by, "month"]
    middle = (F.count("target_cs").over(Window.partitionBy(*own)) + 1) / 2
    right = ((F.col("guess") > 0) == (F.col("target_cs") > 0)).cast("double")
    rows = tested.select(*own, "guess", (average_rank("target_cs", own) - middle).alias("off"), right.alias("right"))
    each = rows.groupBy(*own, "guess").agg(F.count("*").alias("n"), F.sum("off").alias("off"), F.sum(F.col("off") * F.col("off")).alias("squares"), F.sum("right").alias("right"))
    order, whole = Window.partitionBy(*own).orderBy("guess"), Window.partitionBy(*own)
    last = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("its_off", last - (F.col("n") - 1) / 2 - (F.sum("n").over(whole) + 1) / 2)
    months = each.groupBy(*own).agg(
        F.sum("n").alias("n"),
        F.sum("right").alias("right"),
        F.sum(F.col("its_off") * F.col("off")).alias("c"),
        F.sum(F.col("n") * F.col("its_off") * F.col("its_off")).alias("sp"),
        F.sum("squares").alias("sa"),
    )
    fits = (F.col("n") >= least) & (F.col("sp") > 0) & (F.col("sa") > 0)
    ic = months.withColumn("ic", F.when(fits, F.col("c") / F.sqrt(F.col("sp") * F.col("sa"))))
    return ic.groupBy(by).agg(F.sum("n").alias("rows"), (F.sum("right") / F.sum("n")).alias("hit_rate"), F.nullif(F.count("ic"), F.lit(0)).alias("months"), F.avg("ic").alias("ic"))


def group_scores(panel: DataFrame, features: list[str], group: str, least: int = 2000, share: float = 0.8, fit=boosted) -> DataFrame:
    """A model for each group of enough rows, trained on its first share by time and scored on the rest: group, rows, months, ic, hit_rate.

    A month that the cut divides belongs to the test.
    """
    rows = training_rows(panel)
    counts = rows.groupBy(group, "month").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    # a row for each group and month
    placed = counts.withColumn("so_far", F.sum("n").over(w.orderBy("month"))).withColumn("total", F.sum("n").over(w)).where(F.col("total") >= least)
    cuts = placed.where(F.col("so_far") >= F.floor(F.col("total") * share)).groupBy(group).agg(F.min("month").alias("cut"))
    cached = rows.join(F.broadcast(cuts), group).cache()

    def tested(which) -> DataFrame:
        own = cached.where(F.col(group) == which)
        return fit(own.where("month < cut"), features)(own.where("month >= cut")).select(group, "month", "ticker", "target_cs", "guess")

    found = side_by_side(tested, [r[group] for r in cuts.orderBy(group).collect()])  # a row a group
    if found is None:
        found = cached.limit(0).select(group, "month", "ticker", "target_cs", F.lit(0.0).alias("guess"))
    return path_scores(found, group)


def weighted_line(train: DataFrame, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Weighted least squares on one feature by sums: a plain model beside the trees."""
    (x,) = features
    w, v, y = F.col("weight"), F.coalesce(F.col(x), F.lit(0.0)), F.col("target_cs")
    s = train.agg(F.sum(w).alias("w"), F.sum(w * v).alias("x"), F.sum(w * y).alias("y"), F.sum(w * v * v).alias("xx"), F.sum(w * v * y).alias("xy"))
    line = s.select(ratio(F.col("xy") - F.col("x") * F.col("y") / F.col("w"), F.col("xx") - F.col("x") * F.col("x") / F.col("w")).alias("slope"), ratio("x", "w").alias("mean_x"), ratio("y", "w").alias("mean_y"))
    return lambda rows: rows.crossJoin(F.broadcast(line)).withColumn("guess", F.col("mean_y") + F.coalesce(F.col("slope"), F.lit(0.0)) * (F.coalesce(F.col(x), F.lit(0.0)) - F.col("mean_x"))).drop("slope", "mean_x", "mean_y")  # one row
