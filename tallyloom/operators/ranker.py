"""Learning to rank: trees boosted on pairwise gradients inside each month's cross-section.

A row's gradient sums over all rows of another grade in its month.  Rows of one grade and score have the same gradient,
so pairs are taken between (grade, score) groups and weighted by their counts: exact, and as many as the model's
different scores allow, not as rows do.  Gradients are summed by (leaf, feature, bin) where the rows are; the driver sees
those sums alone and picks the cuts.  The model is a list of trees, and a score an expression of the bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio
from tallyloom.operators.evaluation import rank_ic

GRADES, LEAST_GROUP = 5, 5


def graded(panel: DataFrame, outcome: str = "actual", least: int = LEAST_GROUP) -> DataFrame:
    """panel with grade, the fifth of its month by outcome (0 to 4, ties by ticker); months of too few rows are left out."""
    m = Window.partitionBy("month")
    x = panel.where(F.col(outcome).isNotNull()).withColumn("n", F.count("*").over(m)).where(F.col("n") >= least)
    place = F.row_number().over(m.orderBy(outcome, "ticker"))
    return x.withColumn("grade", F.greatest(F.lit(0), F.ceil((place - 1) * GRADES / (F.col("n") - 1)).cast("int") - 1)).drop("n")


def cuts(train: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Values that cut each feature into bins of like size."""
    points = [k / bins for k in range(1, bins)]
    row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def bin_of(feature: str, at: list[float]) -> Column:
    """How many cuts lie under the value, from 1; 0 for a null."""
    below = F.size(F.filter(F.array(*[F.lit(float(x)) for x in at]).cast("array<double>"), lambda c: c < F.col(feature))) + 1
    return F.when(F.col(feature).isNull(), 0).otherwise(below).cast("int")


@dataclass
class Tree:
    """Nodes by number (the root is 1, children 2n and 2n + 1): cut nodes have (feature, bin), leaves a value."""

    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self) -> Column:
        """The node that a row's bins lead to."""

        def walk(n: int) -> Column:
            if n not in self.splits:
                return F.lit(n)
            name, at = self.splits[n]
            return F.when(F.col("bins")[name] <= at, walk(2 * n)).otherwise(walk(2 * n + 1))

        return walk(1)

    def value(self) -> Column:
        def walk(n: int) -> Column:
            if n not in self.splits:
                return F.lit(self.values.get(n, 0.0))
            name, at = self.splits[n]
            return F.when(F.col("bins")[name] <= at, walk(2 * n)).otherwise(walk(2 * n + 1))

        return walk(1)


@dataclass
class Ranker:
    cuts: dict[str, list[float]]
    trees: list[Tree]
    rate: float

    def bins(self) -> Column:
        return F.struct(*[bin_of(f, at).alias(f) for f, at in self.cuts.items()])

    def score(self) -> Column:
        """The sum of the trees, of a row with bins."""
        return F.round(sum((F.lit(self.rate) * t.value() for t in self.trees), F.lit(0.0)), 9)

    def apply(self, rows: DataFrame, name: str = "score") -> DataFrame:
        return rows.withColumn("bins", self.bins()).withColumn(name, self.score()).drop("bins")


def gradients(rows: DataFrame) -> DataFrame:
    """month, grade, score, g and h: how far a row of that kind should rise, and how sure that is, from all pairs with other grades.

    A pair of grades a > b loses log(1 + exp(b's score - a's)).
    """
    kinds = rows.groupBy("month", "grade", "score").agg(F.count("*").alias("n"))
    others = kinds.select("month", F.col("grade").alias("its_grade"), F.col("score").alias("its_score"), F.col("n").alias("its_n"))
    both = kinds.join(others, "month").where("grade <> its_grade")
    above = F.col("grade") > F.col("its_grade")
    gap = F.when(above, F.col("score") - F.col("its_score")).otherwise(F.col("its_score") - F.col("score"))
    rho = 1 / (1 + F.exp(gap))
    return both.groupBy("month", "grade", "score").agg(F.sum(F.when(above, rho).otherwise(-rho) * F.col("its_n")).alias("g"), F.sum(rho * (1 - rho) * F.col("its_n")).alias("h"))


def best_cut(sums: list, damp: float, least: float) -> tuple[float, str, int] | None:
    """(gain, feature, bin) of the best cut of one node; sums: (feature, bin, g, h)."""
    found = None
    for name in sorted({s[0] for s in sums}):
        own = sorted(s[1:] for s in sums if s[0] == name)
        total_g, total_h = sum(s[1] for s in own), sum(s[2] for s in own)
        left_g = left_h = 0.0
        for at, g, h in own[:-1]:
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = total_g - left_g, total_h - left_h
            if left_h < least or right_h < least:
                continue
            gain = left_g**2 / (left_h + damp) + right_g**2 / (right_h + damp) - total_g**2 / (total_h + damp)
            if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                found = (gain, name, at)
    return found


def fit(train: DataFrame, features: list[str], rounds: int = 5, depth: int = 2, bins: int = 16, rate: float = 0.5, damp: float = 1.0, least: float = 1.0) -> Ranker:
    """A ranker from rows of month, grade and features."""
    model = Ranker(cuts(train, features, bins), [], rate)
    rows = train.select("month", "grade", model.bins().alias("bins")).cache()
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("bins")[f].alias("bin")) for f in features])
    for _ in range(rounds):
        scored = rows.withColumn("score", model.score())
        pulled = scored.join(gradients(scored), ["month", "grade", "score"]).select("bins", "g", "h")
        tree, open_nodes = Tree(), {1}
        for _ in range(depth):
            where = pulled.withColumn("node", tree.node()).where(F.col("node").isin(*open_nodes))
            # a row for each node, feature and bin
            sums = where.select("node", "g", "h", F.inline(cells)).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            following: set[int] = set()
            for n in sorted(open_nodes):
                own = [(r["feature"], r["bin"], r["g"], r["h"]) for r in sums if r["node"] == n]
                if found := best_cut(own, damp, least):
                    _, name, at = found
                    tree.splits[n] = (name, at)
                    for child, side in ((2 * n, True), (2 * n + 1, False)):
                        g = sum(x[2] for x in own if x[0] == name and (x[1] <= at) == side)
                        h = sum(x[3] for x in own if x[0] == name and (x[1] <= at) == side)
                        tree.values[child] = g / (h + damp)
                        following.add(child)
            open_nodes = following
            if not open_nodes:
                break
        if not tree.splits:
            break
        model.trees.append(tree)
    rows.unpersist()
    return model


def ndcg(rows: DataFrame, score: str, k: int = 10) -> DataFrame:
    """month, ndcg: discounted gain (2^grade - 1) of the first k by score (ties by ticker) over that of the best order."""
    m = Window.partitionBy("month")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    x = rows.withColumns({"place": F.row_number().over(m.orderBy(F.col(score).desc_nulls_last(), "ticker")), "best": F.row_number().over(m.orderBy(F.col("grade").desc(), "ticker"))})
    part = lambda place: F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    return x.groupBy("month").agg(ratio(part("place"), part("best")).alias("ndcg"))


def spread(rows: DataFrame, score: str, outcome: str = "actual") -> DataFrame:
    """month, spread: mean outcome of the best tenth by score less that of the worst."""
    m = Window.partitionBy("month")
    x = rows.withColumns({"place": F.row_number().over(m.orderBy(score, "ticker")), "size": F.count("*").over(m)})
    tenth = F.greatest(F.lit(1), F.floor(F.col("size") / 10))
    return x.groupBy("month").agg((F.avg(F.when(F.col("place") > F.col("size") - tenth, F.col(outcome))) - F.avg(F.when(F.col("place") <= tenth, F.col(outcome)))).alias("spread"))


def walk_forward(panel: DataFrame, features: list[str], first: int = 24, test: int = 12, regress=None, **options) -> DataFrame:
    """fold, n_train, n_test, ndcg, ic, spread (and regression_ndcg) of rankers trained on all months before each test span.

    The first span starts after first months; the month before each test trains nothing, as its outcomes reach into it.
    """
    rows = graded(panel).cache()
    months = [r["month"] for r in rows.select("month").distinct().orderBy("month").collect()]  # a row a month
    out = None
    for fold, start in enumerate(range(first, len(months), test)):
        train, tested = rows.where(F.col("month") < months[start - 1]), rows.where(F.col("month").isin(*months[start : start + test]))
        scored = fit(train, features, **options).apply(tested)
        scores = rank_ic(scored.select("month", F.col("score").alias("pred"), "actual")).join(ndcg(scored, "score"), "month", "full").join(spread(scored, "score"), "month", "full")
        values = [F.avg("ndcg").alias("ndcg"), F.avg("ic").alias("ic"), F.avg("spread").alias("spread")]
        if regress:
            scores = scores.join(ndcg(regress(train)(tested), "guess").withColumnRenamed("ndcg", "other"), "month", "full")
            values.append(F.avg("other").alias("regression_ndcg"))
        sizes = tested.agg(F.count("*").alias("n_test"))
        row = scores.agg(*values).crossJoin(sizes).withColumn("fold", F.lit(fold).cast("long"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out
