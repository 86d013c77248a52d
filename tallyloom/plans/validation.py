"""Queries of combinatorial validation, ranking models and hidden regimes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import markov as M
from tallyloom.operators import ranker as K
from tallyloom.operators import validation as V
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

CHOICES = list(combinations(range(6), 2))
PLACES = f"""c AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(CHOICES))}) v(combination, a, b)),
p AS (SELECT *, row_number() OVER (ORDER BY month, ticker) - 1 AS position, count(*) OVER () AS total FROM panel),
b AS (SELECT *, least(5, position // greatest(total // 6, 1)) AS block, total // 6 AS size, greatest(1, CAST(floor(total * 0.01) AS BIGINT)) AS wait FROM p),
f AS (SELECT b.*, combination, CASE WHEN block IN (a, b.b) THEN 'test'
  WHEN (position >= size * a - 30 AND position < size * a) OR (position >= size * b.b - 30 AND position < size * b.b) THEN 'purged'
  WHEN (position >= size * (a + 1) AND position < size * (a + 1) + wait) OR (b.b < 5 AND position >= size * (b.b + 1) AND position < size * (b.b + 1) + wait) THEN 'embargo'
  ELSE 'train' END AS role FROM (SELECT b.*, c.combination, c.a, c.b FROM b, c) b)"""


@query(f"WITH {PLACES} SELECT combination::INT AS combination, role, block::INT AS block, count(*) AS rows, sum(position)::BIGINT AS positions, min(month) AS first_month, max(month) AS last_month FROM f GROUP BY ALL", "panel")
def ml_07_cpcv_roles(t: Tables):
    """What each block's rows do in each of the fifteen combinations of two test blocks."""
    f = V.combinatorial_folds(t.panel)
    return f.groupBy("combination", "role", "block").agg(F.count("*").alias("rows"), F.sum("position").alias("positions"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query(
    f"""WITH {PLACES}, m AS (SELECT month, ticker, avg(pred) OVER (PARTITION BY month) AS mean, actual - avg(actual) OVER (PARTITION BY month) AS y FROM panel),
t AS (SELECT combination, block, month, ticker, pred / 100000 AS x, dense_rank() OVER (PARTITION BY block ORDER BY combination) - 1 AS path FROM f WHERE role = 'test')
SELECT path::INT AS path, count(*) AS rows, count(DISTINCT block) AS blocks, count(DISTINCT (month, ticker)) AS different, round(sum(x * y), 4) AS moment FROM t JOIN m USING (month, ticker) GROUP BY path""",
    "panel",
)
def ml_07_cpcv_paths(t: Tables):
    """Each path's blocks put together: every row of the panel once."""
    x = t.panel.withColumn("y", F.col("actual") - F.avg("actual").over(Window.partitionBy("month")))
    f = V.combinatorial_folds(x).where("role = 'test'")
    return f.groupBy("path").agg(F.count("*").alias("rows"), F.count_distinct("block").alias("blocks"), F.count_distinct("month", "ticker").alias("different"), F.round(F.sum(F.col("pred") / 100000 * F.col("y")), 4).alias("moment"))


def features(t: Tables):
    w = Window.partitionBy("ticker").orderBy("month")
    x = t.panel.withColumns({"pred": F.col("pred") / 100000, "sector_id": F.col("sector_id").cast("double")})
    return x.withColumns({"before": F.lag("actual").over(w), "own_mean": F.avg("pred").over(w.rowsBetween(-5, 0))})


FEATURES = ["pred", "before", "own_mean", "sector_id"]


@query(None)
def ml_09_cpcv_models(t: Tables):
    """A weighted boosted model for each combination; rank correlation and right signs along each path out of sample."""
    scores = V.path_scores(V.out_of_sample(features(t), FEATURES))
    return scores.select("path", "rows", "months", r6("ic"), r6("hit_rate"))


@query(None)
def ml_09_sector_models(t: Tables):
    """A weighted boosted model for each sector of a hundred rows or more, tested on its last fifth."""
    scores = V.group_scores(features(t), ["pred", "before", "own_mean"], "sector_id", least=100)
    return scores.select(F.col("sector_id").cast("long").alias("sector_id"), "rows", "months", r6("ic"), r6("hit_rate"))


@query(None)
def ml_10_pairwise_ranker(t: Tables):
    """Rankers on pairwise gradients, each tested on the year after its training, beside a weighted line."""
    x = V.training_rows(features(t)).withColumn("target_cs", F.col("actual"))
    found = K.walk_forward(x, ["pred", "before", "own_mean"], first=36, test=24, regress=lambda rows: V.weighted_line(rows, ["pred"]), rounds=3)
    return found.select("fold", "n_test", r6("ndcg"), r6("ic"), r6("spread"), r6("regression_ndcg"))


@query(None)
def scr_40_hidden_regimes(t: Tables):
    """Probabilities of three hidden regimes at each bar of each series."""
    blocks, params = M.fit(M.features(t.bars), dims=4, rounds=4)
    found = M.regimes(blocks, params, dims=4)
    name = F.element_at(F.array(*[F.lit(s) for s in M.STATES]), F.col("regime") + 1)
    parts = [F.round(F.col("probabilities")[k], 4).alias(f"p_{s.lower()}") for k, s in enumerate(M.STATES)]
    return found.select("ticker", "ts", *parts, name.alias("regime"), F.round("score", 4).alias("score"))
