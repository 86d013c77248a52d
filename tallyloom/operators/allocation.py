"""Portfolio weights and simulations.  Covariances are summed in Spark; only the N x N matrix of one portfolio reaches a task."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import clip, ratio

# tasks get this module's functions by value, so executors need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOW, HIGH = 0.01, 0.25


def covariances(changes: DataFrame) -> DataFrame:
    """portfolio, a, b, cov, mean_a: a row for each ordered pair of tickers of a portfolio."""
    r = changes.where("r is not null").select("portfolio", "ticker", "ts", "r")
    a, b = r.toDF("portfolio", "a", "ts", "ra"), r.toDF("portfolio", "b", "ts", "rb")
    return a.join(b, ["portfolio", "ts"]).groupBy("portfolio", "a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.avg("ra").alias("mean_a"))


def project(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """Nearest weights that sum to one within bounds: the shift is found by bisection."""
    low, high = min(low, 1 / len(w)), max(high, 1 / len(w))
    a, b = (w - high).min() - 1, (w - low).max() + 1
    for _ in range(80):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(w - m, low, high).sum() > 1 else (a, m)
    return np.clip(w - (a + b) / 2, low, high)


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Weights of largest mu w - aversion / 2 w cov w within bounds, by projected gradient steps."""
    w = project(np.full(len(mu), 1 / len(mu)), low, high)
    step = 1 / (aversion * max(np.linalg.norm(cov, 2), 1e-12))
    for _ in range(2000):
        new = project(w + step * (mu - aversion * cov @ w), low, high)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Risk parity over a tree: order by average-link clusters of correlation distance, then split weight by inverse variance."""
    n = len(cov)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    distance = np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, 1))
    clusters = [[k] for k in range(n)]
    while len(clusters) > 1:
        pairs = [(distance[np.ix_(clusters[i], clusters[j])].mean(), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))]
        _, i, j = min(pairs)
        clusters[i] = clusters[i] + clusters.pop(j)
    weights, work = np.ones(n), [clusters[0]]
    while work:
        part = work.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]

        def risk(items):
            inverse = 1 / np.diag(cov)[items]
            inverse = inverse / inverse.sum()
            return inverse @ cov[np.ix_(items, items)] @ inverse

        a, b = risk(left), risk(right)
        share = 1 - a / (a + b)
        weights[left] *= share
        weights[right] *= 1 - share
        work += [left, right]
    return weights / weights.sum()


def black_litterman(cov: np.ndarray, market: np.ndarray, views: np.ndarray, confidence: float, delta: float = 2.5, tau: float = 0.05) -> np.ndarray:
    """Posterior weights: equilibrium returns blended with one view for each asset, clipped and normalised."""
    prior = delta * cov @ market
    omega = np.diag(tau / max(confidence, 0.05) * (np.abs(views) + 0.01))
    a, b = np.linalg.pinv(tau * cov), np.linalg.pinv(omega)
    mean = np.linalg.pinv(a + b) @ (a @ prior + b @ views)
    w = np.clip(np.linalg.pinv(delta * cov) @ mean, 0, None)
    return w / w.sum() if w.sum() > 0 else market


def weights(cov: DataFrame, method: str) -> DataFrame:
    """portfolio, ticker, weight; method: mean_variance, min_variance, hierarchical or black_litterman."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["a"].unique())
        c = pdf.pivot(index="a", columns="b", values="cov").reindex(index=names, columns=names).fillna(0.0).to_numpy() + 1e-9 * np.eye(len(names))
        mu = pdf.drop_duplicates("a").set_index("a")["mean_a"].reindex(names).to_numpy()
        if method == "hierarchical":
            w = hierarchical(c)
        elif method == "black_litterman":
            w = black_litterman(c, np.full(len(names), 1 / len(names)), np.clip(0.02 * (mu - mu.mean()) / (mu.std() or 1), -0.05, 0.05), 0.1)
        else:
            w = mean_variance(mu if method == "mean_variance" else np.zeros(len(names)), c, 1.0)
        return pd.DataFrame({"portfolio": pdf["portfolio"].iloc[0], "ticker": names, "weight": w})

    return cov.groupBy("portfolio").applyInPandas(solve, "portfolio string, ticker string, weight double")


def normal_draw(*parts: Column) -> Column:
    """A standard normal number from hashes of the parts: the same in every run, however the rows are dealt."""
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))


def monte_carlo(params: DataFrame, n_sims: int, n_days: int, seed: int = 7) -> DataFrame:
    """Quantiles by day of geometric Brownian paths; params: ticker, drift, volatility (daily)."""
    spark = params.sparkSession
    sims = params.crossJoin(spark.range(n_sims).withColumnRenamed("id", "sim"))
    steps = sims.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(n_days))))
    z = normal_draw(F.lit(seed), F.col("ticker"), F.col("sim"), F.col("day"))
    w = Window.partitionBy("ticker", "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    paths = steps.withColumn("step", F.col("drift") - F.col("volatility") ** 2 / 2 + F.col("volatility") * z).withColumn("value", F.exp(F.sum("step").over(w)))
    fan = paths.groupBy("ticker", "day").agg(F.percentile("value", F.array(*[F.lit(p) for p in (0.05, 0.5, 0.95)])).alias("q"), F.avg((F.col("value") < 1).cast("double")).alias("p_loss"))
    return fan.select("ticker", "day", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "p_loss")


def clip_weights(df: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Weights held to bounds, then scaled to sum to one within their portfolio."""
    held = df.withColumn("weight", clip("weight", low, high))
    return held.withColumn("weight", ratio("weight", F.sum("weight").over(Window.partitionBy("portfolio"))))
