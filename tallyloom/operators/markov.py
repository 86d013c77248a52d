"""Hidden Markov regimes of series: Gaussian states, fitted by expectation and maximisation in Spark.

Each series is cut into blocks of bars, packed a row a block.  What a block does to the probabilities of states is a
matrix (the product of its bars' steps), and products are associative: blocks multiply their bars side by side, a scan
over a series' block matrices (one row for some hundred bars) gives what comes before and after each block, and blocks
then work out posteriors from both ends, side by side again.  Sums of posteriors meet by series, so a round moves numbers
of states, never bars, and its parameters are written before the next one.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import series as S
from tallyloom.functions.stats import clip, ratio
from tallyloom.sources.shared import written

# tasks get this module's functions and classes by value, so executors need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATES = ("BEAR", "NEUTRAL", "BULL")
STAY, LEAST_COVARIANCE = 0.9, 1e-3
BLOCK = 256


def features(bars: DataFrame, trend: int = 200) -> DataFrame:
    """ticker, ts, x: 20-bar return, short over long volatility, distance from the long mean, volatility; winsorised at 1 % and 99 % and standardised by series.

    Bars without all of them are left out.
    """
    x = S.with_changes(bars)
    names = {"r20": S.returns("close", 20), "ratio": ratio(S.rolling_std("r", 5), S.rolling_std("r", 60)), "trend": ratio("close", S.sma("close", trend)) - 1, "vol": S.rolling_std("r", 20)}
    x = x.withColumns(names).select("ticker", "ts", *names).dropna()
    cut = x.groupBy("ticker").agg(*[F.percentile(n, F.array(F.lit(0.01), F.lit(0.99))).alias(f"cut_{n}") for n in names])
    x = x.join(cut, "ticker").select("ticker", "ts", *[clip(n, F.col(f"cut_{n}")[0], F.col(f"cut_{n}")[1]).alias(n) for n in names])
    size = x.groupBy("ticker").agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
    scaled = [F.coalesce(ratio(F.col(n) - F.col(f"mean_{n}"), f"std_{n}"), F.lit(0.0)) for n in names]
    return x.join(size, "ticker").select("ticker", "ts", F.array(*scaled).alias("x"))


def packed(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """ticker, block (from 0), ts and x as arrays in order of time."""
    x = points.withColumn("block", F.floor((F.row_number().over(S.ordered()) - 1) / block))
    rows = F.sort_array(F.collect_list(F.struct("ts", "x")))
    return x.groupBy("ticker", "block").agg(rows.alias("rows")).select("ticker", "block", F.col("rows.ts").alias("ts"), F.col("rows.x").alias("x"))


class Model:
    """Start, moves, means and covariances of the states as one flat list and back."""

    def __init__(self, flat, states: int, dims: int):
        flat, k, d = np.asarray(flat, float), states, dims
        parts = np.split(flat, np.cumsum([k, k * k, k * d]))
        self.start, self.moves, self.means, self.covariances = parts[0], parts[1].reshape(k, k), parts[2].reshape(k, d), parts[3].reshape(k, d, d)

    @staticmethod
    def first(states: int, dims: int) -> list[float]:
        """States apart in the first feature, of unit spread, that mostly stay."""
        k = states
        moves = np.full((k, k), (1 - STAY) / max(1, k - 1))
        np.fill_diagonal(moves, STAY if k > 1 else 1.0)
        means = np.zeros((k, dims))
        means[:, 0] = np.linspace(-1, 1, k) if k > 1 else 0.0
        return np.concatenate([np.full(k, 1 / k), moves.ravel(), means.ravel(), np.tile(np.eye(dims), (k, 1, 1)).ravel()]).tolist()

    def likelihoods(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each bar in each state, over the largest of the bar, and the logarithm of that."""
        out = np.empty((len(x), len(self.start)))
        for s, (mean, cov) in enumerate(zip(self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(cov)
            z = np.linalg.solve(root, (x - mean).T)
            out[:, s] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        top = out.max(axis=1)
        return np.exp(out - top[:, None]), top

    def product(self, b: np.ndarray, first: bool) -> np.ndarray:
        """What a block's bars do to the probabilities before it, up to a factor; a series' first bar moves nothing."""
        out = np.eye(len(self.start))
        for t, row in enumerate(b):
            out = (out if first and t == 0 else out @ self.moves) * row
            out = out / out.sum()
        return out

    def posteriors(self, b: np.ndarray, first: bool, before: np.ndarray, after: np.ndarray):
        """Probabilities of states at each bar, summed probabilities of moves into bars, and the logarithm of what the bars weigh."""
        n, k = b.shape
        forward, backward, weight = np.empty((n, k)), np.empty((n, k)), 0.0
        now = before
        for t in range(n):
            now = (now if first and t == 0 else now @ self.moves) * b[t]
            weight += np.log(now.sum())
            forward[t] = now = now / now.sum()
        now = after
        for t in range(n - 1, -1, -1):
            backward[t] = now = now / now.sum()
            now = self.moves @ (b[t] * now)
        state = forward * backward
        state /= state.sum(axis=1, keepdims=True)
        moves = np.zeros((k, k))
        for t in range(int(first), n):
            pair = (before if t == 0 else forward[t - 1])[:, None] * self.moves * (b[t] * backward[t])
            moves += pair / pair.sum()
        return state, moves, weight


def with_edges(blocks: DataFrame, params: DataFrame, states: int, dims: int) -> DataFrame:
    """blocks with their series' params and the probabilities before and after each block."""
    joined = blocks.join(params, "ticker")

    def products(frames):
        for df in frames:
            made = []
            for number, x, flat in zip(df["block"], df["x"], df["params"], strict=True):
                m = Model(flat, states, dims)
                made.append(m.product(m.likelihoods(np.stack(x))[0], number == 0).ravel().tolist())
            yield pd.DataFrame({"ticker": df["ticker"], "block": df["block"], "product": made, "start": [flat[:states] for flat in df["params"]]})

    def scan(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("block")
        matrices = [np.asarray(p).reshape(states, states) for p in df["product"]]
        before, after = [np.asarray(df["start"].iloc[0])], [np.ones(states)]
        for m in matrices[:-1]:
            v = before[-1] @ m
            before.append(v / v.sum())
        for m in reversed(matrices[1:]):
            v = m @ after[-1]
            after.append(v / v.sum())
        return pd.DataFrame({"ticker": df["ticker"], "block": df["block"], "before": [v.tolist() for v in before], "after": [v.tolist() for v in after[::-1]]})

    small = joined.select("ticker", "block", "x", "params").mapInPandas(products, "ticker string, block long, product array<double>, start array<double>")
    edges = small.groupBy("ticker").applyInPandas(scan, "ticker string, block long, before array<double>, after array<double>")  # a row a block
    return joined.join(edges, ["ticker", "block"])


def step(blocks: DataFrame, params: DataFrame, states: int, dims: int) -> DataFrame:
    """params after one more round, with loglik, the logarithm of the series' likelihood before it."""
    k, d = states, dims
    n = k + k + k * k + k * d + k * d * d + 1

    def sums(frames):
        for df in frames:
            made = []
            for number, x, flat, before, after in zip(df["block"], df["x"], df["params"], df["before"], df["after"], strict=True):
                m, x = Model(flat, k, d), np.stack(x)
                b, top = m.likelihoods(x)
                state, moves, weight = m.posteriors(b, number == 0, np.asarray(before), np.asarray(after))
                first = state[0] if number == 0 else np.zeros(k)
                made.append(np.concatenate([first, state.sum(axis=0), moves.ravel(), (state.T @ x).ravel(), np.einsum("ts,ti,tj->sij", state, x, x).ravel(), [weight + top.sum()]]))
            rows = np.array(made).reshape(-1, n)
            yield pd.DataFrame({"ticker": df["ticker"]} | {f"s{i}": rows[:, i] for i in range(n)})

    def renew(frames):
        for df in frames:
            made, logs = [], []
            for row in df[[f"s{i}" for i in range(n)]].to_numpy():
                first, weight, moves, x, xx = (p for p in np.split(row[:-1], np.cumsum([k, k, k * k, k * d])))
                weight = np.maximum(weight, 1e-12)
                moves = moves.reshape(k, k) + 1e-12
                means = x.reshape(k, d) / weight[:, None]
                spread = xx.reshape(k, d, d) / weight[:, None, None] - np.einsum("si,sj->sij", means, means) + LEAST_COVARIANCE * np.eye(d)
                made.append(np.concatenate([first / first.sum(), (moves / moves.sum(axis=1, keepdims=True)).ravel(), means.ravel(), spread.ravel()]).tolist())
                logs.append(row[-1])
            yield pd.DataFrame({"ticker": df["ticker"], "params": made, "loglik": logs})

    parts = with_edges(blocks, params, k, d).select("ticker", "block", "x", "params", "before", "after").mapInPandas(sums, "ticker string, " + ", ".join(f"s{i} double" for i in range(n)))
    total = parts.groupBy("ticker").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    return total.mapInPandas(renew, "ticker string, params array<double>, loglik double")


def fit(points: DataFrame, dims: int, states: int = 3, rounds: int = 10, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, params): packed points, and the parameters of each series after some rounds."""
    blocks = written(packed(points, block), "blocks")
    start = F.array(*[F.lit(float(v)) for v in Model.first(states, dims)])
    params = blocks.select("ticker").distinct().withColumn("params", start)
    for _ in range(rounds):
        params = written(step(blocks, params.select("ticker", "params"), states, dims), "states")
    return blocks, params.select("ticker", "params")


def regimes(blocks: DataFrame, params: DataFrame, dims: int, states: int = 3) -> DataFrame:
    """ticker, ts, probabilities (of the states by rising mean of the first feature), regime (the likeliest, from 0), score (0 to 1: the states' mean place)."""

    def decode(frames):
        for df in frames:
            for ticker, number, ts, x, flat, before, after in zip(*(df[c] for c in ("ticker", "block", "ts", "x", "params", "before", "after")), strict=True):
                m = Model(flat, states, dims)
                order = np.argsort(m.means[:, 0], kind="stable")
                state, _, _ = m.posteriors(m.likelihoods(np.stack(x))[0], number == 0, np.asarray(before), np.asarray(after))
                state = state[:, order]
                yield pd.DataFrame({"ticker": ticker, "ts": ts, "probabilities": state.tolist(), "regime": state.argmax(axis=1), "score": state @ np.arange(states) / max(1, states - 1)})

    rows = with_edges(blocks, params, states, dims).select("ticker", "block", "ts", "x", "params", "before", "after")
    return rows.mapInPandas(decode, "ticker string, ts date, probabilities array<double>, regime int, score double")


def latest(found: DataFrame) -> DataFrame:
    """Each series' newest regime."""
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc()))
    return found.withColumn("place", newest).where("place = 1").drop("place")
