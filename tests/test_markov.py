"""Hidden regimes against a plain loop over whole series."""

import datetime

import numpy as np
import pytest

from tallyloom.operators import markov as M

START = datetime.date(2020, 1, 1)
KINDS = "ticker string, ts date, x array<double>"


def planted(n, seed):
    rng = np.random.default_rng(seed)
    state, states, x = 0, [], []
    for _ in range(n):
        state = state if rng.random() < 0.95 else rng.integers(0, 3)
        states.append(state)
        x.append([rng.normal([-2, 0, 2][state], 0.6), rng.normal([1, 0, 1][state], 0.5)])
    return states, x


def plain(x, rounds, k=3):
    """Expectation and maximisation bar by bar over the whole series."""
    x = np.array(x)
    n, d = x.shape
    start, moves = np.full(k, 1 / k), np.full((k, k), 0.05) + np.eye(k) * 0.85
    means, covs = np.zeros((k, d)), np.array([np.eye(d)] * k)
    means[:, 0] = [-1, 0, 1]
    log = None
    for turn in range(rounds + 1):
        b = np.array([[np.exp(-0.5 * (v - means[s]) @ np.linalg.inv(covs[s]) @ (v - means[s])) / np.sqrt((2 * np.pi) ** d * np.linalg.det(covs[s])) for s in range(k)] for v in x])
        a, c, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
        for t in range(n):
            v = (start if t == 0 else a[t - 1] @ moves) * b[t]
            scale[t] = v.sum()
            a[t] = v / scale[t]
        for t in range(n - 2, -1, -1):
            c[t] = moves @ (b[t + 1] * c[t + 1]) / scale[t + 1]
        post = a * c
        if turn == rounds:
            return post / post.sum(axis=1, keepdims=True), means, log
        log = np.log(scale).sum()
        pairs = sum(a[t - 1][:, None] * moves * (b[t] * c[t]) / scale[t] for t in range(1, n))
        start, moves = post[0] / post[0].sum(), (pairs + 1e-12) / (pairs + 1e-12).sum(axis=1, keepdims=True)
        w = post.sum(axis=0)
        means = (post.T @ x) / w[:, None]
        covs = np.array([(post[:, s, None] * x).T @ x / w[s] - np.outer(means[s], means[s]) + 1e-3 * np.eye(d) for s in range(k)])


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_agree_with_a_plain_loop(spark, block):
    series = {"a": planted(60, 1), "b": planted(23, 2)}
    rows = [(t, START + datetime.timedelta(days=k), [float(v) for v in p]) for t, (_, x) in series.items() for k, p in enumerate(x)]
    blocks, params = M.fit(spark.createDataFrame(rows, KINDS).repartition(4), dims=2, rounds=2, block=block)
    got = {}
    for r in M.regimes(blocks, params, dims=2).orderBy("ts").collect():
        got.setdefault(r["ticker"], []).append(r)
    for t, (_, x) in series.items():
        post, means, _ = plain(x, 2)
        post = post[:, np.argsort(means[:, 0])]
        mine = np.array([r["probabilities"] for r in got[t]])
        assert np.allclose(mine, post, atol=1e-8)
        assert [r["regime"] for r in got[t]] == post.argmax(axis=1).tolist()
        assert np.allclose([r["score"] for r in got[t]], post @ [0, 0.5, 1])


def test_planted_regimes_are_found_and_likelihood_rises(spark):
    states, x = planted(600, 3)
    rows = [("a", START + datetime.timedelta(days=k), [float(v) for v in p]) for k, p in enumerate(x)]
    points = spark.createDataFrame(rows, KINDS)
    blocks, params = M.fit(points, dims=2, rounds=3, block=100)
    found = [r["regime"] for r in M.regimes(blocks, params, dims=2).orderBy("ts").collect()]
    assert np.mean(np.array(found) == states) > 0.95
    first = M.step(blocks, params, 3, 2).first()["loglik"]
    start = M.fit(points, dims=2, rounds=1, block=100)[1]
    assert first > M.step(blocks, start, 3, 2).first()["loglik"]
    assert M.latest(M.regimes(blocks, params, dims=2)).first()["ts"] == rows[-1][1]
    assert M.fit(points.limit(0), dims=2, rounds=1)[1].count() == 0
