"""Factor regression against numpy, and name mapping."""

import numpy as np
import pandas as pd
import pytest

from tallyloom.plans.registry import screening


def test_factor_regression_agrees_with_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = []
    for ticker in ("a", "b"):
        f = rng.normal(0, 0.02, (200, 4))
        r = 0.001 + f @ np.array([1.1, -0.4, 0.3, 0.2]) + rng.normal(0, 0.01, 200)
        rows += [(ticker, float(x), *map(float, y)) for x, y in zip(r, f, strict=True)]
    rows += [("short", 0.1, 0.1, 0.2, 0.3, 0.4)] * 5 + [("a", None, 0.1, 0.1, 0.1, 0.1)]
    names = ["ticker", "r", *screening.FACTORS]
    got = {r["ticker"]: r for r in screening.factor_regression(spark.createDataFrame(rows, "ticker string, r double, market double, smb double, hml double, wml double")).collect()}
    assert set(got) == {"a", "b"}
    data = pd.DataFrame(rows, columns=names).dropna()
    for ticker in ("a", "b"):
        d = data[data.ticker == ticker]
        x = np.column_stack([np.ones(len(d)), d[screening.FACTORS]])
        beta, *_ = np.linalg.lstsq(x, d.r, rcond=None)
        left = d.r - x @ beta
        assert got[ticker]["alpha"] == pytest.approx(beta[0] * 252) and got[ticker]["n_obs"] == len(d)
        assert [got[ticker][f"{f}_beta"] for f in screening.FACTORS] == pytest.approx(list(beta[1:]))
        assert got[ticker]["r_squared"] == pytest.approx(1 - (left**2).sum() / ((d.r - d.r.mean()) ** 2).sum())
        assert got[ticker]["residual_vol"] == pytest.approx(float(np.std(left) * np.sqrt(252)))


def test_first_mapping_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `c d` int")
    out = screening.first_mapping(df, [("x", ["none", "a"]), ("y", ["a", "c d"]), ("z", ["a"])])
    assert out.columns == ["x", "y"] and tuple(out.first()) == (1, 3)
