"""Variograms from moments against all pairs."""

import numpy as np
import pandas as pd
import pytest

from cryoframe.operators import interpolate, variogram

RNG = np.random.default_rng(8)


def all_pairs(x, y, v, max_lag, n_lags):
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    i, j = np.triu_indices(len(x), 1)
    d, g = d[i, j], 0.5 * (v[i] - v[j]) ** 2
    lag = np.floor(d / (max_lag / n_lags)).astype(int)
    return {k: (int((lag == k).sum()), g[lag == k].mean()) for k in range(n_lags) if (lag == k).any()}


def scene(n):
    """A third of all points near one place, some of them on it."""
    x, y = RNG.uniform(-5e3, 4e4, (2, n))
    x[: n // 3], y[: n // 3] = RNG.normal(9e3, 400, (2, n // 3))
    x[: n // 9], y[: n // 9] = 9_000.0, 9_000.0
    x[-40:], y[-40:] = np.round(x[-40:], -3), np.round(y[-40:], -3)  # distances on the edge of a class
    return x, y, 1e4 + np.sin(x / 4e3) + RNG.normal(0, 0.3, n)


@pytest.mark.parametrize("places", [10**6, 150])
def test_same_as_all_pairs(spark, places):
    x, y, v = scene(900)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "v": v, "g": RNG.choice(["a", "b"], len(x))}))
    odd = spark.createDataFrame([(None, 1.0, 1.0, "a"), (1.0, 1.0, None, "a")], "x double, y double, v double, g string")
    rows = variogram.variogram_rows(df.unionByName(odd), "v", max_lag=10_000.0, n_lags=8, places=places).collect()
    want = all_pairs(x, y, v, 10_000.0, 8)
    assert {r.lag: r.n_pairs for r in rows} == {k: n for k, (n, _) in want.items()}
    assert all(abs(r.gamma - want[r.lag][1]) < 1e-8 for r in rows)
    pdf = df.toPandas()
    for g in "ab":
        p = pdf[pdf.g == g]
        want = all_pairs(*(p[c].to_numpy() for c in "xyv"), 10_000.0, 8)
        got = {r.lag: r for r in variogram.variogram_rows(df, "v", max_lag=10_000.0, n_lags=8, by=["g"], places=places).where(f"g = '{g}'").collect()}
        assert {k: (r.n_pairs, round(r.gamma, 7)) for k, r in got.items()} == {k: (n, round(m, 7)) for k, (n, m) in want.items()}


def test_few_places_meet_where_points_are_dense():
    x, y, v = scene(12_000)
    one = variogram.Quarters(x, y, np.stack([np.ones_like(v), v - 1e4, (v - 1e4) ** 2], 1), x.min(), y.min(), 5e4)
    count, half, met = variogram.lag_sums(one, one, 5_000.0, 4)
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    lag = np.floor(d / 5_000.0).astype(int)
    assert [int(c) for c in count] == [int((lag == k).sum()) for k in range(4)]
    g = 0.5 * (v[:, None] - v) ** 2
    assert np.allclose(half / count, [g[lag == k].mean() for k in range(4)], atol=1e-9)
    assert met < 0.1 * (lag < 4).sum()


def test_nothing(spark):
    df = spark.createDataFrame([], "i bigint, x double, y double, v double")
    assert interpolate.empirical_variogram(df, "v", ids=["i"], max_lag=10.0).count() == 0
    one = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 7.0), (3, 99.0, 0.0, 7.0)], df.schema)
    assert [(r.lag, r.n_pairs, r.gamma) for r in interpolate.empirical_variogram(one, "v", ids=["i"], max_lag=10.0).collect()] == [(0, 1, 2.0)]
