"""Fits of crowded nodes in passes over the points: exact medians, no rows of pairs."""

import numpy as np
import pandas as pd
import pytest

from cryoframe.operators import passes, rates
from cryoframe.operators.tilefit import View

RNG = np.random.default_rng(8)
P = rates.RateParams(radius=9_000.0, t_ref=2020.0, min_points=12, residual_limit=4.0)


def points(n=3000):
    x, y = RNG.uniform(-12_000, 12_000, (2, n))
    t = 2018 + RNG.uniform(0, 5, n)
    h = 100 - 0.7 * (t - 2020) + 1e-4 * x + np.round(RNG.normal(0, 0.2, n), 1) + np.where(RNG.random(n) < 0.05, 30, 0)
    return pd.DataFrame({"x": x, "y": y, "t_year": t, "h": h, "s_elv": RNG.uniform(0.05, 0.2, n), "region": RNG.choice(["a", "b"], n)})


def test_crowded_nodes_make_no_pairs(spark, monkeypatch):
    """Before, each pair of a point and a crowded node was a row, written again in each round."""
    df, nodes = spark.createDataFrame(points()), spark.createDataFrame([(a, b) for a in (-5e3, 0.0, 5e3) for b in (0.0, 4e3)], "node_x double, node_y double")
    views = [View({"half": 0}), View({"half": 1}, window=(2018.0, 2021.5))]
    want = rates.node_rates(df, nodes, P, by=["region"], views=views).toPandas()
    monkeypatch.setattr(rates, "radius_join", lambda *a, **k: pytest.fail("pairs as rows"))
    got = rates.node_rates(df, nodes, P, by=["region"], views=views, limit=20).toPandas()
    key = ["node_x", "node_y", "region", "half"]
    got, want = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) == 24
    pd.testing.assert_frame_equal(got.drop(columns=["coef", "cov"]), want.drop(columns=["coef", "cov"]), rtol=1e-8)


@pytest.mark.parametrize("values", [RNG.normal(0, 1, 5001), np.append(RNG.normal(0, 1e-3, 900), [1e6] * 99), np.round(RNG.normal(0, 1, 800), 1), np.append(np.zeros(60), RNG.normal(5, 1, 40))])
def test_brackets_hold_both_medians(values):
    n, median = len(values), np.median(values)
    mad = np.median(np.abs(values - median))
    low, high = -3.5 * np.std(values), 3.5 * np.std(values)
    b = passes.bin_of(values, low, high)
    counts = np.bincount(b + 1, minlength=passes.BINS + 2)
    found = passes.bracket(counts[0], counts[1:-1], n)
    if found is None:  # the range is shifted or widened by the caller
        return
    one, two = passes.wanted(b, found)
    middle = np.array([(n - 1) // 2, n // 2])
    assert passes._pick(values[one], np.ones(one.sum(), int), middle - found[4]) == median
    assert passes._pick(np.abs(values[two] - median), np.ones(two.sum(), int), middle - found[5]) == mad


def test_passes_read_runs_not_rows(spark, monkeypatch):
    """A pass gets a row a run: turning points into columns again in each pass took longer than the fits."""
    read = []
    real = passes._pass
    monkeypatch.setattr(passes, "_pass", lambda points, *a: read.append(points.count()) or real(points, *a))
    df = spark.range(4000).selectExpr("rand(1) * 20000 AS x", "rand(2) * 20000 AS y", "1995 + 5 * rand(3) AS t_year", "rand(4) AS h", "0.1D AS s_elv")
    nodes = spark.createDataFrame([(10_000.0, 10_000.0)], "node_x double, node_y double")
    q = rates.RateParams(t_ref=1997.0)
    slow = rates.node_rates(df, nodes, q, limit=10).collect()
    assert read and max(read) <= 2 * spark.sparkContext.defaultParallelism
    fast = rates.node_rates(df, nodes, q).collect()
    assert len(slow) == len(fast) == 1 and slow[0].nobs == fast[0].nobs
    np.testing.assert_allclose(slow[0].coef, fast[0].coef, rtol=1e-9)
