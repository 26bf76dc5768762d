"""Fits by tile against one neighbourhood at a time."""

import numpy as np
import pandas as pd
import pytest

from cryoframe.operators import interpolate, rates, tilefit
from cryoframe.operators.tilefit import View

P = rates.RateParams(radius=9_000.0, t_ref=2020.0, min_points=12, residual_limit=4.0)
RNG = np.random.default_rng(5)
N = 1500


def cloud():
    x, y = RNG.uniform(-30_000, 60_000, (2, N))
    x[: N // 3], y[: N // 3] = RNG.normal(20_000, 2_000, (2, N // 3))  # a third of all points in one place
    t = 2018 + RNG.uniform(0, 5, N)
    h = 100 - 0.7 * (t - 2020) + 1e-4 * x + RNG.normal(0, 0.2, N) + np.where(RNG.random(N) < 0.05, 30, 0)
    s = np.where(RNG.random(N) < 0.1, 0.0, RNG.uniform(0.05, 0.2, N))
    return pd.DataFrame({"x": x, "y": y, "t_year": t, "h": h, "s_elv": s, "fold": RNG.integers(0, 3, N), "region": RNG.choice(["a", "b"], N)})


def plain_fit(p, d, nx, ny):
    """The definition, with numpy's least squares."""
    d = d[(d.x - nx) ** 2 + (d.y - ny) ** 2 <= p.radius**2]
    t, h, s = (d[c].to_numpy(float) for c in ("t_year", "h", "s_elv"))
    if len(d) < p.min_points or np.ptp(t) < p.min_span:
        return None
    s = np.where(s > 0, s, np.median(s[s > 0]) if (s > 0).any() else 0.05)
    a = rates._design(p.terms, t - p.t_ref, (d.x.to_numpy() - nx) / p.radius, (d.y.to_numpy() - ny) / p.radius)
    w, on, fit, k = 1 / (s**2 + 1e-12), np.ones(len(d), bool), None, len(p.terms)
    for _ in range(p.rounds):
        if on.sum() < k + 2:
            break
        q = np.sqrt(w[on] * on.sum() / w[on].sum())[:, None]
        coef = np.linalg.lstsq(a[on] * q, h[on] * q[:, 0], rcond=None)[0]
        r = h[on] - a[on] @ coef
        cov = np.linalg.inv((a[on] * q).T @ (a[on] * q)) * (r @ r) / max(on.sum() - k, 1)
        fit = coef, cov, r.std()
        mad = 1.4826 * np.median(np.abs(r - np.median(r)))
        wild = np.abs(r) > min(p.n_sigma * mad, p.residual_limit)
        on[np.flatnonzero(on)[wild]] = False
        if not wild.any():
            break
    if fit is None or on.sum() < p.min_points or abs(fit[0][1]) > p.rate_limit:
        return None
    return fit[0], fit[1], fit[2], int(on.sum()), np.unique(np.floor(t[on])).size


def agree(got, want):
    assert set(got) == set(want) and len(want)
    for key, w in want.items():
        g = got[key]
        assert np.allclose(g.coef, w[0], rtol=1e-6, atol=1e-8) and np.allclose(np.reshape(g["cov"], w[1].shape), w[1], rtol=1e-5, atol=1e-10)
        assert g.nobs == w[3] and abs(g.rmse - w[2]) < 1e-9
        assert (g.accel is None or np.isnan(g.accel)) == (w[4] < P.min_years_accel or abs(w[0][2]) > P.accel_limit)
        assert abs(g.p0_err - w[1][0, 0] ** 0.5) < 1e-9


NODES = [(float(i), float(j)) for i in range(-36_000, 66_000, 12_000) for j in range(-36_000, 66_000, 12_000)] + [(20_000.5, 19_999.5)]


@pytest.mark.parametrize("tile_rows, limit", [(10**6, 10**6), (150, 10**6), (150, 700)])
def test_nodes(spark, tile_rows, limit):
    """Wide tiles, tiles cut up, and nodes fitted in rounds across the cluster."""
    d = cloud()
    df = spark.createDataFrame(d)
    nodes = spark.createDataFrame(NODES, "node_x double, node_y double")
    nodes = nodes.where(f"abs(node_x - 20000) < {30_000 if limit < 10**6 else 10**9}")
    got = {(r.node_x, r.node_y): r for _, r in rates.node_rates(df, nodes, P, tile_rows=tile_rows, limit=limit).toPandas().iterrows()}
    want = {n: f for n in NODES if (f := plain_fit(P, d, *n)) and (limit == 10**6 or abs(n[0] - 20_000) < 30_000)}
    agree(got, want)


def test_views_are_masks(spark):
    d = cloud()
    df, nodes = spark.createDataFrame(d), spark.createDataFrame(NODES, "node_x double, node_y double")
    ws = [(2018.0, 2021.5), (2019.0, 2023.0)]
    got = {(r.node_x, r.node_y, r.win_start): r for _, r in rates.window_rates(df, nodes, ws, P).toPandas().iterrows()}
    agree(got, {(*n, a): f for n in NODES for a, b in ws if (f := plain_fit(P, d[(d.t_year >= a) & (d.t_year < b)], *n))})
    views = [View({"fold": f}, left_out=f) for f in range(3)]
    got = {(r.node_x, r.node_y, r.fold, r.region): r for _, r in rates.node_rates(df, nodes, P, by=["region"], views=views, fold="fold").toPandas().iterrows()}
    agree(got, {(*n, f, g): x for n in NODES for f in range(3) for g in "ab" if (x := plain_fit(P, d[(d.fold != f) & (d.region == g)], *n))})
    waves = [View({"period": 0.5, "phase": 1}, wave=(0.5, 1))]
    got = {(r.node_x, r.node_y): r for _, r in rates.node_rates(df.drop("h"), nodes, P, views=waves).toPandas().iterrows()}
    agree(got, {n: f for n in NODES if (f := plain_fit(P, d.assign(h=np.sin(4 * np.pi * d.t_year)), *n))})


def test_points_are_sent_to_few_tiles(spark):
    d = spark.createDataFrame(cloud()).selectExpr("x AS _x", "y AS _y")
    spread, _ = tilefit._tiles_of(d, spark.createDataFrame(NODES, "node_x double, node_y double"), P.radius, ("node_x", "node_y"), 10**6)
    assert spread.count() < 3 * N


def test_nothing_to_fit(spark):
    df = spark.createDataFrame(cloud())
    far = spark.createDataFrame([(1e6, 1e6)], "node_x double, node_y double")
    assert rates.node_rates(df, far, P).count() == 0
    assert rates.node_rates(df.limit(0), far, P).count() == 0
    assert rates.node_rates(df, far.limit(0), P).count() == 0
    assert rates.window_rates(df, far, [], P).count() == 0
    odd = spark.createDataFrame([(0.0, 0.0, None, 1.0, 0.1), (0.0, 0.0, 2020.0, None, 0.1)], "x double, y double, t_year double, h double, s_elv double")
    assert rates.node_rates(odd, spark.createDataFrame([(0.0, 0.0)], "node_x double, node_y double"), P).count() == 0


def test_medians_of_segments():
    owner = np.repeat([0, 2, 5], [3, 4, 1])
    assert tilefit.medians(np.array([3.0, 1, 2, 9, 1, 5, 2, 7]), owner).tolist() == [2.0, 3.5, 7.0]


def test_long_segments_give_the_same_medians_and_years():
    rng = np.random.default_rng(5)
    owner = np.repeat([1, 4, 5], [3, 4000, 2001])
    values, year = rng.normal(size=len(owner)), rng.integers(1990, 2000, len(owner))
    for on in (np.ones(len(owner), bool), owner == 1):  # long segments and a short one
        groups = [owner[on] == g for g in np.unique(owner[on])]
        np.testing.assert_array_equal(tilefit.medians(values[on], owner[on]), [np.median(values[on][g]) for g in groups])
        for when in (year[on], year[on] * 10**12):  # numbers that no table of counts can hold, too
            np.testing.assert_array_equal(tilefit.distinct(when, owner[on]), [len(set(when[g])) for g in groups])
    assert len(tilefit.distinct(year[:0], owner[:0])) == 0


def test_tiles_are_dealt_to_tasks_of_their_own(spark):
    """Tiles look small by their bytes: without a number of their own, adaptive execution puts several into one task."""
    df = spark.range(2000).selectExpr("rand(1) * 100000 AS x", "rand(2) * 100000 AS y", "1995 + 5 * rand(3) AS t_year", "rand(4) AS h", "0.1D AS s_elv")
    nodes = spark.range(9).selectExpr("(id % 3) * 40000D + 10000 AS node_x", "floor(id / 3) * 40000D + 10000 AS node_y")
    fits = rates.node_rates(df, nodes, rates.RateParams(t_ref=1997.0))
    assert fits.count() == 9
    assert fits.rdd.getNumPartitions() >= tilefit.TASKS * spark.sparkContext.defaultParallelism


def test_fits_of_a_validation_are_worked_out_once(spark, monkeypatch):
    """The nearest-node join reads the fits of the folds more than once; they are written before."""
    seen = spark.sparkContext.accumulator(0)
    fits = spark.range(6).selectExpr("cast(id % 2 as int) AS fold", "id * 1000D AS node_x", "0D AS node_y", "1D AS p0", "0.5D AS dhdt", "0.1D AS dhdt_err", "0.1D AS p0_err")

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(rates, "node_rates", lambda *a, **k: fits.mapInArrow(counted, fits.schema))
    df = spark.range(40).selectExpr("id", "id * 150D AS x", "10D AS y", "2D AS h", "1998.5D AS t_year", "0.1D AS s_elv", "cast(id % 2 as int) AS fold")
    r = interpolate.observation_validation(df, None, rates.RateParams(t_ref=1998.5), n_folds=2, max_distance=10_000.0, ids=["id"])
    assert [x.resid for x in r.collect()] == [1.0] * 40
    assert seen.value == 6


@pytest.mark.parametrize("limit", [rates.NODE_LIMIT, 20])
def test_a_node_that_sees_a_sliver_is_fitted(spark, limit):
    """Terms about the node told points of a sliver at the far side apart in their last digits: such nodes were dropped, or fitted by noise."""
    r = np.random.default_rng(3)
    n, p = 400, rates.RateParams(radius=15_000.0, t_ref=2020.0, weighted=False, n_sigma=50.0, rate_limit=1e9)
    x, y, t = r.uniform(-1_000, 1_000, n), 14_900 + 10.0 * r.integers(0, 7, n), 2018 + r.uniform(0, 5, n)
    h = 500 - 0.5 * (t - 2020) + 1e-4 * x + r.normal(0, 0.2, n)
    df = pd.DataFrame({"x": x, "y": y, "t_year": t, "h": h, "s_elv": 0.1})
    got = rates.node_rates(spark.createDataFrame(df), spark.createDataFrame([(0.0, 0.0)], "node_x double, node_y double"), p, limit=limit).toPandas()
    assert len(got) == 1
    # The definition, about the middle of the points; the height and the rate at the node follow by going there.
    a = rates._design(p.terms, t - 2020, x / 1e3, (y - 14_930) / 30)
    coef = np.linalg.lstsq(a, h, rcond=None)[0]
    at_node = rates._design(p.terms, np.zeros(1), np.zeros(1), np.array([-14_930 / 30]))[0]
    cov = np.linalg.inv(a.T @ a) * ((h - a @ coef) ** 2).sum() / (n - len(coef))
    assert np.isclose(got.p0[0], at_node @ coef, rtol=1e-7) and np.isclose(got.dhdt[0], coef[1], rtol=1e-7)
    assert np.isclose(got.p0_err[0], np.sqrt(at_node @ cov @ at_node), rtol=1e-6) and np.isclose(got.dhdt_err[0], cov[1, 1] ** 0.5, rtol=1e-6)
