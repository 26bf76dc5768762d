from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cryoframe.operators import crossings, rates, trend, yearblocks
from cryoframe.operators.blocks import harmonic_fit, line_fit, moment_sums, node_series, solve_sums
from cryoframe.operators.mass import mass_balance

P = rates.RateParams(radius=15_000.0, t_ref=2022.0)


def rate_cloud(n=3000, slope=-0.5, seed=0, accel=0.0, year_noise=0.0):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 5e4, n), rng.uniform(0, 5e4, n)
    yr = rng.integers(2019, 2026, n)
    t = yr + 0.6
    off = rng.normal(0, year_noise, 7)[yr - 2019] if year_noise else 0.0
    h = slope * (t - 2022) + 0.5 * accel * (t - 2022) ** 2 + 1e-4 * x + 5e-5 * y + rng.normal(0, 0.05, n) + off
    return pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "h": h, "t_year": t, "s_elv": 0.05})


@pytest.fixture(scope="module")
def node(spark):
    return spark.createDataFrame([(25_000.0, 25_000.0), (20_000.0, 30_000.0)], "node_x double, node_y double")


def test_rate_is_recovered_in_spite_of_spikes(spark, node):
    pdf = rate_cloud()
    pdf.loc[::97, "h"] += 30.0
    got = rates.node_rates(spark.createDataFrame(pdf), node, P).toPandas()
    assert len(got) == 2 and (abs(got["dhdt"] + 0.5) < 0.05).all() and (abs(got["accel"].fillna(0)) < 0.1).all()
    assert rates.node_rates(spark.createDataFrame(pdf.head(10)), node, P).count() == 0


def test_rounds_on_the_cluster_equal_the_kernel(spark, node):
    pdf = rate_cloud(2000, seed=4)
    pdf.loc[::53, "h"] += 12.0
    df = spark.createDataFrame(pdf).repartition(4)
    one = node.limit(1)
    a = rates.node_rates(df, one, P).drop("coef").toPandas().iloc[0]
    b = rates.node_rates(df, one, P, limit=50).drop("coef").toPandas().iloc[0]
    for c in ("p0", "dhdt", "accel", "p0_err", "dhdt_err", "rmse", "nobs", "tspan"):
        assert a[c] == pytest.approx(b[c], rel=1e-6, abs=1e-9), c


def test_series_from_sums_equals_numpy(spark, node):
    pdf = rate_cloud()
    df = spark.createDataFrame(pdf).withColumn("year", F.floor("t_year").cast("int"))
    from cryoframe.operators.spatial import radius_join

    s = node_series(radius_join(df, node, 15_000.0), radius=15_000.0).toPandas()
    r = s[(s.node_x == 25_000) & (s.year == 2021)].iloc[0]
    m = ((pdf.x - 25e3) ** 2 + (pdf.y - 25e3) ** 2 <= 15e3**2) & (np.floor(pdf.t_year) == 2021)
    a = np.c_[np.ones(m.sum()), pdf.x[m] - 25e3, pdf.y[m] - 25e3]
    coef, *_ = np.linalg.lstsq(a, pdf.h[m], rcond=None)
    e = pdf.h[m] - a @ coef
    assert r["h_node"] == pytest.approx(coef[0], abs=1e-8) and r["n_obs"] == m.sum()
    assert r["sigma"] == pytest.approx(np.sqrt(e @ e / (m.sum() - 3) * np.linalg.inv(a.T @ a)[0, 0]), rel=1e-6)
    rate = line_fit(spark.createDataFrame(s), ["node_x", "node_y"], "h_node", "year").toPandas()
    assert (abs(rate["slope"] + 0.5) < 0.05).all()


def test_sums_solve_equals_least_squares(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": 1, "a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["h"] = 2 + 3 * pdf.a - pdf.b + rng.normal(0, 0.1, 200)
    got = solve_sums(moment_sums(spark.createDataFrame(pdf), ["k"], {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}, F.col("h")), ["k"], ["one", "a", "b"]).first()
    want, rss, *_ = np.linalg.lstsq(np.c_[np.ones(200), pdf.a, pdf.b], pdf.h, rcond=None)
    assert np.allclose(got["coef"], want) and got["rss"] == pytest.approx(rss[0], rel=1e-8)


def pairs(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("node_x", F.lit(25_000.0)).withColumn("node_y", F.lit(25_000.0))


def test_jackknife_sees_year_offsets_that_the_formal_error_does_not(spark):
    out = []
    for noise in (0.0, 0.5):
        b = yearblocks.year_blocks(pairs(spark, rate_cloud(1400, year_noise=noise)), radius=15_000.0, t_ref=2022.0, basis=yearblocks.RATE_BASIS)
        out.append(yearblocks.jackknife(b, basis=yearblocks.RATE_BASIS).toPandas().iloc[0])
    assert out[1]["err_jackknife"] > 5 * out[0]["err_jackknife"]
    assert out[1]["err_formal"] < out[1]["err_jackknife"]
    few = rate_cloud(400)
    few = few[few.t_year < 2021]
    b = yearblocks.year_blocks(pairs(spark, few), radius=15_000.0, t_ref=2022.0, basis=yearblocks.RATE_BASIS)
    assert pd.isna(yearblocks.jackknife(b, basis=yearblocks.RATE_BASIS).toPandas()["err_jackknife"].iloc[0])


def test_acceleration_is_supported_only_when_it_is_there(spark):
    run = lambda pdf: yearblocks.assess_acceleration(pairs(spark, pdf), radius=15_000.0, t_ref=2022.0, ties=["id"]).toPandas().iloc[0]
    real = run(rate_cloud(1400, accel=0.3))
    assert real["accel_supported"] and real["accel"] == pytest.approx(0.3, abs=0.02)
    none = run(rate_cloud(1400, year_noise=0.4, seed=3))
    assert not none["accel_supported"] and pd.isna(none["accel"])
    short = rate_cloud(1400)
    assert "years" in run(short[short.t_year < 2022])["reason"]


def test_model_choice_refuses_what_cannot_be_identified(spark):
    b = yearblocks.year_blocks(pairs(spark, rate_cloud(1400)), radius=15_000.0, t_ref=2022.0)
    t = yearblocks.compare_models(b, candidates={**yearblocks.MODEL_CANDIDATES, **yearblocks.SEASONAL_CANDIDATES}).toPandas().set_index("model")
    assert t.loc["linear", "status"] == "ok" and t.loc["linear_seasonal", "status"] == "not_identifiable"
    assert t.loc["linear", "dhdt"] == pytest.approx(-0.5, abs=0.02)


def test_lag_one_across_slices(spark):
    rng = np.random.default_rng(11)
    r = np.cumsum(rng.normal(size=300)) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.linspace(2019, 2021, 300), "r": r}))
    got = yearblocks.lag_one(df, ["k"], "r", "t", slice_width=0.11).first()["ac1"]
    d = r - r.mean()
    assert got == pytest.approx((d[1:] * d[:-1]).sum() / (d * d).sum())


def test_seasonal_slope_is_exact_under_an_annual_cycle(spark):
    rows = [(1, y, m, float(-0.35 * y + 4 * np.cos(2 * np.pi * m / 12))) for y in range(2019, 2026) for m in range(1, 13)]
    s = spark.createDataFrame(rows, "k int, year int, month int, h_node double")
    got = trend.seasonal_mann_kendall_sen(s, ["k"]).first()
    assert got["sens_slope"] == pytest.approx(-0.35, abs=1e-8) and got["trend"] == "decreasing"
    with pytest.raises(ValueError):
        trend.trend_table(s, ["k"], variant="other")


def test_trend_table_separates_signal_from_noise(spark):
    rng = np.random.default_rng(12)
    rows = [(k, y, float((-0.4 * y if k < 10 else 0.0) + rng.normal(0, 0.05))) for k in range(40) for y in range(2019, 2026)]
    t = trend.trend_table(spark.createDataFrame(rows, "k int, year int, h_node double"), ["k"]).toPandas().set_index("k")
    assert t.loc[range(10), "significant"].all() and t.loc[range(10), "trend"].eq("decreasing").all()
    assert t.loc[range(10, 40), "significant"].mean() < 0.1


def test_crossing_rate_and_beams(spark):
    s = np.linspace(-5000, 5000, 200)
    rng = np.random.default_rng(13)
    j = rng.uniform(-20, 20, (2, 200))
    a = pd.DataFrame({"track_id": 1, "x": s + j[0], "y": s, "t_year": 2020.5 + np.arange(200) * 1e-8, "beam": 1, "h": 100.0})
    d = pd.DataFrame({"track_id": 2, "x": s + j[1], "y": -s, "t_year": 2024.5 + np.arange(200) * 1e-8, "beam": 4, "h": 100.0 - 2.4})
    got = crossings.find_crossings(spark.createDataFrame(pd.concat([a, d]))).toPandas()
    assert len(got) >= 1 and np.hypot(got["x"], got["y"]).max() < 200
    assert got["dhdt"].iloc[0] == pytest.approx(-0.6, abs=0.05) and got["dt"].iloc[0] == pytest.approx(4.0, abs=1e-4)
    assert (got["beam1"].iloc[0], got["beam2"].iloc[0]) == (1, 4)


def test_mass_identity(spark):
    g = spark.range(400).select(F.lit(-0.5).alias("pred"), F.lit(0.01).alias("var"))
    m = mass_balance(g, 5000.0, 34_100.0).first()
    assert m["dvdt_m3"] == pytest.approx(-0.5 * 400 * 25e6) and m["dmdt_gt"] == pytest.approx(917 * m["dvdt_m3"] / 1e12)
    assert m["sle_mm"] == pytest.approx(-m["dmdt_gt"] / 361.8)
    assert m["sigma_gt_correlated"] / m["sigma_gt_independent"] == pytest.approx(np.sqrt(np.pi * 34_100**2 / 25e6)) == pytest.approx(m["inflation"])


def test_harmonic_amplitude(spark):
    h = np.arange(0, 24 * 20, 0.5)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "hr": h, "y": 1 + 3 * np.sin(2 * np.pi / 12 * h + 0.4)}))
    got = harmonic_fit(df, ["k"], "y", "hr", [12.0]).first()
    assert got["amplitude"] == pytest.approx(3.0, abs=1e-6) and got["r2"] == pytest.approx(1.0, abs=1e-9)


def test_windows_and_hindcast(spark, node):
    assert rates.moving_windows(3.0, 1.0, 2019.2, 2025.9) == [(2019.0 + i, 2022.0 + i) for i in range(5)]
    assert rates.expanding_windows(2019.0, 3.0, 2023.4) == [(2019.0, 2022.0), (2019.0, 2023.0), (2019.0, 2024.0)]
    g = rates.hindcast(spark.createDataFrame(rate_cloud()), node, 2023.0, replace(P, time_order=1)).toPandas()
    assert (g["gain"] > 0.5).all()


def test_lag_one_is_dealt_to_more_tasks_without_a_second_shuffle(spark):
    """What a task sorts is bounded by ``parts``; the windows run on those partitions as they are."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 3, 900), "t": rng.uniform(0, 2, 900), "r": rng.normal(0, 1, 900)}))
    whole, dealt = (yearblocks.lag_one(rows, ["k"], "r", "t", parts=p) for p in (None, 37))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "_s" in plan and plan.count("37), REPARTITION_BY_NUM") == 1 and plan.count("hashpartitioning(k#") <= 2 + plan.count("Final Plan")
    a, b = (d.orderBy("k").toPandas() for d in (whole, dealt))
    assert a.n.tolist() == b.n.tolist() and np.allclose(a.ac1, b.ac1, atol=1e-12)


def test_years_of_a_sliver_are_predicted(spark):
    """Sums about the node lost what tells points of a sliver at its rim apart: left-out years were predicted by noise, or not at all."""
    r = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"x": r.uniform(-1e3, 1e3, n), "y": 14_900 + 10.0 * r.integers(0, 7, n), "t_year": 2018 + r.uniform(0, 5, n), "node_x": 0.0, "node_y": 0.0})
    pdf["h"] = 500 - 0.5 * (pdf.t_year - 2020) + 1e-4 * pdf.x + r.normal(0, 0.2, n)
    blocks = yearblocks.year_blocks(spark.createDataFrame(pdf), radius=15_000.0, t_ref=2020.0)
    got = yearblocks.compare_models(blocks, candidates={"linear": yearblocks.LINEAR}).first()
    u, v, year, miss = pdf.x / 1e3, (pdf.y - 14_930) / 30, np.floor(pdf.t_year), []
    a = np.c_[np.ones(n), pdf.t_year - 2020, u, v, u * v, u * u, v * v]
    for y in np.unique(year):
        out = year == y
        miss.append((pdf.h - a @ np.linalg.lstsq(a[~out], pdf.h[~out], rcond=None)[0])[out])
    assert np.isclose(got["oos_rmse"], np.sqrt(np.mean(np.concatenate(miss) ** 2)), rtol=1e-7)
