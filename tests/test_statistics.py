import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cryoframe.operators import ranks, robust, skew, tracks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and many ties."""
    rng = np.random.default_rng(1)
    g = rng.choice([0, 0, 0, 0, 1, 2], 6000)
    v = np.where(rng.uniform(size=6000) < 0.3, 7.0, np.round(rng.normal(0, 50, 6000), 1))
    return pd.DataFrame({"g": g, "v": v}), spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(4)


@pytest.mark.parametrize("limit", [10**9, 1500, 0])
def test_quantiles_are_exact_whatever_the_limit(skewed, limit):
    pdf, df = skewed
    got = skew.group_quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}, limit=limit).toPandas().set_index("g").sort_index()
    for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.99)):
        want = pdf.groupby("g")["v"].quantile(p)
        assert np.allclose(got[name], want)
    assert (got["n"] == pdf.groupby("g").size()).all()


@pytest.mark.parametrize("limit", [10**9, 1500])
def test_median_and_mad_agree_for_large_groups(skewed, limit):
    pdf, df = skewed
    got = skew.group_median_mad(df, ["g"], "v", limit=limit).toPandas().set_index("g").sort_index()
    mad = pdf.groupby("g")["v"].apply(lambda s: 1.4826 * (s - s.median()).abs().median())
    assert np.allclose(got["med"], pdf.groupby("g")["v"].median()) and np.allclose(got["mad"], mad)
    rows = skew.attach_median_mad(df, ["g"], "v", limit=limit).groupBy("g").agg(F.max("mad").alias("mad"), F.count("*").alias("k"), F.max("n").alias("n")).toPandas()
    assert np.allclose(rows.set_index("g").sort_index()["mad"], mad) and (rows["k"] == rows["n"]).all()


def test_average_ranks_and_fdr(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.uniform(0, 1, 400) ** 3, 2)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": -v}))
    got = ranks.with_average_rank(df, "v", "r").toPandas()
    assert (got["r"] == got["v"].rank()).all()
    assert ranks.spearman(df, "v", "w").first()["spearman_r"] == pytest.approx(-1.0)
    adj = ranks.fdr(df, "v").toPandas().sort_values("v")
    x = np.sort(v)
    want = np.minimum.accumulate((x * x.size / np.arange(1, x.size + 1))[::-1])[::-1]
    assert np.allclose(adj["p_fdr"].to_numpy(), np.minimum(want, 1.0))
    assert ranks.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)


def test_kendall_exact_table_against_enumeration():
    from itertools import combinations, permutations

    inv = [sum(p[i] > p[j] for i, j in combinations(range(5), 2)) for p in permutations(range(5))]
    table = {d: p for n, d, p in ranks.kendall_exact_table(5) if n == 5}
    for d in range(5):
        assert table[d] == pytest.approx(min(1.0, 2 * np.mean([i <= d for i in inv])))


def test_space_time_filter_keeps_clean_rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    h = rng.normal(0, 0.05, n)
    h[:20] = 15.0
    df = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(0, 2e4, n), "y": rng.uniform(0, 2e4, n), "t_year": 2019.1 + rng.integers(0, 4, n), "h": h, "i": np.arange(n)}))
    p = dict(height="h", cell_m=5000.0, dt_years=1.0, n_sigma=5.0, mad_floor=0.1)
    kept = robust.filter_space_time(df, min_count=20, **p).toPandas()
    assert kept["h"].max() < 5 and len(kept) >= 0.98 * (n - 20)
    hot = robust.filter_space_time(df, min_count=20, limit=50, **p).toPandas()
    assert set(hot["i"]) == set(kept["i"])
    assert robust.filter_space_time(df, min_count=1000, **p).count() == n


def track(spark, n=400, gap_at=None, spike=None):
    t = 2020.0 + np.arange(n) * 1e-8
    if gap_at:
        t[gap_at:] += 1e-3
    h = np.sin(np.arange(n) / 40.0)
    if spike is not None:
        h[spike] += 25.0
    return pd.DataFrame({"beam": 1, "t_year": t, "h": h, "i": np.arange(n)})


def test_tracks_split_on_beam_and_gap_across_slices(spark):
    a = track(spark, 300, gap_at=100)
    b = track(spark, 200)
    b["beam"] = 2
    df = spark.createDataFrame(pd.concat([a, b])).repartition(4)
    got = tracks.track_ids(df, 1e-4, slice_width=3e-7).toPandas().sort_values(["beam", "t_year"])
    assert got["track_id"].tolist() == [0] * 100 + [1] * 200 + [2] * 200
    assert got["pos"].tolist() == list(range(300)) + list(range(200))


@pytest.mark.parametrize("chunk", [37, 100_000])
def test_spike_is_removed_and_edges_are_exempt(spark, chunk):
    ids = tracks.track_ids(spark.createDataFrame(track(spark, spike=200)), 1e-4)
    out = tracks.along_track_flags(ids, height="h", chunk_rows=chunk).toPandas()
    assert len(out) == 400 and out.set_index("i").loc[200, "bad"] and out["bad"].sum() <= 5
    edge = tracks.along_track_flags(tracks.track_ids(spark.createDataFrame(track(spark, spike=3)), 1e-4), height="h", chunk_rows=chunk).toPandas()
    assert not edge.set_index("i").loc[3, "bad"]


def test_block_folds_are_whole_and_do_not_leak(spark):
    from cryoframe.operators.interpolate import fold_views

    df = spark.range(2000).select(F.col("id"), (F.col("id") % 40).alias("block"))
    f = ranks.block_folds(df, 5, ["block"])
    assert f.groupBy("block").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1
    train, test = fold_views(f, 5)
    assert train.count() == 4 * 2000
    ranks.assert_no_leak(train, test, ["id", "fold"])
    with pytest.raises(AssertionError):
        ranks.assert_no_leak(test, test, ["id", "fold"])


def test_rolling_filters_of_all_settings_come_from_one_pass(spark):
    """Before, each setting shuffled all rows again, and each frame was an array of a Spark window."""
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"track_id": np.repeat([1, 2, 3], [150, 4, 60]), "beam": 1})
    df["pos"] = df.groupby("track_id").cumcount()
    df["h"] = rng.normal(size=len(df)) + 20 * (rng.random(len(df)) < 0.05)
    rows, settings = spark.createDataFrame(df), [(21, 5), (11, 3)]
    got = tracks.along_track_flags(rows, height="h", chunk_rows=40, settings=settings).toPandas().sort_values(["track_id", "pos"])
    for k, (w, f) in enumerate(settings):
        half, wide = w // 2 + (1 - w % 2), (w * f + 1 - w * f % 2) // 2
        h = df.groupby("track_id").h
        resid = df.h - h.transform(lambda x: x.rolling(2 * half + 1, center=True, min_periods=1).median())  # noqa: B023
        mad = (1.4826 * resid.abs().groupby(df.track_id).transform(lambda x: x.rolling(2 * wide + 1, center=True, min_periods=1).median())).clip(lower=0.1)  # noqa: B023
        n = h.transform("size")
        want = (df.pos >= half) & (n - 1 - df.pos >= half) & (resid.abs() > 5 * mad)
        assert want.any() and got[f"bad{k}"].tolist() == want.tolist()


def test_only_the_slice_of_a_median_moves(spark):
    """Before, all values of a large group were shuffled to find its median."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.sin(F.col("id") * 1.7).alias("v"))
    plan = skew._sliced_quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi") and "strategy=broadcast" in plan[plan.index("LeftSemi") :].split("\n")[0]
    moved = plan[: plan.index("LeftSemi")]
    assert moved.count("Aggregate [") == 2  # of the medians, and of the few rows that are left by then
