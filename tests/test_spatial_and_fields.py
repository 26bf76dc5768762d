import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cryoframe.operators import flow, fronts, grids, interpolate, spatial
from cryoframe.sources import fields


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"id": np.arange(800), "x": rng.uniform(-5e3, 5e3, 800), "y": rng.uniform(-5e3, 5e3, 800)})
    dense = pd.DataFrame({"id": np.arange(800, 1400), "x": rng.uniform(0, 50, 600), "y": rng.uniform(0, 50, 600)})
    return pd.concat([p, dense], ignore_index=True)


def test_radius_join_matches_brute_force(spark, cloud):
    nodes = pd.DataFrame({"node_x": [0.0, 3000.0, -4000.0], "node_y": [0.0, -2500.0, 4900.0]})
    got = spatial.radius_join(spark.createDataFrame(cloud), spark.createDataFrame(nodes), 1500.0).groupBy("node_x").count().toPandas().set_index("node_x")["count"]
    for nx, ny in nodes.to_numpy():
        assert got[nx] == ((cloud.x - nx) ** 2 + (cloud.y - ny) ** 2 <= 1500**2).sum()


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_knn_is_complete_in_dense_and_sparse_places(spark, cloud, k):
    targets = pd.DataFrame({"t": range(4), "x": [10.0, 60.0, 4900.0, -30_000.0], "y": [10.0, -70.0, 4900.0, 20_000.0]})
    src = spark.createDataFrame(cloud.rename(columns={"x": "sx", "y": "sy"}))
    got = spatial.knn_join(spark.createDataFrame(targets), src, k, target_id=["t"], source_id=["id"], base=40.0).toPandas()
    for t, x, y in targets.itertuples(index=False):
        d = np.sort((cloud.x - x) ** 2 + (cloud.y - y) ** 2)[: min(k, 1400)]
        assert np.allclose(np.sort(got[got.t == t]["d2"]), d)


def test_outside_buffer_matches_brute_force(spark, cloud):
    a, b = cloud[cloud.id % 3 > 0], cloud[cloud.id % 3 == 0]
    got = set(spatial.outside_buffer(spark.createDataFrame(a), spark.createDataFrame(b), 300.0).toPandas()["id"])
    d2 = (a.x.to_numpy()[:, None] - b.x.to_numpy()) ** 2 + (a.y.to_numpy()[:, None] - b.y.to_numpy()) ** 2
    assert got == set(a.id[(d2 >= 300.0**2).all(axis=1)])


def test_tiles_partition_the_points(spark):
    g = np.linspace(500, 99_500, 40)
    df = spark.createDataFrame(pd.DataFrame([(x, y) for x in g for y in g], columns=["x", "y"]))
    m = spatial.tile_manifest(spatial.halo_tiles(df, 50_000, 15_000), 50_000).toPandas()
    assert len(m) == 4 and m["n_core"].sum() == 1600 and m["n_with_halo"].sum() > 1600


def test_nearest_epoch_tie_takes_the_earlier(spark):
    rows = spark.createDataFrame([("a", 2020.5), ("a", 2020.6), ("a", 2015.0)], "shelf string, t double")
    ep = spark.createDataFrame([("a", 2020.0), ("a", 2021.0)], "shelf string, epoch double")
    got = spatial.nearest_epoch(rows, ep, time="t", epoch="epoch", by=["shelf"], max_gap=1.0).toPandas().set_index("t")
    assert got.loc[2020.5, "epoch"] == 2020.0 and got.loc[2020.6, "epoch"] == 2021.0 and not got.loc[2015.0, "epoch_valid"]


def test_bilinear_is_exact_on_a_plane_and_cyclic(spark):
    f = spark.createDataFrame([(i, j, 2.0 * i + 3.0 * j) for i in range(6) for j in range(6)], "cell_i int, cell_j int, z double")
    p = spark.createDataFrame([(1, 12.5, 27.5), (2, 999.0, 0.0)], "id int, x double, y double")
    got = spatial.sample_bilinear(p, f, ids=["id"], origin=(0.0, 0.0), step=10.0, value="z").toPandas().set_index("id")
    assert got.loc[1, "z"] == pytest.approx(2 * 1.25 + 3 * 2.75) and pd.isna(got.loc[2, "z"])
    w = spark.createDataFrame([(i, 0, float(i)) for i in range(36)], "cell_i int, cell_j int, z double")
    q = spark.createDataFrame([(1, 355.0, 95.0)], "id int, x double, y double")
    assert spatial.sample_bilinear(q, w, ids=["id"], origin=(0.0, 0.0), step=10.0, value="z", wrap_i=36, clamp_j=(0, 0)).first()["z"] == pytest.approx(17.5)


def field(spark, n=12):
    return spark.createDataFrame([(i, j, 100.0, 0.01 * i * 1000.0, 5.0) for i in range(n) for j in range(n)], "cell_i int, cell_j int, H double, vx double, vy double")


def test_flux_divergence_of_linear_velocity(spark):
    d = grids.flux_divergence(field(spark), 1000.0, min_thickness=10.0).toPandas()
    assert np.allclose(d["divergence"], 100.0 * 0.01)
    s = grids.smooth(field(spark).select("cell_i", "cell_j", "H"), ["H"], 2.0).toPandas()
    assert np.allclose(s["H"], 100.0)


def test_distance_to_class(spark):
    f = spark.createDataFrame([(i, j, 2 if i < 4 else 0) for i in range(10) for j in range(10)], "cell_i int, cell_j int, mask_class int")
    d = grids.distance_to_class(f, F.col("mask_class") == 2, 500.0).toPandas()
    assert np.allclose(d["distance"], np.maximum(d["cell_i"] - 3, 0) * 500.0)


def test_densify_and_front_classifier_fail_closed(spark):
    lines = spark.createDataFrame([("a", 2020.0, "LINESTRING (0 0, 10000 0)"), ("a", 2021.0, "not a line"), ("b", 2020.0, "MULTILINESTRING ((0 90000, 700 90000),(0 95000, 0 95900))")], "shelf string, epoch double, wkt string")
    v = fronts.densify(lines, ["shelf", "epoch"], 500.0)
    a = v.where("shelf = 'a'").orderBy("k").toPandas()
    assert len(a) == 21 and np.allclose(np.diff(a["x"]), 500.0)
    assert v.where("shelf = 'b'").count() == 3 + 3
    pts = spark.createDataFrame([(1, 5000.0, 500.0, 2020.1, 900.0), (2, 5000.0, 500.0, 2020.1, 1100.0), (3, 5000.0, 500.0, 2023.0, 900.0), (4, 5e6, 5e6, 2020.1, 1.0)], "id int, x double, y double, t_year double, dg double")
    r = fronts.classify_front(pts, v.withColumn("df", F.lit(1000.0)), ids=["id"], distance="dg", front_distance="df", max_search=2000.0).toPandas().set_index("id")
    assert r["inside"].tolist() == [True, False, False, False]
    assert r.loc[1, "margin"] == pytest.approx(100.0) and not r.loc[3, "epoch_valid"] and not r.loc[4, "assigned"]


def test_state_never_interpolates_a_missing_year(spark):
    z = spark.createDataFrame([(1, 1, 2020, 1000.0, 10.0, 2)], "cell_i int, cell_j int, year int, radius double, distance double, support int")
    p = spark.createDataFrame([(1, 1, 2020, 3), (1, 1, 2021, 3), (2, 2, 2020, 3), (2, 2, 2020, 2)], "cell_i int, cell_j int, year int, mask_class int")
    got = fronts.classify_state(p, z).select("cell_i", "year", "mask_class", "state", "support").toPandas()
    key = {(a, b, c): (s, u) for a, b, c, s, u in got.itertuples(index=False)}
    assert key == {(1, 2020, 3): (2, 2), (1, 2021, 3): (0, 4), (2, 2020, 3): (3, 1), (2, 2020, 2): (1, 1)}


def test_trajectories_are_exact_at_any_tiling(spark):
    f = spark.createDataFrame([(i, j, 1000.0 + 10.0 * i, -500.0) for i in range(40) for j in range(40)], "cell_i int, cell_j int, vx double, vy double")
    p = spark.createDataFrame([(1, 10_000.0, 20_000.0), (2, 38_900.0, 20_000.0)], "id int, x double, y double")
    args = dict(ids=["id"], origin=(0.0, 0.0), step=1000.0)
    a = flow.trajectories(p, f, [2019.9, 2020.2], 2020.0, **args).toPandas().sort_values(["id", "epoch"]).reset_index(drop=True)
    assert a.loc[1, "py"] == pytest.approx(20_000 - 100)
    # dx/dt = 1000 + x/100 has the exact solution below.
    assert a.loc[1, "px"] == pytest.approx((10_000 + 1e5) * np.exp(0.2 / 100) - 1e5, abs=1e-6)
    assert not a[(a.id == 2) & (a.epoch == 2020.2)]["valid"].item()
    b = flow.trajectories(p, f, [2019.9, 2020.2], 2020.0, tile_cells=3, reach_cells=1, parts=2, **args).toPandas().sort_values(["id", "epoch"]).reset_index(drop=True)
    assert np.allclose(a[a.valid]["px"], b[b.valid]["px"], atol=1e-4) and a["valid"].tolist() == b["valid"].tolist()
    with pytest.raises(ValueError):
        flow.trajectories(p, f.limit(0), [2021.0], 2020.0, **args)


def test_trajectories_in_a_field_that_changes(spark):
    """Speed grows linearly between two epochs and is held outside: the distance is the integral."""
    f = spark.createDataFrame([(i, j, e, v, 0.0) for i in range(60) for j in range(3) for e, v in ((2020.0, 1000.0), (2022.0, 3000.0))], "cell_i int, cell_j int, epoch double, vx double, vy double")
    p = spark.createDataFrame([(1, 20_000.0, 1000.0)], "id int, x double, y double")
    got = flow.trajectories(p, f, [2019.0, 2021.0, 2023.0], 2020.0, ids=["id"], origin=(0.0, 0.0), step=1000.0).toPandas().set_index("epoch")["px"]
    assert got[2019.0] == pytest.approx(19_000.0) and got[2021.0] == pytest.approx(21_500.0, abs=1.0) and got[2023.0] == pytest.approx(27_000.0, abs=1.0)


def test_predictors_recover_a_smooth_field(spark):
    rng = np.random.default_rng(7)
    n = pd.DataFrame({"i": np.arange(300), "x": rng.uniform(0, 1e5, 300), "y": rng.uniform(0, 1e5, 300)})
    n["v"] = np.sin(n.x / 3e4) + np.cos(n.y / 4e4)
    n["s"] = 0.01
    nodes = spark.createDataFrame(n)
    fit = interpolate.fit_variogram(nodes, "v", ids=["i"], max_lag=60_000.0)
    assert fit["range_m"] > 0 and fit["sill"] > 0
    t = n.iloc[:40].rename(columns={"i": "t"})[["t", "x", "y", "v"]].assign(x=lambda d: d.x + 700.0)
    t["v"] = np.sin(t.x / 3e4) + np.cos(t.y / 4e4)
    near = interpolate.neighbours_of(spark.createDataFrame(t[["t", "x", "y"]]), nodes, "v", target_id=["t"], source_id=["i"], k=16, sigma="s")
    for name, fn in interpolate.PREDICTORS.items():
        got = fn(near, ["t"], "v", variogram=fit, sigma_col="s", radius=9000.0, sigma=6000.0).toPandas().merge(t, on="t")
        assert np.sqrt(((got["pred"] - got["v"]) ** 2).mean()) < 0.5 * n["v"].std(), name
        assert (got["var"] >= 0).all(), name


def test_idw_hits_a_source_exactly(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 10.0, 0.0, 9.0)], "i int, x double, y double, v double")
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], "t int, x double, y double")
    got = interpolate.predict("idw", t, nodes, "v", target_id=["t"], source_id=["i"], k=2).toPandas().set_index("t")
    assert got.loc[1, "pred"] == 5.0 and got.loc[1, "var"] == 0.0 and got.loc[2, "pred"] == pytest.approx(7.0)


def test_nearest_with_cutoff_reaches_beyond_the_first_ring(spark, cloud):
    targets = pd.DataFrame({"t": range(40), "x": np.linspace(-9000, 9000, 40), "y": np.linspace(9000, -7000, 40)})
    src = spark.createDataFrame(cloud.rename(columns={"x": "sx", "y": "sy"}))
    got = spatial.nearest_join(spark.createDataFrame(targets), src, target_id=["t"], source_id=["id"], base=400.0, max_distance=1200.0).toPandas().set_index("t")["dist"]
    d = np.sqrt((targets.x.to_numpy()[:, None] - cloud.x.to_numpy()) ** 2 + (targets.y.to_numpy()[:, None] - cloud.y.to_numpy()) ** 2).min(axis=1)
    assert set(got.index) == set(np.flatnonzero(d <= 1200.0))
    assert np.allclose(got.sort_index().to_numpy(), d[d <= 1200.0])


def test_nearest_search_stays_linear_in_density(spark):
    """Ten times the targets and sources on the same ground: about ten times the candidates, not a hundred."""
    def candidates(n):
        rng = np.random.default_rng(n)
        xy = rng.uniform(0, 20_000, (2 * n, 2))
        t = spark.createDataFrame(pd.DataFrame({"t": range(n), "x": xy[:n, 0], "y": xy[:n, 1]}))
        s = spark.createDataFrame(pd.DataFrame({"s": range(n), "sx": xy[n:, 0], "sy": xy[n:, 1]}))
        got = spatial.knn_join(t, s, 1, target_id=["t"], source_id=["s"], base=1000.0).toPandas().set_index("t")["s"]
        assert got.sort_index().tolist() == ((xy[:n, None] - xy[None, n:]) ** 2).sum(2).argmin(1).tolist()
        return spatial.knn_candidates(t, s, 1, base=1000.0, max_distance=3000.0).count()

    assert candidates(2000) < 14 * candidates(200)


def test_mooring_files_have_headers_of_their_own(spark, tmp):
    import os

    os.makedirs(f"{tmp}/m")
    with open(f"{tmp}/m/a.tsv", "w") as f:
        f.write("Timestamp (UTC)\tEastward u\tNorthward v\tTemperature\tConductivity\nUTC\tcm/s\tcm/s\tC\tmS/cm\n2020-01-01 00:00:00\t1.5\t2\t-1\t28\n2020-01-01 01:00:00\t1.5\t2\n\n")
    with open(f"{tmp}/m/b.tsv", "w") as f:
        f.write("timestamp\tconductivity\tdepth\ttemperature\tnorthward\teastward\n2020-01-02 00:00:00\t27\t9\t-2\t4\t3\n")
    rows = fields.read_mooring(spark, f"{tmp}/m")
    got = {r.time: (r.u_cm_s, r.v_cm_s, r.temperature_c, r.conductivity_ms_cm) for r in rows.where("rejected is null").collect()}
    assert got == {"UTC": ("cm/s", "cm/s", "C", "mS/cm"), "2020-01-01 00:00:00": ("1.5", "2", "-1", "28"), "2020-01-02 00:00:00": ("3", "4", "-2", "27")}
    audit = {os.path.basename(r.file): (r.n_records, r.n_rejected, r.n_undated) for r in fields.mooring_audit(rows).collect()}
    assert audit == {"a.tsv": (3, 1, 1), "b.tsv": (1, 0, 0)}
    assert fields.clean_mooring(rows).count() == 2
    with open(f"{tmp}/m/c.tsv", "w") as f:
        f.write("timestamp\teastward\n2020-01-02 00:00:00\t27\n")
    with pytest.raises(Exception, match="northward"):
        fields.read_mooring(spark, f"{tmp}/m").collect()


def test_bilinear_keeps_repeated_rows(spark):
    f = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(4) for j in range(4)], "cell_i bigint, cell_j bigint, z double")
    p = spark.createDataFrame([(1, 1.25, 2.5), (1, 1.25, 2.5), (2, 3.0, 3.0), (3, 3.5, 1.0), (4, None, 1.0)], "id bigint, x double, y double")
    got = sorted((r.id, r.z) for r in spatial.sample_bilinear(p, f, origin=(0.0, 0.0), step=1.0, value="z").collect() if r.z is not None)
    assert got == [(1, 26.25), (1, 26.25), (2, 33.0)]


@pytest.mark.parametrize("most_targets, most_sources", [(300_000, 2_000_000), (7, 2_000_000), (300_000, 5)])
def test_nearest_of_another_kind_makes_no_row_a_pair(spark, most_targets, most_sources):
    """Ties by id, kinds that differ, tiles dealt to several groups or left to the pyramid: the same rows, and never more than the targets."""
    from cryoframe.operators import nearest

    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "t": range(n), "x": rng.integers(0, 60, n) * 100.0, "y": rng.integers(0, 60, n) * 100.0, "kind": rng.integers(0, 3, n)})
    p = spark.createDataFrame(pdf)
    src = p.select("g", F.col("t").alias("s"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("kind").alias("s_kind"))
    found = nearest.nearest_join(p, src, target_id=["t"], source_id=["s"], by=["g"], unlike=("kind", "s_kind"), base=200.0, max_distance=300.0, most_targets=most_targets, most_sources=most_sources)
    got = {r.t: (r.s, r.dist) for r in found.collect()}
    want = {}
    for r in pdf.itertuples():
        o = pdf[(pdf.g == r.g) & (pdf.kind != r.kind)]
        d = np.sqrt((o.x - r.x) ** 2 + (o.y - r.y) ** 2)
        if d.min() <= 300:
            want[r.t] = (o.t[d == d.min()].min(), d.min())
    assert got == want


def test_windows_share_the_medians_of_their_epochs(spark):
    """Windows repeat epochs of the tracks, never points: the lines are those of each window by itself."""
    rng = np.random.default_rng(2)
    p = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(-900, 900, 2000), "y": rng.uniform(-900, 900, 2000), "h": rng.normal(0, 1, 2000), "epoch": rng.integers(0, 6, 2000) + 0.5}))
    t = spark.createDataFrame(pd.DataFrame({"parcel": 1, "epoch": np.arange(6) + 0.5, "px": np.arange(6) * 10.0, "py": 0.0, "valid": True}))
    spans = F.filter(F.array(*[F.lit(float(s)) for s in range(4)]), lambda s: (F.col("epoch") >= s) & (F.col("epoch") < s + 3))
    got = flow.lagrangian_rates(t.withColumn("w", F.explode(spans)), p, ids=["parcel"], windows=["w"], radius=800.0, min_epochs=3).orderBy("w").collect()
    assert [r.w for r in got] == [0.0, 1.0, 2.0, 3.0]
    for r in got:
        one = flow.lagrangian_rates(t.where((F.col("epoch") >= r.w) & (F.col("epoch") < r.w + 3)), p, ids=["parcel"], radius=800.0, min_epochs=3).first()
        assert (r.n_obs, r.n_epochs) == (one.n_obs, one.n_epochs) and abs(r.dhdt_lagrangian - one.dhdt_lagrangian) < 1e-9


def test_tiles_with_halo_are_not_shuffled_to_find_the_active_ones(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = spark.range(400).select((F.col("id") % 20 * 100.0).alias("x"), (F.col("id") / 4).alias("y"))
        plan = spatial.halo_tiles(p, 500.0, 100.0)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [tile_i" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
