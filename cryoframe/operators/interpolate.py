"""Variograms, five interpolators with one signature, and their cross-validation.

All predictors read the same k-nearest rows. Three are plain aggregates; kriging and
optimal interpolation solve one small system per target, in batches over rows that
already hold the target's at most k neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cryoframe.operators.apart import distance_to_others
from cryoframe.operators.ranks import hash_sample, quartile_class
from cryoframe.operators.skew import group_quantiles
from cryoframe.operators.spatial import cell, knn_join, nearest_join, outside_buffer
from cryoframe.operators.variogram import variogram_rows
from cryoframe.session import cut


# ------------------------------------------------------------------ variogram
def empirical_variogram(
    df: DataFrame, value: str, *, ids: Sequence[str], max_lag: float, n_lags: int = 15, max_points: int | None = None,
    by: Sequence[str] = (), x: str = "x", y: str = "y", order=None,
) -> DataFrame:
    """Half mean squared difference per equal lag class; classes without pairs are absent.

    All rows count, at any density (:mod:`variogram`). ``max_points`` draws a sample where a caller asks for one.
    """
    used = df.where(F.col(value).isNotNull()).select(*dict.fromkeys([*ids, *by, x, y, value]))
    if max_points is not None:
        used = hash_sample(used, max_points, ids, by=by, order=order)
    rows = variogram_rows(used, value, max_lag=max_lag, n_lags=n_lags, by=by, x=x, y=y)
    return rows.withColumn("center", (F.col("lag") + 0.5) * (float(max_lag) / n_lags))


def variogram_gamma(model: str, h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    if model == "spherical":
        r = np.minimum(h / reach, 1.0)
        g = nugget + (sill - nugget) * (1.5 * r - 0.5 * r**3)
    else:
        g = nugget + (sill - nugget) * (1 - np.exp(-h / reach))
    return np.where(h == 0, 0.0, g)


def fit_variogram_rows(center: np.ndarray, gamma: np.ndarray, variance: float, models: Sequence[str] = ("spherical", "exponential")) -> dict:
    """Bounded least squares on at most a few dozen lag rows: for each reach the two levels are a
    linear problem in a box; the reach itself is searched on a grid and refined."""
    if center.size < 3:
        raise ValueError("the empirical variogram has fewer than three lags")
    level = variance or float(gamma.max())
    caps = (3 * level + 1e-9, 5 * level + 1e-9)

    def solve(model: str, reach: float) -> tuple[float, float, float]:
        shape = variogram_gamma(model, center, 0.0, 1.0, reach)
        design = np.column_stack([1 - shape, shape])
        sol, *_ = np.linalg.lstsq(design, gamma, rcond=None)
        tries = [np.clip(sol, 0, caps)]
        for fixed, other in ((0, 1), (1, 0)):
            for edge in (0.0, caps[fixed]):
                c = np.zeros(2)
                c[fixed] = edge
                den = float(design[:, other] @ design[:, other])
                c[other] = np.clip(design[:, other] @ (gamma - design[:, fixed] * edge) / den, 0, caps[other]) if den > 0 else 0.0
                tries.append(c)
        if np.allclose(tries[0], sol):
            tries = tries[:1]
        sse = [float(((design @ c - gamma) ** 2).sum()) for c in tries]
        i = int(np.argmin(sse))
        return sse[i], float(tries[i][0]), float(tries[i][1])

    best: dict | None = None
    for model in models:
        low, high = float(center[1]), float(center[-1] * 3)
        for _ in range(5):
            reaches = np.linspace(low, high, 41)
            scores = [solve(model, r)[0] for r in reaches]
            i = int(np.argmin(scores))
            low, high = reaches[max(i - 1, 0)], reaches[min(i + 1, 40)]
        sse, nugget, sill = solve(model, float(reaches[i]))
        if best is None or sse < best["sse"]:
            best = {"model": model, "nugget": nugget, "sill": sill, "range_m": float(reaches[i]), "sse": sse}
    return best


def fit_variogram(df: DataFrame, value: str, *, ids: Sequence[str], max_lag: float = 150_000.0, n_lags: int = 15, **kw) -> dict:
    """Fit of one variogram. The cluster reduces to ``n_lags`` rows; those are all that reaches the driver."""
    rows = empirical_variogram(df, value, ids=ids, max_lag=max_lag, n_lags=n_lags, **kw).orderBy("lag").collect()
    variance = df.agg(F.var_pop(value)).first()[0] or 0.0
    c, g = np.array([r["center"] for r in rows], float), np.array([r["gamma"] for r in rows], float)
    return {**fit_variogram_rows(c, g, variance), "n_lags": len(rows)}


def fit_variograms(df: DataFrame, value: str, *, by: str, ids: Sequence[str], max_lag: float, n_lags: int = 15, **kw) -> dict:
    """One fit per value of ``by``, for a handful of folds: folds x lags rows reach the driver."""
    rows = empirical_variogram(df, value, ids=ids, max_lag=max_lag, n_lags=n_lags, by=[by], **kw).orderBy(by, "lag").collect()
    var = {r[by]: r["v"] or 0.0 for r in df.groupBy(by).agg(F.var_pop(value).alias("v")).collect()}
    out = {}
    for f in var:
        own = [r for r in rows if r[by] == f]
        if len(own) >= 3:
            out[f] = fit_variogram_rows(np.array([r["center"] for r in own]), np.array([r["gamma"] for r in own]), var[f])
    return out


# ------------------------------------------------------------------ predictors on neighbour rows
def idw(neighbours: DataFrame, keys: Sequence[str], value: str, *, power: float = 2.0, exact_eps: float = 1e-9, floor: float = 0.0, **_) -> DataFrame:
    """Inverse distance; a source closer than ``exact_eps`` gives its own value and no variance."""
    d = F.sqrt("d2")
    w = 1 / F.pow(F.greatest(d, F.lit(floor)) if floor else d, F.lit(power))
    ok = d >= exact_eps
    held = neighbours.withColumn("_w", F.when(ok, w)).withColumn("_hit", F.when(~ok & (F.col("rank") == 1), F.col(value)))
    wv = F.col("_w") * F.col(value)
    return (
        held.groupBy(*keys)
        .agg(F.max("_hit").alias("_exact"), F.sum("_w").alias("_sw"), F.sum(wv).alias("_swv"), F.sum(wv * F.col(value)).alias("_swvv"), F.min("d2").alias("_d2"))
        .withColumn("pred", F.coalesce("_exact", F.col("_swv") / F.col("_sw")))
        .withColumn("var", F.when(F.col("_exact").isNotNull(), 0.0).otherwise(F.greatest(F.col("_swvv") / F.col("_sw") - F.col("pred") ** 2, F.lit(0.0))))
        .select(*keys, "pred", "var")
    )


def gaussian_kernel(neighbours: DataFrame, keys: Sequence[str], value: str, *, sigma: float | None = None, variogram: Mapping | None = None, **_) -> DataFrame:
    """exp(-d^2 / 2 sigma^2) weights; the variance is divided by Kish's effective count."""
    s = F.lit(sigma) if sigma is not None else (_level(variogram, "range_m") / 3 if variogram else F.lit(10_000.0))
    w = F.exp(-F.col("d2") / (2.0 * s * s))
    v = F.col(value)
    g = neighbours.withColumn("_w", w).groupBy(*keys).agg(
        F.sum("_w").alias("_a"), F.sum(F.col("_w") * F.col("_w")).alias("_b"), F.sum(F.col("_w") * v).alias("_c"), F.sum(F.col("_w") * v * v).alias("_d"))
    p = F.when(F.col("_a") > 0, F.col("_c") / F.col("_a"))
    n_eff = F.col("_a") * F.col("_a") / F.col("_b")
    spread = F.greatest(F.col("_d") / F.col("_a") - F.col("pred") ** 2, F.lit(0.0))
    return g.withColumn("pred", p).withColumn("var", F.when(F.col("_a") > 0, spread / F.greatest(n_eff, F.lit(1.0)))).select(*keys, "pred", "var")


def median_kernel(neighbours: DataFrame, keys: Sequence[str], value: str, *, radius: float | None = None, variogram: Mapping | None = None, **_) -> DataFrame:
    """Median of the neighbours within the radius, else of the nearest one; groups hold at most k rows."""
    r = F.lit(radius) if radius is not None else (_level(variogram, "range_m") / 2 if variogram else F.lit(15_000.0))
    near = neighbours.where((F.sqrt("d2") <= r) | (F.col("rank") == 1))
    vals = near.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v")).withColumn("_n", F.size("_v"))

    def mid(arr: str):
        n = F.size(arr)
        return (F.element_at(arr, ((n + 1) / 2).cast("int")) + F.element_at(arr, (n / 2).cast("int") + 1)) / 2

    out = vals.withColumn("pred", mid("_v")).withColumn("_d", F.sort_array(F.transform("_v", lambda e: F.abs(e - F.col("pred")))))
    return out.withColumn("var", F.pow(1.253 * 1.4826 * mid("_d"), F.lit(2.0)) / F.col("_n")).select(*keys, "pred", "var")


def _level(variogram: Mapping, name: str):
    """A parameter of the variogram: a number, or a column of the neighbour rows."""
    v = variogram[name]
    return v if isinstance(v, F.Column) else F.lit(v)


def _solve_batches(neighbours: DataFrame, keys: Sequence[str], value: str, sigma: str | None, variogram: Mapping, solver) -> DataFrame:
    """Gather each target's at most k neighbours and its variogram in one row, then solve rows of equal k and model together."""
    s = F.col(sigma) if sigma else F.lit(None).cast("double")
    packed = neighbours.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"),
                                             F.col(value).cast("double").alias("v"), s.cast("double").alias("s"), F.sqrt("d2").alias("d")))).alias("_z"),
        *[F.first(_level(variogram, n)).alias(f"_{n}") for n in ("model", "nugget", "sill", "range_m")])
    flat = packed.select(*keys, *[F.col(f"_z.{c}").alias(c) for c in ("sx", "sy", "v", "s", "d")], "_model", "_nugget", "_sill", "_range_m")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.select(*keys).schema.fields)

    def run(batches):
        for pdf in batches:
            out = pdf[list(keys)].copy()
            pred, var = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            size = pdf["v"].map(len).to_numpy() if len(pdf) else np.array([])
            model = pdf["_model"].to_numpy()
            for k, m in sorted(set(zip(size.tolist(), model.tolist(), strict=True))):
                on = np.flatnonzero((size == k) & (model == m))
                col = lambda c: np.stack([np.asarray(a, float) for a in pdf[c].iloc[on]])  # noqa: E731, B023
                levels = {n: pdf[f"_{n}"].to_numpy(float)[on] for n in ("nugget", "sill", "range_m")}
                pred[on], var[on] = solver(col("sx"), col("sy"), col("v"), col("s"), col("d"), m, levels)
            out["pred"], out["var"] = pred, var
            yield out

    return flat.mapInPandas(run, f"{schema}, pred double, var double")


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Batched solve; a singular system falls back to its pseudo-inverse."""
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.pinv(m) @ r for m, r in zip(a, b)])


def ordinary_kriging(neighbours: DataFrame, keys: Sequence[str], value: str, *, variogram: Mapping, **_) -> DataFrame:
    def solver(x, y, v, s, d, model, levels):
        gam = lambda h: variogram_gamma(model, h, *[levels[n].reshape(-1, *[1] * (h.ndim - 1)) for n in ("nugget", "sill", "range_m")])
        m, k = v.shape
        a = np.ones((m, k + 1, k + 1))
        a[:, :k, :k] = gam(np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]))
        a[:, k, k] = 0.0
        b = np.ones((m, k + 1))
        b[:, :k] = gam(d)
        sol = _solve(a, b)
        w = sol[:, :k]
        return (w * v).sum(1), np.maximum((w * b[:, :k]).sum(1) + sol[:, k], 0.0)

    return _solve_batches(neighbours, keys, value, None, variogram, solver)


def optimal_interpolation(neighbours: DataFrame, keys: Sequence[str], value: str, *, variogram: Mapping, sigma_col: str | None = None, **_) -> DataFrame:
    """Markov covariance sill (1 + r/L) exp(-r/L) with observation variance on the diagonal."""

    def solver(x, y, v, s, d, model, levels):
        sill, length = levels["sill"], levels["range_m"]
        wide = lambda p, r: p.reshape(-1, *[1] * (r.ndim - 1))
        cov = lambda r: wide(sill, r) * (1 + r / wide(length, r)) * np.exp(-r / wide(length, r))
        err = np.where(np.nan_to_num(s, nan=0.0) > 0, s, 0.05)
        c = cov(np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]))
        idx = np.arange(v.shape[1])
        c[:, idx, idx] += err**2
        c0 = cov(d)
        w = _solve(c, c0)
        return (w * v).sum(1) + (1 - w.sum(1)) * v.mean(1), np.maximum(sill - (w * c0).sum(1), 0.0)

    return _solve_batches(neighbours, keys, value, sigma_col, variogram, solver)


# The registry: name -> (neighbour rows, target keys, value column, options) -> pred, var per target.
PREDICTORS: dict[str, Callable[..., DataFrame]] = {
    "idw": idw,
    "gaussian_kernel": gaussian_kernel,
    "median_kernel": median_kernel,
    "ordinary_kriging": ordinary_kriging,
    "oi_markov": optimal_interpolation,
}
NEEDS_VARIOGRAM = frozenset({"ordinary_kriging", "oi_markov", "gaussian_kernel", "median_kernel"})


def neighbours_of(
    targets: DataFrame, nodes: DataFrame, value: str, *, target_id: Sequence[str], source_id: Sequence[str], k: int = 32, sigma: str | None = None,
    txy: tuple[str, str] = ("x", "y"), nxy: tuple[str, str] = ("x", "y"), by: Sequence[str] = (), base: float = 5000.0, max_distance: float | None = None,
) -> DataFrame:
    """Target keys with their k nearest valued nodes: sx, sy, value, d2, rank."""
    extra = [sigma] if sigma else []
    src = nodes.where(F.col(value).isNotNull()).select(
        *by, *[F.col(c).alias(f"_s_{c}") for c in source_id], F.col(nxy[0]).alias("sx"), F.col(nxy[1]).alias("sy"), F.col(value).alias("_val"), *[F.col(e).alias("_sig") for e in extra])
    tgt = targets.select(*dict.fromkeys([*target_id, *by, *txy]))
    near = knn_join(tgt, src, k, target_id=target_id, source_id=[f"_s_{c}" for c in source_id], txy=txy, by=by, base=base, max_distance=max_distance)
    return near.withColumnRenamed("_val", value).withColumnRenamed("_sig", sigma or "_sig")


def predict(
    method: str, targets: DataFrame, nodes: DataFrame, value: str, *, target_id: Sequence[str], source_id: Sequence[str], sigma: str | None = None, k: int = 32, options: Mapping | None = None, **kw
) -> DataFrame:
    near = neighbours_of(targets, nodes, value, target_id=target_id, source_id=source_id, k=k, sigma=sigma, **kw)
    return PREDICTORS[method](near, list(target_id), value, **{"sigma_col": sigma, **(options or {})})


def node_grid(nodes: DataFrame, res: float, *, x: str = "x", y: str = "y") -> DataFrame:
    """Regular grid over the extent of the nodes: (gx, gy)."""
    ends = nodes.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    count = lambda a, b: F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a)) / res + 1e-9).cast("int"))
    return (
        ends.withColumn("_i", F.explode(count("x0", "x1"))).withColumn("_j", F.explode(count("y0", "y1")))
        .select((F.col("x0") + F.col("_i") * res).alias("gx"), (F.col("y0") + F.col("_j") * res).alias("gy"))
    )


def interpolate_to_grid(
    nodes: DataFrame, method: str, *, value: str, sigma: str, source_id: Sequence[str], res: float = 5000.0, k: int = 32, options: Mapping | None = None, x: str = "x", y: str = "y"
) -> DataFrame:
    """Value and sigma by the same method; the total variance is the interpolation's plus the input's."""
    grid = node_grid(nodes, res, x=x, y=y)
    common = dict(target_id=["gx", "gy"], source_id=source_id, txy=("gx", "gy"), nxy=(x, y), k=k, options=options)
    val = predict(method, grid, nodes, value, sigma=sigma, **common).withColumnRenamed("var", "var_interp")
    sig = predict(method, grid, nodes, sigma, **common).select("gx", "gy", F.col("pred").alias("sigma_input"))
    return val.join(sig, ["gx", "gy"]).withColumn("var", F.col("var_interp") + F.col("sigma_input") ** 2)


# ------------------------------------------------------------------ validation
def prediction_metrics(residuals: DataFrame, by: Sequence[str], *, resid: str = "resid", var: str = "var") -> DataFrame:
    """RMSE, MAE, bias and calibration against the predicted variance, from conditional aggregates."""
    r = F.col(resid)
    z = F.when(F.col(var) > 0, r / F.sqrt(F.col(var)))
    g = residuals.where(r.isNotNull()).groupBy(*by) if by else residuals.where(r.isNotNull())
    out = g.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias"), F.count(z).alias("_nz"),
        F.avg(F.when(z.isNotNull(), (F.abs(z) <= 1).cast("double"))).alias("coverage_68"),
        F.avg(F.when(z.isNotNull(), (F.abs(z) <= 1.96).cast("double"))).alias("coverage_95"), F.stddev_pop(z).alias("z_std"),
    )
    few = lambda c: F.when(F.col("_nz") > 10, F.col(c)).alias(c)
    return out.select(*by, "n", "rmse", "mae", "bias", few("coverage_68"), few("coverage_95"), few("z_std"))


def summarise_methods(metrics: DataFrame, keys: Sequence[str] = ("strategy", "method")) -> DataFrame:
    """Mean and sample deviation over folds, and how far calibration is from ideal."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"), F.avg("bias").alias("bias_mean"),
        F.abs(F.avg("coverage_68") - 0.6827).alias("coverage_gap"), F.abs(F.avg("z_std") - 1.0).alias("z_gap"))


def pick_method(metrics: DataFrame, *, tie: float = 0.02, method: str = "method") -> DataFrame:
    """Smallest RMSE; if the runner-up is within ``tie``, the better calibrated of the two. One row.

    ``metrics`` has one row per method, a handful.
    """
    top = metrics.agg(F.slice(F.sort_array(F.collect_list(F.struct("rmse", method, F.abs(F.col("coverage_68") - 0.6827).alias("dev")))), 1, 2).alias("_t"))
    first, second = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    close = F.coalesce(second["rmse"] <= first["rmse"] * (1 + tie), F.lit(False))
    better = F.coalesce(second["dev"], F.lit(float("inf"))) < F.coalesce(first["dev"], F.lit(float("inf")))
    return top.select(F.when(close & better, second[method]).otherwise(first[method]).alias("winner"), first["rmse"].alias("best_rmse"))


def fold_views(df: DataFrame, n_folds: int, *, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train rows exploded to every other fold, test rows), both keyed by ``fold``."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col(fold))
    return df.withColumn(fold, F.explode(others)), df


def cross_validate(
    nodes: DataFrame, methods: Sequence[str], *, value: str, ids: Sequence[str], n_folds: int, sigma: str | None = None, k: int = 32, max_lag: float = 150_000.0,
    base: float = 5000.0, options: Mapping | None = None, fold: str = "fold",
) -> DataFrame:
    """Residual rows of every method on held-out folds: ids, fold, method, pred, var, resid.

    Neighbours are found and written once, per fold, for all methods, with the held-out value and the variogram refitted
    on the fold's training part beside them; each method is then one grouping of those rows. ``options`` with sigma
    and radius take the place of the variogram where a kernel needs nothing else of it.
    """
    train, test = fold_views(nodes, n_folds, fold=fold)
    keys = [*ids, fold, "_truth"]
    near = neighbours_of(test.withColumn("_truth", F.col(value)), train, value, target_id=keys, source_id=ids, k=k, sigma=sigma, by=[fold], base=base)
    free = {n for n, need in (("gaussian_kernel", "sigma"), ("median_kernel", "radius")) if need in (options or {})}
    fitted: Mapping | None = None
    if any(m in NEEDS_VARIOGRAM - free for m in methods):
        vgs = fit_variograms(train, value, by=fold, ids=ids, max_lag=max_lag)
        names = ["model", "nugget", "sill", "range_m"]
        table = nodes.sparkSession.createDataFrame([(f, *[v[n] for n in names]) for f, v in vgs.items()], f"{fold} int, _vm string, _vn double, _vs double, _vr double")
        near = near.join(F.broadcast(table), fold)  # a row a fold; folds without a variogram have no predictions
        fitted = dict(zip(names, map(F.col, ("_vm", "_vn", "_vs", "_vr")), strict=True))
    near = cut(near)
    out = None
    for m in methods:
        p = PREDICTORS[m](near, keys, value, **{"sigma_col": sigma, "variogram": fitted, **(options or {})}).withColumn("method", F.lit(m))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("resid", F.col("pred") - F.col("_truth")).drop("_truth")


def idw_search(nodes: DataFrame, ks: Sequence[int], powers: Sequence[float], *, value: str, ids: Sequence[str], n_folds: int, within: Sequence[str] = (), base: float = 5000.0, fold: str = "fold") -> DataFrame:
    """RMSE and MAE of every (k, power) on held-out folds. Neighbours are found once for the largest k."""
    train, test = fold_views(nodes, n_folds, fold=fold)
    near = neighbours_of(test, train, value, target_id=[*ids, fold, *within], source_id=ids, k=max(ks), by=[fold, *within], base=base)
    grid = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.lit(float(p)).alias("power")) for k in ks for p in powers])
    fan = near.withColumn("_g", F.explode(grid)).where(F.col("rank") <= F.col("_g.k")).withColumn("k", F.col("_g.k")).withColumn("power", F.col("_g.power"))
    w = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1.0)), F.col("power"))
    pred = fan.withColumn("_w", w).groupBy(*ids, fold, "k", "power").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("pred"))
    r = F.col("pred") - F.col("_truth")
    truth = nodes.select(*ids, fold, F.col(value).alias("_truth"))
    return pred.join(truth, [*ids, fold]).groupBy("k", "power").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"))


def idw_search_buffered(
    nodes: DataFrame, ks: Sequence[int], powers: Sequence[float], *, value: str, ids: Sequence[str], n_folds: int, buffer_m: float, max_support: float, base: float = 5000.0, fold: str = "fold"
) -> DataFrame:
    """The search with a buffer: training nodes closer than ``buffer_m`` to any held-out node of the fold take no part, as they
    share observations with it. k, power, n, coverage_fraction, rmse, mae, bias, median_nearest.

    Held-out nodes whose nearest training node lies beyond ``max_support``, or that have fewer than k, are not predicted.
    """
    train, test = fold_views(nodes.select(*ids, "x", "y", fold, value), n_folds, fold=fold)
    train = cut(outside_buffer(train, test, buffer_m, by=[fold]))
    keys = [*ids, fold, "_truth"]
    near = cut(neighbours_of(test.withColumn("_truth", F.col(value)), train, value, target_id=keys, source_id=ids, k=max(ks), by=[fold], base=base))
    options = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.lit(float(p)).alias("power")) for k in ks for p in powers])
    fan = near.withColumn("_g", F.explode(options)).where(F.col("rank") <= F.col("_g.k")).select("*", "_g.k", "_g.power")
    w = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1.0)), F.col("power"))
    pred = fan.withColumn("_w", w).groupBy(*keys, "k", "power").agg(
        (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("pred"), F.sqrt(F.min("d2")).alias("nearest"), F.count(F.lit(1)).alias("_n")
    )
    pred = cut(pred.where((F.col("_n") == F.col("k")) & (F.col("nearest") <= max_support)))
    r = F.col("pred") - F.col("_truth")
    out = pred.groupBy("k", "power").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias"))
    out = out.join(group_quantiles(pred, ["k", "power"], "nearest", {"median_nearest": 0.5}).drop("n"), ["k", "power"])
    total = nodes.agg(F.count(F.lit(1)).alias("_all"))
    return out.crossJoin(F.broadcast(total)).withColumn("coverage_fraction", F.col("n") / F.col("_all")).drop("_all")


def interpolate_within(
    targets: DataFrame, cells: DataFrame, value: str, *, target_id: Sequence[str], source_id: Sequence[str], shelf: str = "shelf", k: int = 8, power: float = 2.0,
    min_sources: int = 4, base: float = 5000.0, max_distance: float | None = None,
) -> DataFrame:
    """Each target takes the shelf of its nearest source and is predicted inside it; shelves with too few
    sources use all cells. Adds pred, var, shelf, dist and whether the fallback was used."""
    near = neighbours_of(targets, cells.withColumn("_one", F.lit(1.0)), "_one", target_id=target_id, source_id=source_id, k=1, base=base, max_distance=max_distance)
    first = near.select(*target_id, *[F.col(f"_s_{c}").alias(c) for c in source_id], F.sqrt("d2").alias("dist"))
    clash = [c for c in source_id if c in target_id]
    if clash:
        raise ValueError(f"target and source ids share names: {clash}")
    placed = first.join(cells.select(*source_id, shelf), list(source_id)).select(*target_id, shelf, "dist")
    txy = targets.select(*dict.fromkeys([*target_id, "x", "y"]))
    held = txy.join(placed, list(target_id))
    sizes = cells.where(F.col(value).isNotNull()).groupBy(shelf).agg(F.count(F.lit(1)).alias("_n"))
    rich = sizes.where(F.col("_n") >= min_sources).select(shelf)
    own = neighbours_of(held.join(rich, shelf, "left_semi"), cells, value, target_id=[*target_id], source_id=source_id, k=k, by=[shelf], base=base)
    rest = neighbours_of(held.join(rich, shelf, "left_anti"), cells, value, target_id=[*target_id], source_id=source_id, k=k, base=base)
    a = idw(own, target_id, value, power=power, exact_eps=1e-6, floor=1.0).withColumn("fallback", F.lit(False))
    b = idw(rest, target_id, value, power=power, exact_eps=1e-6, floor=1.0).withColumn("fallback", F.lit(True))
    return a.unionByName(b).join(placed, list(target_id)).withColumn("sigma_interpolation", F.sqrt("var"))


def class_cells(points: DataFrame, size: float, mask_class: int, *, column: str = "mask_class") -> DataFrame:
    """Cells whose most frequent class is the given one: (ci, cj, x, y)."""
    counts = points.groupBy(cell("x", size).alias("ci"), cell("y", size).alias("cj"), column).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy("ci", "cj").agg(F.max_by(column, F.struct("_n", F.negate(column))).alias("_c"))
    return top.where(F.col("_c") == mask_class).select("ci", "cj", ((F.col("ci") + 0.5) * size).alias("x"), ((F.col("cj") + 0.5) * size).alias("y"))


def observation_validation(
    points: DataFrame, lattice_nodes: DataFrame, params, *, n_folds: int, max_distance: float, height: str = "h", time: str = "t_year", fold: str = "fold",
    ids: Sequence[str] = (), base: float = 5000.0, sigma: str | None = "s_elv", xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """Node fits on the training points of each fold, predicting held-out heights as p0 + rate (t - t_ref) at the nearest node."""
    from cryoframe.operators.rates import node_rates
    from cryoframe.operators.tilefit import View

    test = points
    views = [View({fold: f}, left_out=f) for f in range(n_folds)]
    fits = node_rates(points, lattice_nodes, params, height=height, time=time, views=views, fold=fold, sigma=sigma)
    src = cut(fits.select(fold, F.col("node_x").alias("sx"), F.col("node_y").alias("sy"), "p0", "dhdt", "dhdt_err", "p0_err"))  # a row a node and fold, read more than once
    near = nearest_join(test, src, target_id=[*ids, fold], source_id=["sx", "sy"], by=[fold], base=base, max_distance=max_distance)
    dt = F.col(time) - params.t_ref
    kept = dict.fromkeys([*ids, fold, xy[0], xy[1], time, *([sigma] if sigma else [])])
    return near.select(*kept, "dist", (F.col(height) - F.col("p0") - F.col("dhdt") * dt).alias("resid"),
                       (F.col("p0_err") ** 2 + (F.col("dhdt_err") * dt) ** 2).alias("var"))


def distance_to_train(residuals: DataFrame, points: DataFrame, *, ids: Sequence[str], n_folds: int, fold: str = "fold", size: float = 500.0) -> DataFrame:
    """``residuals`` with dist_to_train: how far the nearest point of any other fold is."""
    # A row without a fold in range is held out by no fold, so it has no training points.
    held = F.coalesce(F.col(fold).between(0, n_folds - 1), F.lit(False))
    near = distance_to_others(residuals.where(held), points, target_id=[*ids, fold], group=fold, out="dist_to_train", size=size)
    return near.unionByName(residuals.where(~held).withColumn("dist_to_train", F.lit(None).cast("double")))


def error_by_strata(residuals: DataFrame, strata: Mapping[str, "F.Column"], by: Sequence[str], *, resid: str = "resid", least: int = 10) -> DataFrame:
    """by, stratum, quartile (from 1), n, rmse: the error in quartiles of each variable, duplicate edges dropped; a variable with under ``least`` values is absent."""
    kinds = F.array(*[F.struct(F.lit(n).alias("stratum"), c.cast("double").alias("v")) for n, c in strata.items()])
    long = residuals.where(F.col(resid).isNotNull()).select(*by, resid, F.explode(kinds).alias("_s")).select(*by, resid, "_s.stratum", "_s.v").where(F.col("v").isNotNull())
    keys = [*by, "stratum"]
    classed = quartile_class(long, "v", "quartile", by=keys)
    out = classed.groupBy(*keys, "quartile").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(resid) * F.col(resid))).alias("rmse"))
    rich = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return out.join(rich.drop("_n"), keys, "left_semi").withColumn("quartile", (F.col("quartile") + 1).cast("int"))
