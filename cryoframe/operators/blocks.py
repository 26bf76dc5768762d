"""Grouped least squares through sums of products.

Every linear fit here needs only sums of products of its basis columns. Sums
combine on the map side, so a group of any size leaves its executors as one row
of numbers: no group is ever collected, and a hot group costs no more than a cold
one. Keeping the sums per (group, year) makes leave-one-year-out, jackknife and
year bootstrap arithmetic on a handful of rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_sums(
    df: DataFrame, keys: Sequence[str], basis: Mapping[str, Column], response: Column, weight: Column | None = None
) -> DataFrame:
    """One row per key: n, the basis names' upper-triangle sums, the right-hand side and the response's own.

    Columns: ``n``, ``s`` (array, row-major upper triangle), ``b`` (array), ``hh``; with a weight also
    ``ws`` and ``wb``, the weighted versions, and ``w`` the weight total.
    """
    cols = list(basis.values())
    k = len(cols)
    tmp = df.select(*keys, *[c.alias(f"_q{i}") for i, c in enumerate(cols)], response.alias("_h"), (weight if weight is not None else F.lit(1.0)).alias("_w"))
    q = [F.col(f"_q{i}") for i in range(k)]
    tri = [(i, j) for i in range(k) for j in range(i, k)]
    aggs = [F.count("_h").alias("n")]
    aggs.append(F.array(*[F.sum(q[i] * q[j]) for i, j in tri]).alias("s"))
    aggs.append(F.array(*[F.sum(q[i] * F.col("_h")) for i in range(k)]).alias("b"))
    aggs.append(F.sum(F.col("_h") * F.col("_h")).alias("hh"))
    if weight is not None:
        aggs.append(F.array(*[F.sum(F.col("_w") * q[i] * q[j]) for i, j in tri]).alias("ws"))
        aggs.append(F.array(*[F.sum(F.col("_w") * q[i] * F.col("_h")) for i in range(k)]).alias("wb"))
        aggs.append(F.sum("_w").alias("w"))
    return tmp.where(F.col("_h").isNotNull()).groupBy(*keys).agg(*aggs)


def unpack(tri: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    iu = np.triu_indices(k)
    m[iu] = tri
    return m + m.T - np.diag(np.diag(m))


# ------------------------------------------------------------------ plane a + b*dx + c*dy, all in Columns
def plane_aggregates(u: Column, v: Column, h: Column) -> list[Column]:
    return [
        F.count(h).alias("n_obs"), F.sum(u).alias("_u"), F.sum(v).alias("_v"), F.sum(h).alias("_h"),
        F.sum(u * u).alias("_uu"), F.sum(v * v).alias("_vv"), F.sum(u * v).alias("_uv"),
        F.sum(u * h).alias("_uh"), F.sum(v * h).alias("_vh"), F.sum(h * h).alias("_hh"),
    ]


PLANE_SUMS = ["_u", "_v", "_h", "_uu", "_vv", "_uv", "_uh", "_vh", "_hh"]


def plane_solution(df: DataFrame, *, value: str = "h_node", variance: str = "var_node", rank_tol: float = 1e-10) -> DataFrame:
    """Intercept and its formal variance from the sums of :func:`plane_aggregates`.

    Means are removed in closed form first, which leaves a 2 x 2 system; the
    determinant relative to the product of the diagonal is the rank test.
    """
    n = F.col("n_obs").cast("double")
    mu, mv, mh = F.col("_u") / n, F.col("_v") / n, F.col("_h") / n
    suu, svv = F.col("_uu") - n * mu * mu, F.col("_vv") - n * mv * mv
    suv = F.col("_uv") - n * mu * mv
    suh, svh = F.col("_uh") - n * mu * mh, F.col("_vh") - n * mv * mh
    shh = F.col("_hh") - n * mh * mh
    base = df.select(*[c for c in df.columns if c not in PLANE_SUMS], mu.alias("_mu"), mv.alias("_mv"), mh.alias("_mh"),
                     suu.alias("_a"), svv.alias("_d"), suv.alias("_o"), suh.alias("_p"), svh.alias("_q"), shh.alias("_r"))
    det = F.col("_a") * F.col("_d") - F.col("_o") * F.col("_o")
    ok = (F.col("n_obs") >= 3) & (F.col("_a") > 0) & (F.col("_d") > 0) & (det > rank_tol * F.col("_a") * F.col("_d"))
    solved = base.withColumn("_det", F.when(ok, det))
    b = (F.col("_p") * F.col("_d") - F.col("_q") * F.col("_o")) / F.col("_det")
    c = (F.col("_q") * F.col("_a") - F.col("_p") * F.col("_o")) / F.col("_det")
    solved = solved.withColumn("_b", b).withColumn("_c", c)
    rss = F.greatest(F.col("_r") - F.col("_b") * F.col("_p") - F.col("_c") * F.col("_q"), F.lit(0.0))
    cov = 1 / F.col("n_obs") + (
        F.col("_mu") ** 2 * F.col("_d") - 2 * F.col("_mu") * F.col("_mv") * F.col("_o") + F.col("_mv") ** 2 * F.col("_a")
    ) / F.col("_det")
    return (
        solved.withColumn(value, F.col("_mh") - F.col("_b") * F.col("_mu") - F.col("_c") * F.col("_mv"))
        .withColumn(variance, rss / F.greatest(F.col("n_obs") - 3, F.lit(1)) * cov)
        .drop("_mu", "_mv", "_mh", "_a", "_d", "_o", "_p", "_q", "_r", "_det", "_b", "_c")
    )


def node_series(
    pairs: DataFrame, *, node: Sequence[str] = ("node_x", "node_y"), period: Sequence[str] = ("year",), height: str = "h",
    xy: tuple[str, str] = ("x", "y"), radius: float, min_points: int = 10,
) -> DataFrame:
    """Plane elevation at each node and period with its formal sigma, from (point, node) pairs."""
    u = (F.col(xy[0]) - F.col(node[0])) / F.lit(float(radius))
    v = (F.col(xy[1]) - F.col(node[1])) / F.lit(float(radius))
    sums = pairs.groupBy(*node, *period).agg(*plane_aggregates(u, v, F.col(height)))
    return (
        plane_solution(sums.where(F.col("n_obs") >= min_points))
        .where(F.col("h_node").isNotNull())
        .withColumn("sigma", F.sqrt("var_node"))
        .drop("var_node")
    )


# ------------------------------------------------------------------ one-variable and harmonic fits
def line_fit(df: DataFrame, keys: Sequence[str], value: str, time: str, *, min_epochs: int = 4) -> DataFrame:
    """Least-squares slope per group with R2 and the slope's sigma, from the built-in regression aggregates."""
    ok = F.col(value).isNotNull() & F.col(time).isNotNull()
    n, sxx, syy, sxy = (F.count(F.when(ok, 1)), F.regr_sxx(value, time), F.regr_syy(value, time), F.regr_sxy(value, time))
    rss = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    return (
        df.groupBy(*keys)
        .agg(n.alias("n_epochs"), F.regr_slope(value, time).alias("slope"), F.regr_intercept(value, time).alias("intercept"),
             F.regr_r2(value, time).alias("r2"), sxx.alias("_sxx"), syy.alias("_syy"), sxy.alias("_sxy"),
             F.avg(F.when(ok, F.col(time))).alias("t_center"), (F.max(F.when(ok, F.col(time))) - F.min(F.when(ok, F.col(time)))).alias("span"))
        .where(F.col("n_epochs") >= min_epochs)
        .withColumn("rmse", F.sqrt(rss / F.col("n_epochs")))
        .withColumn("slope_sigma", F.when(F.col("n_epochs") > 2, F.sqrt(F.try_divide(rss / (F.col("n_epochs") - 2), F.col("_sxx")))))
        .drop("_sxx", "_syy", "_sxy")
    )


def harmonic_fit(
    df: DataFrame, keys: Sequence[str], value: str, hours: str, periods: Sequence[float] = (12.0, 12.4206, 23.9345, 25.8193), *, min_rows: int = 10
) -> DataFrame:
    """Amplitude and R2 of y = c + a sin + b cos per group and period: six moments and a 2 x 2 solve."""
    fanned = df.where(F.col(value).isNotNull() & F.col(hours).isNotNull()).withColumn(
        "period_h", F.explode(F.array(*[F.lit(float(p)) for p in periods]))
    )
    w = F.lit(2 * math.pi) / F.col("period_h") * F.col(hours)
    a = fanned.withColumn("_s", F.sin(w)).withColumn("_c", F.cos(w)).groupBy(*keys, "period_h")
    m = a.agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("_s").alias("_ss"), F.var_pop("_c").alias("_cc"), F.covar_pop("_s", "_c").alias("_sc"),
        F.covar_pop("_s", value).alias("_sy"), F.covar_pop("_c", value).alias("_cy"), F.var_pop(value).alias("_yy"),
    ).where(F.col("n") >= min_rows)
    det = F.col("_ss") * F.col("_cc") - F.col("_sc") ** 2
    ka = F.try_divide(F.col("_sy") * F.col("_cc") - F.col("_cy") * F.col("_sc"), det)
    kb = F.try_divide(F.col("_cy") * F.col("_ss") - F.col("_sy") * F.col("_sc"), det)
    fitted = F.try_divide(ka * F.col("_sy") + kb * F.col("_cy"), F.col("_yy"))
    return m.select(*keys, "period_h", "n", F.hypot(ka, kb).alias("amplitude"), F.coalesce(fitted, F.lit(0.0)).alias("r2"))


def invert_normal(left: np.ndarray, right: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, inverse, condition of the design) of stacked normal equations.

    Columns are scaled first; a system whose design has a condition of 1e7 or more has no solution (NaN). Every robust
    fit of the library asks here, so none keeps a node that another drops.
    """
    scale = np.sqrt(np.maximum(np.einsum("mii->mi", left), 1e-300))
    norm = left / scale[:, :, None] / scale[:, None, :]
    coef, inverse, cond = np.full(right.shape, np.nan), np.full(left.shape, np.nan), np.full(len(right), np.inf)
    ok = np.isfinite(norm).all(axis=(1, 2)) & enough
    if ok.any():
        cond[ok] = np.sqrt(np.linalg.cond(norm[ok]))
    ok &= cond < 1e7
    if ok.any():
        inverse[ok] = np.linalg.inv(norm[ok]) / scale[ok][:, :, None] / scale[ok][:, None, :]
        coef[ok] = np.einsum("mij,mj->mi", inverse[ok], right[ok])
    return coef, inverse, cond


def own_axes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, half width) of ranges; a range of one value has the width 1."""
    half = (high - low) / 2
    return (low + high) / 2, np.where(half > 0, half, 1.0)


def moved_terms(terms: Sequence[str], middle: np.ndarray, half: np.ndarray) -> np.ndarray:
    """(m, k, k): each term of (t, u, v), measured from ``middle`` in units of ``half`` (m x 3), as coefficients of the terms themselves.

    Points that fill a sliver of a neighbourhood tell terms about the node apart only in their last digits, and terms about
    their own middle well. The fit is the same: coefficients c of the moved terms are c M of the terms.
    """
    at, (t, u, v), (a, b, c) = {x: i for i, x in enumerate(terms)}, middle.T, half.T
    parts = {
        "one": {"one": 1.0}, "rate": {"rate": 1 / a, "one": -t / a}, "accel": {"accel": 1 / a**2, "rate": -t / a**2, "one": t * t / (2 * a**2)},
        "u": {"u": 1 / b, "one": -u / b}, "v": {"v": 1 / c, "one": -v / c}, "uv": {"uv": 1 / (b * c), "u": -v / (b * c), "v": -u / (b * c), "one": u * v / (b * c)},
        "uu": {"uu": 1 / b**2, "u": -2 * u / b**2, "one": u * u / b**2}, "vv": {"vv": 1 / c**2, "v": -2 * v / c**2, "one": v * v / c**2},
    }
    out = np.zeros((len(middle), len(terms), len(terms)))
    for term, row in at.items():
        for of, number in parts[term].items():
            out[:, row, at[of]] = number
    return out


def solve_sums(sums: DataFrame, keys: Sequence[str], names: Sequence[str], *, min_extra: int = 0) -> DataFrame:
    """Coefficients, standard errors, covariance (row by row) and residual sum per key from :func:`moment_sums`.

    Row-wise over the small table of sums; each row is a k x k solve, batched by numpy.
    """
    k = len(names)
    weighted = "ws" in sums.columns
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema.fields])
    schema += ", n bigint, coef array<double>, err array<double>, cov array<double>, rss double, cond double"

    def run(batches):
        iu = np.triu_indices(k)
        for pdf in batches:
            out = pdf[list(keys)].copy()
            m = len(pdf)
            coef, err = np.full((m, k), np.nan), np.full((m, k), np.nan)
            rss, cond, cov = np.full(m, np.nan), np.full(m, np.inf), np.full((m, k, k), np.nan)
            if m:
                def stack(col):
                    a = np.zeros((m, k, k))
                    a[:, iu[0], iu[1]] = np.stack(pdf[col].to_numpy())
                    return a + np.transpose(a, (0, 2, 1)) - a * np.eye(k)

                s, b = stack("s"), np.stack(pdf["b"].to_numpy())
                n = pdf["n"].to_numpy(float)
                left, right = s, b
                if weighted:
                    scale = n / pdf["w"].to_numpy(float)
                    left, right = stack("ws") * scale[:, None, None], np.stack(pdf["wb"].to_numpy()) * scale[:, None]
                coef, inverse, cond = invert_normal(left, right, n >= k + min_extra)
                r = pdf["hh"].to_numpy(float) - 2 * np.einsum("mi,mi->m", coef, b) + np.einsum("mi,mij,mj->m", coef, s, coef)
                rss = np.maximum(r, 0.0)
                cov = inverse * (rss / np.maximum(n - k, 1))[:, None, None]
                err = np.sqrt(np.maximum(np.einsum("mii->mi", cov), 0.0))
            out["n"] = pdf["n"]
            out["coef"] = [None if np.isnan(c).any() else c.tolist() for c in coef]
            out["err"] = [None if np.isnan(c).any() else c.tolist() for c in err]
            out["cov"] = [None if np.isnan(c).any() else c.ravel().tolist() for c in cov]
            out["rss"] = np.where(np.isnan(rss), None, rss)
            out["cond"] = np.where(np.isfinite(cond), cond, None)
            yield out

    return sums.mapInPandas(run, schema)
