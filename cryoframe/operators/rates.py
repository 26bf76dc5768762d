"""Robust weighted rate at nodes: a space-time polynomial refitted after rejecting residuals.

Nodes are fitted tile by tile, many at once (:mod:`tilefit`). Nodes with too many points
around them for one task are fitted in passes over all points instead (:mod:`passes`): sums
of products per node, a small solve, exact medians of the residuals, rejection. Both follow
the same rules and give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryoframe.operators.passes import fit_in_passes
from cryoframe.operators.skew import _sliced_quantiles
from cryoframe.operators.spatial import _offsets, cell, radius_join
from cryoframe.operators.tilefit import TILE_ROWS, View, fit_tiles, result_schema
from cryoframe.session import cut


@dataclass(frozen=True)
class RateParams:
    """Fit rules. ``time_order`` 0 drops the time columns, 1 keeps a rate, 2 adds acceleration."""

    radius: float = 15_000.0
    t_ref: float = 2022.0
    min_points: int = 30
    min_span: float = 3.0
    min_years_accel: int = 4
    rate_limit: float = 20.0
    accel_limit: float = 5.0
    space_order: int = 2
    time_order: int = 2
    weighted: bool = True
    rounds: int = 5
    n_sigma: float = 3.0
    residual_limit: float = 5.0

    @property
    def terms(self) -> list[str]:
        out = ["one"]
        if self.time_order >= 1:
            out.append("rate")
        if self.time_order >= 2:
            out.append("accel")
        if self.space_order >= 1:
            out += ["u", "v", "uv"]
        if self.space_order >= 2:
            out += ["uu", "vv"]
        return out


# Output of a fit beside its keys. ``coef`` follows RateParams.terms with u, v in units of the radius, ``cov`` is its covariance row by row.
RATE_FIELDS = (
    "p0 double, dhdt double, accel double, p0_err double, dhdt_err double, accel_err double, "
    "rmse double, nobs bigint, tspan double, coef array<double>, cov array<double>"
)
#: Points around a node from which it is fitted in passes across the cluster.
NODE_LIMIT = 1_500_000


def _design(terms: Sequence[str], dt: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    columns = {"one": np.ones_like(dt), "rate": dt, "accel": dt * dt / 2, "u": u, "v": v, "uv": u * v, "uu": u * u, "vv": v * v}
    return np.column_stack([columns[t] for t in terms])


def basis_columns(terms: Sequence[str], dt: Column, u: Column, v: Column) -> dict[str, Column]:
    columns = {"one": F.lit(1.0), "rate": dt, "accel": dt * dt / 2, "u": u, "v": v, "uv": u * v, "uu": u * u, "vv": v * v}
    return {t: columns[t] for t in terms}


def crowded(points: DataFrame, nodes: DataFrame, radius: float, limit: int, *, xy=("x", "y"), node_xy=("node_x", "node_y")) -> DataFrame | None:
    """Nodes whose 3 x 3 buckets hold more than ``limit`` points: an upper bound of their
    neighbourhood found from bucket counts, without making a single pair."""
    counts = points.groupBy(cell(xy[0], radius).alias("_bx"), cell(xy[1], radius).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.where(F.col("_n") > limit / 9)
    around = (
        counts.withColumn("_o", F.explode(_offsets(1)))
        .select((F.col("_bx") + F.col("_o.i")).alias("_bx"), (F.col("_by") + F.col("_o.j")).alias("_by"), "_n")
        .distinct()
    )
    near = nodes.withColumn("_bx", cell(node_xy[0], radius)).withColumn("_by", cell(node_xy[1], radius)).join(
        around.select("_bx", "_by").distinct(), ["_bx", "_by"], "left_semi"
    )
    hot = near.select(*nodes.columns)
    return None if hot.isEmpty() else hot


def fan_out(points: DataFrame, views: Sequence[View]) -> DataFrame:
    """Points (_h, _t, _p, _f, ...) once for each view that takes them, with its response and keys: for nodes that no task can hold."""
    options = []
    for view in views:
        on = F.lit(True)
        if view.window:
            on = on & (F.col("_t") >= view.window[0]) & (F.col("_t") < view.window[1])
        if view.left_out is not None:
            on = on & (F.col("_f") != view.left_out)
        if view.bit is not None:
            on = on & (F.shiftright(F.col("_f").cast("bigint"), view.bit) % 2 == 1)
        response = F.col("_h")
        if view.wave:
            response = (F.sin if view.wave[1] else F.cos)(F.lit(2 * np.pi / view.wave[0]) * F.col("_p"))
        options.append(F.struct(on.alias("on"), response.alias("response"), *[F.lit(x).alias(k) for k, x in view.keys.items()]))
    fan = points.withColumn("_v", F.explode(F.filter(F.array(*options), lambda o: o["on"])))
    return fan.withColumn("_h", F.col("_v.response")).withColumns({k: F.col(f"_v.{k}") for k in views[0].keys}).drop("_v").where(F.col("_h").isNotNull())


def node_rates(
    points: DataFrame,
    nodes: DataFrame,
    p: RateParams = RateParams(),
    *,
    height: str = "h",
    time: str = "t_year",
    sigma: str | None = "s_elv",
    xy: tuple[str, str] = ("x", "y"),
    node_xy: tuple[str, str] = ("node_x", "node_y"),
    by: Sequence[str] = (),
    views: Sequence[View] = (View(),),
    fold: str | None = None,
    phase_time: str | None = None,
    limit: int = NODE_LIMIT,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Rate, acceleration, errors and covariance at each node, grouped also by ``by`` (columns of the points) and by the keys
    of ``views`` (windows, left-out folds, test responses or other rules). Nodes without enough rows or span are absent."""
    p = replace(p, radius=max((v.params or p).radius for v in views)) if views else p
    if not views:
        views = [View()]
        points = points.limit(0)
    keys = [*node_xy, *by, *views[0].keys]
    number = lambda c: (F.col(c) if c else F.lit(None)).cast("double")
    waves = all(v.wave for v in views)
    slim = points.where(F.col(time).isNotNull() & (F.lit(True) if waves else F.col(height).isNotNull())).select(
        *by, number(xy[0]).alias("_x"), number(xy[1]).alias("_y"), number(None if waves else height).alias("_h"), number(time).alias("_t"),
        number(phase_time or time).alias("_p"), (number(sigma) if sigma else F.lit(0.05)).alias("_s"), number(fold).alias("_f"),
    )
    spots = nodes.select(*[F.col(c).cast("double").alias(c) for c in node_xy]).distinct()
    hot = crowded(slim, spots, p.radius, limit, xy=("_x", "_y"), node_xy=node_xy)
    calm = spots if hot is None else spots.join(F.broadcast(hot), list(node_xy), "left_anti")
    fitted = fit_tiles(slim, calm, p, views, _design, node_xy=node_xy, by=by, fields=RATE_FIELDS, tile_rows=tile_rows)
    if hot is None:
        return fitted

    def typical() -> DataFrame:
        """Median stated sigma of each group, for rows that state none."""
        of = lambda q: radius_join(fan_out(slim, [v for v in views if (v.params or p) == q]).where(F.col("_s") > 0), hot, q.radius, xy=("_x", "_y"), node_xy=node_xy)
        return reduce(DataFrame.unionByName, [_sliced_quantiles(of(q).select(*keys, "_s"), keys, "_s", {"_s0": 0.5}).select(*keys, "_s0") for q in dict.fromkeys(v.params or p for v in views)])

    schema = result_schema(slim, node_xy, by, views, RATE_FIELDS)
    return fitted.unionByName(fit_in_passes(slim, hot, p, views, _design, node_xy=node_xy, by=by, schema=schema, typical=typical))


def time_windows(rows: DataFrame, windows: Sequence[tuple[float, float]], *, time: str = "t_year") -> DataFrame:
    """Each row once per half-open window that holds it: adds win_start, win_end.

    Windows are a literal array inside the plan, so the fan-out needs no join.
    """
    options = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in windows])
    held = F.filter(options, lambda w: (F.col(time) >= w["a"]) & (F.col(time) < w["b"]))
    return rows.withColumn("_w", F.explode(held)).withColumn("win_start", F.col("_w.a")).withColumn("win_end", F.col("_w.b")).drop("_w")


def moving_windows(width: float, step: float, t0: float, t1: float) -> list[tuple[float, float]]:
    """Windows that fit whole into [floor(t0), ceil(t1)]."""
    first, last = float(np.floor(t0)), float(np.ceil(t1))
    count = int(np.floor((last - first - width) / step + 1e-9)) + 1
    return [(first + i * step, first + i * step + width) for i in range(max(count, 0))]


def expanding_windows(start: float, min_width: float, t1: float) -> list[tuple[float, float]]:
    """Windows with a fixed start that grow by a year."""
    count = int(np.floor(float(np.ceil(t1)) - start - min_width + 1e-9)) + 1
    return [(float(start), float(start + min_width + i)) for i in range(max(count, 0))]


def window_rates(points: DataFrame, nodes: DataFrame, windows: Sequence[tuple[float, float]], p: RateParams = RateParams(), **kw) -> DataFrame:
    """The node fit per window; restrict ``nodes`` beforehand to skip unwanted ones."""
    return node_rates(points, nodes, p, views=[View({"win_start": float(a), "win_end": float(b)}, window=(a, b)) for a, b in windows], **kw)


def harmonic_leakage(
    points: DataFrame, nodes: DataFrame, p: RateParams, *, periods: Sequence[float] = (1.0, 0.5), time: str = "t_year",
    phase_time: str | None = None, **kw
) -> DataFrame:
    """How much of a unit seasonal cycle the estimator turns into a rate: R = hypot of the rates of
    pure cosine and sine heights at the real epochs. By linearity two phases give all phases."""
    views = [View({"period": float(q), "phase": c}, wave=(float(q), c)) for q in periods for c in (0, 1)]
    fits = node_rates(points, nodes, p, time=time, views=views, phase_time=phase_time, **kw)
    node = list(kw.get("node_xy", ("node_x", "node_y")))
    return (
        fits.groupBy(*node, "period")
        .agg(F.max(F.when(F.col("phase") == 0, F.col("dhdt"))).alias("r_cos"), F.max(F.when(F.col("phase") == 1, F.col("dhdt"))).alias("r_sin"),
             F.max("nobs").alias("nobs"))
        .withColumn("leakage", F.hypot("r_cos", "r_sin"))
    )


def predict_terms(coef: str, p: RateParams, dt: Column, u: Column, v: Column) -> Column:
    cols = basis_columns(p.terms, dt, u, v)
    return sum((F.element_at(coef, i + 1) * c for i, c in enumerate(cols.values())), F.lit(0.0))


def hindcast(
    points: DataFrame, nodes: DataFrame, cutoff: float, p: RateParams, *, height: str = "h", time: str = "t_year",
    xy: tuple[str, str] = ("x", "y"), node_xy: tuple[str, str] = ("node_x", "node_y"), limit: int = NODE_LIMIT, sigma: str | None = "s_elv",
) -> DataFrame:
    """Fit before the cutoff, predict every later row, against persistence (the same model without
    time). Per year: rows, both RMS, bias, lead, and the gain over persistence."""
    early = points.where(F.col(time) < cutoff)
    common = dict(height=height, time=time, xy=xy, node_xy=node_xy, limit=limit, sigma=sigma)
    both = [View({"model": 0}), View({"model": 1}, params=replace(p, time_order=0))]  # one fit of the same neighbourhoods
    fitted = node_rates(early, nodes, p, views=both, **common).groupBy(*node_xy)
    fits = fitted.agg(*[F.max(F.when(F.col("model") == k, F.col("coef"))).alias(c) for k, c in enumerate(("_ct", "_cs"))]).where("_ct is not null and _cs is not null")
    fits = cut(fits)  # a row a node, which rides along with its node: the pairs are not shuffled again
    late = radius_join(points.where(F.col(time) >= cutoff).select(*xy, height, time), fits, p.radius, xy=xy, node_xy=node_xy)
    dt, u, v = F.col(time) - p.t_ref, (F.col(xy[0]) - F.col(node_xy[0])) / p.radius, (F.col(xy[1]) - F.col(node_xy[1])) / p.radius
    scored = late.select(
        F.floor(time).cast("int").alias("year"), (F.col(time) - cutoff).alias("_lead"),
        (F.col(height) - predict_terms("_ct", p, dt, u, v)).alias("_e"),
        (F.col(height) - predict_terms("_cs", replace(p, time_order=0), dt, u, v)).alias("_e0"),
    )
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return (
        scored.groupBy("year")
        .agg(F.count(F.lit(1)).alias("n"), rms("_e").alias("rms_trend"), rms("_e0").alias("rms_still"), F.avg("_e").alias("bias"), F.avg("_lead").alias("lead"))
        .withColumn("gain", 1 - F.try_divide("rms_trend", "rms_still"))
    )


def project(fits: DataFrame, p: RateParams, epochs: Sequence[float], *, node_xy: Sequence[str] = ("node_x", "node_y"), z: float = 1.96) -> DataFrame:
    """Heights at the nodes at dates past the record: node_xy, epoch, height, sigma, low, high.

    The whole covariance of the terms in time goes to the date, so the interval opens with the distance from the
    reference epoch; it is the formal error of the model, not that of a change of regime.
    """
    k, pos = len(p.terms), {t: i for i, t in enumerate(p.terms)}
    dt = F.col("epoch") - p.t_ref
    gradient = {pos[t]: c for t, c in {"one": F.lit(1.0), "rate": dt, "accel": dt * dt / 2}.items() if t in pos}
    height = sum((F.element_at("coef", i + 1) * g for i, g in gradient.items()), F.lit(0.0))
    variance = sum((a * b * F.element_at("cov", i * k + j + 1) for i, a in gradient.items() for j, b in gradient.items()), F.lit(0.0))
    rows = fits.withColumn("epoch", F.explode(F.array(*[F.lit(float(e)) for e in epochs])))
    rows = rows.select(*node_xy, "epoch", height.alias("height"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sigma"))
    return rows.withColumn("low", F.col("height") - z * F.col("sigma")).withColumn("high", F.col("height") + z * F.col("sigma"))
