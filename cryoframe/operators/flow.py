"""Parcels carried by a velocity field, and rates that follow them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cryoframe.operators.blocks import line_fit
from cryoframe.operators.skew import group_quantiles
from cryoframe.operators.spatial import radius_join
from cryoframe.session import cut

#: Cells of a tile's side, and how far a parcel may travel from it before parcels are dealt out again.
TILE_CELLS, REACH_CELLS = 64, 16


def _steps(t0: float, t1: float, step_years: float) -> list[tuple[float, float]]:
    """(start, length) of equal steps from t0 towards t1, the last one shortened to end there."""
    span = t1 - t0
    count = max(int(math.ceil(abs(span) / step_years - 1e-12)), 0)
    signed = math.copysign(step_years, span)
    return [(t0 + k * signed, signed if k < count - 1 else span - k * signed) for k in range(count)]


class Sampler:
    """Bilinear velocity from arrays of a field's rows, for use inside a task."""

    def __init__(self, i, j, vx, vy, origin: tuple[float, float], step: float):
        self.i0, self.j0 = int(i.min()), int(j.min())
        shape = (int(i.max()) - self.i0 + 1, int(j.max()) - self.j0 + 1)
        self.grid = np.full((2, *shape), np.nan)
        self.grid[0, i - self.i0, j - self.j0] = vx
        self.grid[1, i - self.i0, j - self.j0] = vy
        self.origin, self.step = origin, step

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u, v = (x - self.origin[0]) / self.step - self.i0, (y - self.origin[1]) / self.step - self.j0
        a, b = np.floor(u), np.floor(v)
        fu, fv = u - a, v - b
        total = np.zeros((2, x.size))
        for di, wi in ((0, 1 - fu), (1, fu)):
            for dj, wj in ((0, 1 - fv), (1, fv)):
                w = wi * wj
                p, q = a + di, b + dj
                ok = (p >= 0) & (q >= 0) & (p < self.grid.shape[1]) & (q < self.grid.shape[2])
                corner = np.full((2, x.size), np.nan)
                corner[:, ok] = self.grid[:, p[ok].astype(int), q[ok].astype(int)]
                total += np.where(w > 0, corner * w, 0.0)
        return total


class Velocity:
    """A field at one or more epochs: linear between two of them, the first or last one outside."""

    def __init__(self, rows: pd.DataFrame, times: Sequence[float], origin: tuple[float, float], step: float):
        self.times = np.asarray(times, float)
        self.at = []
        for t in times:
            own = rows[rows["epoch"] == t]
            self.at.append(Sampler(*(own[c].to_numpy() for c in ("cell_i", "cell_j", "vx", "vy")), origin, step) if len(own) else None)

    def __call__(self, t: float, xy: np.ndarray) -> np.ndarray:
        place = float(np.interp(t, self.times, np.arange(self.times.size)))
        first = min(int(place), self.times.size - 1)
        share = place - first
        parts = [(1 - share, first)] + ([(share, first + 1)] if share > 0 else [])
        nowhere = np.full(xy.shape, np.nan)
        return sum(w * (self.at[k](*xy) if self.at[k] is not None else nowhere) for w, k in parts)


# Classical Runge-Kutta of fourth order: where in the step each slope is taken, and its weight.
STAGES = ((0.0, 1 / 6), (0.5, 1 / 3), (0.5, 1 / 3), (1.0, 1 / 6))


def advance(velocity: Velocity, x: np.ndarray, y: np.ndarray, t0: float, t1: float, step_years: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at ``t1`` of what is at (x, y) at ``t0``. Who leaves the field stays where it was and is marked."""
    place = np.stack([x, y]).astype(float)
    inside = np.isfinite(place).all(axis=0)
    for t, h in _steps(t0, t1, step_years):
        slope, move = np.zeros_like(place), np.zeros_like(place)
        for share, weight in STAGES:
            slope = velocity(t + share * h, place + share * h * slope)
            move += weight * h * slope
        inside &= np.isfinite(move).all(axis=0)
        place = np.where(inside, place + np.where(inside, move, 0.0), place)
    return place[0], place[1], inside


def _legs(t0: float, t1: float, most: float) -> list[tuple[float, float]]:
    """[t0, t1] in equal legs of at most ``most`` years."""
    count = max(1, math.ceil(abs(t1 - t0) / most - 1e-12))
    at = np.linspace(t0, t1, count + 1).tolist()
    return list(zip(at, at[1:], strict=False))


def trajectories(
    parcels: DataFrame, field: DataFrame, epochs: Sequence[float], t_ref: float, *, ids: Sequence[str], origin: tuple[float, float], step: float,
    dt_days: float = 20.0, tile_cells: int = TILE_CELLS, reach_cells: int = REACH_CELLS, parts: int = 1, xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """Position of each parcel at each epoch, from its place at ``t_ref``: ids, epoch, px, py, valid.

    ``field`` has cell_i, cell_j, vx, vy, and ``epoch`` where it varies in time. Field and parcels meet by tile; a tile's
    rows of the field include a margin that no parcel can cross in one leg, at the field's greatest speed. So a task
    holds one tile, whatever the field's extent, and only that speed and the field's epochs come to the driver. ``parts``
    splits the parcels of crowded tiles.
    """
    field = field if "epoch" in field.columns else field.withColumn("epoch", F.lit(0.0))
    fastest = field.agg(F.max(F.hypot("vx", "vy"))).first()[0]
    if fastest is None:
        raise ValueError("the velocity field is empty")
    times = sorted(r.epoch for r in field.select(F.col("epoch").cast("double").alias("epoch")).distinct().collect())
    most = reach_cells * step / fastest if fastest > 0 else math.inf
    margin = reach_cells + 2  # a bilinear corner and a half-step beyond the reach
    tiles_of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / tile_cells), F.floor((F.col(c) + margin) / tile_cells)))
    around = field.select("cell_i", "cell_j", "vx", "vy", F.col("epoch").cast("double").alias("epoch")).withColumn("tile_i", tiles_of("cell_i")).withColumn("tile_j", tiles_of("cell_j"))
    around = cut(around.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else around.withColumn("part", F.lit(0)))
    tile = lambda c, o: F.floor(F.floor((F.col(c) - o) / step) / tile_cells)
    keys, dt = ["tile_i", "tile_j", "part"], dt_days / 365.25
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parcels.select(*ids).schema.fields) + ", px double, py double, valid boolean"

    def leg(now: DataFrame, t0: float, t1: float) -> DataFrame:
        def run(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = mine[[*ids, "px", "py", "valid"]].copy()
            if len(mine):
                x, y, ok = advance(Velocity(rows, times, origin, step), mine["px"].to_numpy(float), mine["py"].to_numpy(float), t0, t1, dt)
                stays = out["valid"].to_numpy(bool)
                out["px"], out["py"], out["valid"] = np.where(stays, x, out["px"]), np.where(stays, y, out["py"]), stays & ok
            return out

        dealt = now.withColumn("tile_i", tile("px", origin[0])).withColumn("tile_j", tile("py", origin[1])).withColumn("part", F.pmod(F.xxhash64(*ids), F.lit(parts)).cast("int"))
        return cut(dealt.groupBy(*keys).cogroup(around.groupBy(*keys)).applyInPandas(run, schema))

    start = parcels.select(*ids, F.col(xy[0]).cast("double").alias("px"), F.col(xy[1]).cast("double").alias("py"), F.lit(True).alias("valid"))
    out = None
    for side in (sorted(e for e in epochs if e >= t_ref), sorted((e for e in epochs if e < t_ref), reverse=True)):
        now, at = start, t_ref
        for e in side:
            for t0, t1 in _legs(at, float(e), most):
                now = leg(now, t0, t1)
            at, part = float(e), now.withColumn("epoch", F.lit(float(e)))
            out = part if out is None else out.unionByName(part)
    return out.select(*ids, "epoch", "px", "py", "valid")


def lagrangian_rates(
    tracks: DataFrame, points: DataFrame, *, ids: Sequence[str], radius: float = 3000.0, height: str = "h", epoch: str = "epoch", min_epochs: int = 4, min_obs: int = 30,
    by: Sequence[str] = (), windows: Sequence[str] = (),
) -> DataFrame:
    """Rate following each parcel: per epoch the median height near the moved parcel, then a line.

    ``points`` carry ``epoch`` (and ``by``), so an epoch only meets its own positions. ``windows`` are columns of ``tracks``
    alone that repeat its epochs: a line a window, from medians that are found once.
    """
    moved = tracks.where("valid").select(*ids, *[b for b in by if b not in ids], epoch, F.col("px").alias("_px"), F.col("py").alias("_py"))
    moved = moved.distinct() if windows else moved
    near = radius_join(points.select("x", "y", height, epoch, *by), moved, radius, node_xy=("_px", "_py"), by=[epoch, *by])
    groups = [*ids, *[b for b in by if b not in ids]]
    med = group_quantiles(near, [*groups, epoch], height, {"_h": 0.5})
    if windows:
        med = cut(med).join(tracks.where("valid").select(*groups, epoch, *windows), [*groups, epoch])
        groups = [*groups, *windows]
    obs = med.groupBy(*groups).agg(F.sum("n").alias("n_obs"))
    fit = line_fit(med, groups, "_h", epoch, min_epochs=min_epochs)
    far = tracks.where("valid").groupBy(*groups).agg(
        F.hypot(F.max_by("px", epoch) - F.min_by("px", epoch), F.max_by("py", epoch) - F.min_by("py", epoch)).alias("displacement_m"))
    return (
        fit.join(obs.where(F.col("n_obs") >= min_obs), groups).join(far, groups, "left")
        .select(*groups, "n_epochs", "n_obs", F.col("slope").alias("dhdt_lagrangian"), F.col("slope_sigma").alias("dhdt_sigma"), "rmse", "t_center", "displacement_m")
    )
