"""Robust fits at many nodes at once, tile by tile.

A tile is four radii wide and holds the points of its core and of a halo of one radius, so a point is sent to 2.25 tiles
on average instead of to each of its nodes. One task fits all nodes of a tile: their neighbourhoods are rows of one table
of pairs that exists a part at a time, and sums, medians and rejections are taken over its segments. Windows, left-out
folds and test responses are views: masks and columns inside the task, not copies of the points.

A tile with too many points is cut into tiles of one radius. What those may hold is bounded by the caller, who fits nodes
with more points around them in another way.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cryoframe.operators.blocks import invert_normal, moved_terms, own_axes
from cryoframe.operators.spatial import cell
from cryoframe.session import cut

#: Width of a tile in radii, points from which a tile is cut up, and pairs that a task holds at a time.
WIDTH, TILE_ROWS, PAIRS = 4, 150_000, 400_000
#: Mean length of segments from which medians are taken one by one, and tasks a core, so that uneven tiles even out.
LONG, TASKS = 500, 4


@dataclass(frozen=True)
class View:
    """One fit of each neighbourhood: which rows it takes, what it fits to them, and the key values of its result."""

    keys: Mapping[str, float | int] = field(default_factory=dict)
    window: tuple[float, float] | None = None  # times from the first up to, not including, the second
    left_out: int | None = None  # rows of this fold do not take part
    bit: int | None = None  # rows take part whose fold column, read as bits, has this one set
    params: Any = None  # rules of its own; its radius is at most that of the whole
    wave: tuple[float, int] | None = None  # a pure cosine (0) or sine (1) of this period instead of the heights

    def rows(self, t: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
        on = np.ones(len(t), bool)
        if self.window:
            on &= (t >= self.window[0]) & (t < self.window[1])
        if self.left_out is not None:
            on &= fold != self.left_out
        if self.bit is not None:
            on &= (fold.astype(np.int64) >> self.bit) & 1 == 1
        return on

    def response(self, h: np.ndarray | None, phase: np.ndarray) -> np.ndarray:
        if self.wave is None:
            return h
        return (np.sin if self.wave[1] else np.cos)(2 * np.pi / self.wave[0] * phase)


# --- segments of sorted owners ----------------------------------------------


def starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)


def medians(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Median of each segment."""
    first = starts(owner)
    n = np.diff(np.append(first, len(owner)))
    if len(values) > LONG * len(first):  # only the middle of a long segment is put in order
        middle = lambda v: np.partition(v, ((len(v) - 1) // 2, len(v) // 2))[[(len(v) - 1) // 2, len(v) // 2]]
        two = np.stack([middle(values[i : i + m]) for i, m in zip(first, n, strict=True)])
        return (two[:, 0] + two[:, 1]) / 2
    v = values[np.lexsort((values, owner))]
    return (v[first + (n - 1) // 2] + v[first + n // 2]) / 2


def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Number of distinct whole numbers of each segment."""
    first = starts(owner)
    if not len(first):
        return np.zeros(0, np.int64)
    low, n = values.min(), np.diff(np.append(first, len(owner)))
    wide = int(values.max() - low) + 1
    if len(first) * wide > 8 * len(values) + 1024:
        v = values[np.lexsort((values, owner))]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        new[first] = True
        return np.add.reduceat(new.astype(np.int64), first)
    there = np.bincount(np.repeat(np.arange(len(first)) * wide, n) + (values - low), minlength=len(first) * wide) > 0
    return there.reshape(-1, wide).sum(axis=1)


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all whole numbers in the ranges."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


# --- fit --------------------------------------------------------------------


def fit_segments(p, n_nodes: int, owner, h, t, u, v, s, design) -> dict[str, np.ndarray]:
    """The robust weighted fit of each owner's rows (``owner`` ascending): coef, cov, rmse, nobs, tspan, years; NaN where there is none."""
    k = len(p.terms)
    out = {"coef": np.full((n_nodes, k), np.nan), "cov": np.full((n_nodes, k, k), np.nan), "rmse": np.full(n_nodes, np.nan)}
    out |= {"nobs": np.zeros(n_nodes, np.int64), "tspan": np.zeros(n_nodes), "years": np.zeros(n_nodes, np.int64)}
    first = starts(owner)
    if not len(first):
        return out
    ids, n = owner[first], np.diff(np.append(first, len(owner)))
    span = np.maximum.reduceat(t, first) - np.minimum.reduceat(t, first)
    out["tspan"][ids] = span
    enough = np.repeat((n >= p.min_points) & (span >= p.min_span), n)
    owner, h, t, u, v, s = (x[enough] for x in (owner, h, t, u, v, s))
    if not len(owner):
        return out
    w = np.ones(len(owner))
    if p.weighted:
        stated = s > 0
        typical = np.full(n_nodes, 0.05)
        if stated.any():
            typical[owner[stated][starts(owner[stated])]] = medians(s[stated], owner[stated])
        w = 1.0 / (np.where(stated, s, typical[owner]) ** 2 + 1e-12)
    first, axes = starts(owner), (t - p.t_ref, u, v)
    middle, half = own_axes(*(np.stack([f.reduceat(x, first) for x in axes], 1) for f in (np.minimum, np.maximum)))
    place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    back = np.zeros((n_nodes, k, k))
    back[owner[first]] = moved_terms(p.terms, middle, half)
    # A term is a row: sums run over neighbours in memory.
    a = np.ascontiguousarray(design(p.terms, *((x - middle[place, i]) / half[place, i] for i, x in enumerate(axes))).T)
    year = np.floor(t).astype(np.int64)

    def close(on: np.ndarray) -> None:
        """What is left of nodes that need no further round."""
        done, when = owner[on], year[on]
        begin = starts(done)
        out["nobs"][done[begin]] = np.diff(np.append(begin, len(done)))
        out["years"][done[begin]] = distinct(when, done)

    for last in [False] * (p.rounds - 1) + [True]:
        first = starts(owner)
        ids, n = owner[first], np.diff(np.append(first, len(owner)))
        each = lambda x: np.repeat(x, n)  # noqa: B023, E731
        aw = a * (w * each(n / np.add.reduceat(w, first)))
        left = np.zeros((len(ids), k, k))
        for i in range(k):
            for j in range(i, k):
                left[:, i, j] = left[:, j, i] = np.add.reduceat(aw[i] * a[j], first)
        right = np.stack([np.add.reduceat(x * h, first) for x in aw], axis=1)
        coef, inverse, _ = invert_normal(left, right, n >= k + 2)
        good = ~np.isnan(coef).any(axis=1)
        r = h.copy()
        for c, x in zip(np.nan_to_num(coef).T, a, strict=True):
            r -= each(c) * x
        rr, mean = np.add.reduceat(r * r, first), np.add.reduceat(r, first) / n
        at = ids[good]
        out["coef"][at], out["rmse"][at] = np.einsum("mi,mij->mj", coef[good], back[at]), np.sqrt(np.maximum(np.add.reduceat((r - each(mean)) ** 2, first) / n, 0))[good]
        out["cov"][at] = back[at].transpose(0, 2, 1) @ inverse[good] @ back[at] * (rr / np.maximum(n - k, 1))[good][:, None, None]
        mad = 1.4826 * medians(np.abs(r - each(medians(r, owner))), owner)
        wild = np.abs(r) > each(np.where(good & (mad >= 1e-10), np.minimum(p.n_sigma * mad, p.residual_limit), np.inf))
        going = each(np.add.reduceat(wild, first, dtype=np.int64) > 0)
        close(~going)
        stay = going & ~wild
        if last:
            close(stay)
        if last or not stay.any():
            break
        owner, h, t, w, year = (x[stay] for x in (owner, h, t, w, year))
        a = np.compress(stay, a, axis=1)
    return out


class Buckets:
    """Points of a tile in square buckets as wide as the radius."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float):
        self.radius, self.x0, self.y0 = radius, x.min(), y.min()
        i, j = self.place(x, y)
        self.rows = int(j.max()) + 3
        key = (i + 1) * self.rows + j + 1
        self.order = np.argsort(key, kind="stable")
        self.key, self.x, self.y = key[self.order], x[self.order], y[self.order]

    def place(self, x, y):
        return np.floor((x - self.x0) / self.radius).astype(np.int64), np.floor((y - self.y0) / self.radius).astype(np.int64)

    def pairs(self, nx: np.ndarray, ny: np.ndarray, most: int = PAIRS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first node, last node + 1, number of the node, place of the point) of some nodes at a time, nodes ascending."""
        i, j = self.place(nx, ny)
        j = np.clip(j, -2, self.rows)
        low, high = [], []
        for d in (-1, 0, 1):  # three neighbouring buckets of a column lie beside each other
            base = (i + d + 1) * self.rows
            low.append(np.searchsorted(self.key, base + np.clip(j, 0, self.rows - 1)))
            high.append(np.searchsorted(self.key, base + np.clip(j + 2, -1, self.rows - 1), "right"))
        low, high = np.stack(low, 1), np.stack(high, 1)
        high = np.maximum(low, high)
        load = np.cumsum((high - low).sum(1))
        at = 0
        while at < len(nx):
            base = load[at - 1] if at else 0
            end = max(int(np.searchsorted(load, base + most, "right")), at + 1)
            which, place = ranges(low[at:end].ravel(), high[at:end].ravel())
            which //= 3
            d2 = (self.x[place] - nx[at + which]) ** 2 + (self.y[place] - ny[at + which]) ** 2
            near = d2 <= self.radius * self.radius
            yield at, end, which[near], self.order[place[near]]
            at = end


RESULT = ["p0", "dhdt", "accel", "p0_err", "dhdt_err", "accel_err", "rmse", "nobs", "tspan", "coef", "cov"]


def shape(p, fit: Mapping[str, np.ndarray]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(nodes that are accepted, their columns)."""
    pos = {t: i for i, t in enumerate(p.terms)}
    coef, err = fit["coef"], np.sqrt(np.maximum(np.einsum("mii->mi", fit["cov"]), 0))
    ok = ~np.isnan(coef).any(axis=1) & (fit["nobs"] >= p.min_points)
    if "rate" in pos:
        ok &= ~(np.abs(coef[:, pos["rate"]]) > p.rate_limit)
    at = np.flatnonzero(ok)
    none = np.full(len(at), np.nan)
    take = lambda of, term: of[at, pos[term]] if term in pos else none
    steep = take(coef, "accel")
    kept = (fit["years"][at] >= p.min_years_accel) & (np.abs(steep) <= p.accel_limit)
    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    lists = lambda x: pa.array(list(x.reshape(len(at), int(np.prod(x.shape[1:])))), pa.list_(pa.float64()))
    columns = {
        "p0": number(take(coef, "one")), "dhdt": number(take(coef, "rate")), "accel": number(np.where(kept, steep, np.nan)),
        "p0_err": number(take(err, "one")), "dhdt_err": number(take(err, "rate")), "accel_err": number(np.where(kept, take(err, "accel"), np.nan)),
        "rmse": number(fit["rmse"][at]), "nobs": pa.array(fit["nobs"][at]), "tspan": number(fit["tspan"][at]), "coef": lists(coef[at]), "cov": lists(fit["cov"][at]),
    }
    return at, columns


# --- tiles ------------------------------------------------------------------


def _tiles_of(points: DataFrame, nodes: DataFrame, radius: float, node_xy: Sequence[str], tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(points, nodes), each with _l, _i, _j: the level and place of the tile. Points come once for each tile whose core or halo holds them."""
    wide, reach = WIDTH * radius, radius * (1 + 1e-9)
    span = lambda c, size: F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size))
    homes = nodes.withColumn("_i", cell(node_xy[0], wide)).withColumn("_j", cell(node_xy[1], wide))
    # Tiles without a node get no points: where all nodes of a place are fitted otherwise, no task reads that place.
    held = F.broadcast(homes.select("_i", "_j").distinct())
    copies = points.withColumn("_i", F.explode(span("_x", wide))).withColumn("_j", F.explode(span("_y", wide))).join(held, ["_i", "_j"], "left_semi")
    level = lambda df, n: df.withColumn("_l", F.lit(n))
    dense = copies.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile_rows).drop("_n")
    dense = cut(dense)  # at most 2.25 rows / tile_rows
    if dense.isEmpty():
        return level(copies, 0), level(homes, 0)
    split = lambda df, how: df.join(F.broadcast(dense), ["_i", "_j"], how)
    homes_fine = split(homes, "left_semi").withColumn("_i", cell(node_xy[0], radius)).withColumn("_j", cell(node_xy[1], radius))
    spots = F.broadcast(homes_fine.select("_i", "_j").distinct())  # small tiles with nodes; a point is copied to those straight away
    fine = points.withColumn("_i", F.explode(span("_x", radius))).withColumn("_j", F.explode(span("_y", radius))).join(spots, ["_i", "_j"], "left_semi")
    columns = level(copies, 0).columns
    return (
        level(split(copies, "left_anti"), 0).select(columns).unionByName(level(fine, 1).select(columns)),
        level(split(homes, "left_anti"), 0).unionByName(level(homes_fine, 1)),
    )


def result_schema(points: DataFrame, node_xy: Sequence[str], by: Sequence[str], views: Sequence[View], fields: str) -> str:
    """Nodes, by, the views' keys and the fields of a fit."""
    of_by = [f"{c} {points.schema[c].dataType.simpleString()}" for c in by]
    return ", ".join([*(f"{c} double" for c in node_xy), *of_by, *(f"{k} {'double' if isinstance(x, float) else 'int'}" for k, x in views[0].keys.items()), fields])


def fit_tiles(points: DataFrame, nodes: DataFrame, p, views: Sequence[View], design, *, node_xy: Sequence[str], by: Sequence[str], fields: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Fits of all views at all ``nodes`` (distinct) from points (_x, _y, _h, _t, _p, _s, _f, *by): node_xy, by, the views' keys and RESULT."""
    node_xy, by, names = list(node_xy), list(by), list(views[0].keys)
    kinds = {k: pa.float64() if isinstance(x, float) else pa.int32() for k, x in views[0].keys.items()}
    schema = result_schema(points, node_xy, by, views, fields)
    kind = {"nobs": pa.int64(), "coef": pa.list_(pa.float64()), "cov": pa.list_(pa.float64())}
    spread, homes = _tiles_of(points, nodes, p.radius, node_xy, tile_rows)

    def run(home: pa.Table, near: pa.Table) -> pa.Table:
        tables = []
        nx, ny = (np.asarray(home.column(c), np.float64) for c in node_xy)
        for some in _apart(near, by) if len(home) and len(near) else ():
            col = {c: np.asarray(some.column(c).to_numpy(zero_copy_only=False), np.float64) for c in ("_x", "_y", "_h", "_t", "_p", "_s", "_f")}
            for low, high, owner, at in Buckets(col["_x"], col["_y"], p.radius).pairs(nx, ny):
                dx, dy = col["_x"][at] - nx[low + owner], col["_y"][at] - ny[low + owner]
                for view in views:
                    q = view.params or p
                    on = view.rows(col["_t"][at], col["_f"][at])
                    if q.radius < p.radius:
                        on &= dx * dx + dy * dy <= q.radius * q.radius
                    z = view.response(col["_h"][at], col["_p"][at])
                    on &= ~np.isnan(z)
                    x = at[on]
                    fit = fit_segments(q, high - low, owner[on], z[on], col["_t"][x], dx[on] / q.radius, dy[on] / q.radius, col["_s"][x], design)
                    kept, columns = shape(q, fit)
                    keys = {c: pa.array(w[low + kept]) for c, w in zip(node_xy, (nx, ny), strict=True)}
                    keys |= {c: some.column(c)[:1].combine_chunks().take(pa.array(np.zeros(len(kept), np.int64))) for c in by}
                    keys |= {k: pa.array(np.full(len(kept), view.keys[k]), kinds[k]) for k in names}
                    tables.append(pa.table(keys | columns))
        if tables:
            return pa.concat_tables(tables)
        held = {c: pa.float64() for c in node_xy} | {c: near.schema.field(c).type for c in by} | kinds | {c: kind.get(c, pa.float64()) for c in RESULT}
        return pa.table({c: pa.array([], t) for c, t in held.items()})

    tile = ["_l", "_i", "_j"]
    n = max(TASKS * points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A number of tasks of its own: by the bytes of its points a tile looks small, and several would be put into one task.
    homes, spread = (df.repartition(n, *tile) for df in (homes, spread))
    return homes.groupBy(*tile).cogroup(spread.groupBy(*tile)).applyInArrow(run, schema)


def _apart(table: pa.Table, by: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each value of ``by``."""
    if not by:
        yield table
        return
    table = table.sort_by([(c, "ascending") for c in by])
    changes = np.zeros(len(table), bool)
    for c in by:
        codes = np.asarray(table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices)
        changes[1:] |= codes[1:] != codes[:-1]
    first = np.concatenate([[0], np.flatnonzero(changes), [len(table)]])
    for i, j in zip(first[:-1], first[1:], strict=True):
        yield table.slice(i, j - i)
