"""Robust fits at nodes whose neighbourhoods no task can hold, in passes over the points.

No pair of a point and a node is ever a row. The points lie ordered by place; a pass reads them in runs, forms the pairs of
a run inside the task and hands on sums, counts or a few values a group (a node, a value of ``by``, a view). A round of the
fit takes three passes: the sums of the normal equations; counts of the residuals in equal bins, which bracket both the
median and the median deviation from it; the values inside the brackets, which settle both exactly. The runs are written
once as blocks of numbers, so that a pass does not turn every row into columns again. Which rows earlier
rounds have rejected follows from their coefficients and thresholds, so no state of the pairs is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cryoframe.operators.blocks import invert_normal, moved_terms, own_axes
from cryoframe.operators.spatial import cell
from cryoframe.operators.tilefit import RESULT, View, shape
from cryoframe.session import cut

#: Rows of a run, bins of a group, groups that a task holds before it hands them on, rows of a partition, and the share of
#: a group's rows inside its brackets from which the bins are made finer first.
RUN, BINS, HELD, PART_ROWS, FINER = 1 << 17, 4096, 2000, 1_000_000, 0.05
COLUMNS = ("_x", "_y", "_h", "_t", "_p", "_s", "_f", "_c")


class Plan:
    """Nodes, views and rules, and what the rounds so far have found: shipped with each pass."""

    def __init__(self, nodes: np.ndarray, codes: int, views: Sequence[View], p, design: Callable):
        self.nodes, self.codes, self.views, self.p, self.design = nodes, codes, list(views), p, design
        self.active = np.ones(len(nodes) * codes * len(self.views), bool)
        self.read = {"_x", "_y", "_t", "_s"}  # columns that codes and views ask for
        self.read |= {c for c, on in (("_c", codes > 1), ("_f", any(v.left_out is not None or v.bit is not None for v in self.views))) if on}
        self.read |= {"_h" if v.wave is None else "_p" for v in self.views}
        self.order = [c for c in COLUMNS if c in self.read]
        self.typical: dict[int, float] = {}
        self.years: dict[int, tuple[int, int]] = {}  # first year and number of years
        self.axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # middle and half width of the rows' t, u and v
        self.found: dict[int, list[tuple[np.ndarray, float]]] = {}  # coefficients of the moved terms and threshold of each round

    def rules(self, g: int):
        return self.views[g % len(self.views)].params or self.p

    def basis(self, g: int, rows: dict) -> list[np.ndarray]:
        q, (middle, half) = self.rules(g), self.axes[g]
        t, u, v = ((x - m) / w for x, m, w in zip((rows["t"] - q.t_ref, rows["u"], rows["v"]), middle, half, strict=True))
        return list(np.ascontiguousarray(self.design(q.terms, t, u, v).T))

    def groups(self, col: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """Each group's rows in a run of points."""
        x, y, radius = col["_x"], col["_y"], self.p.radius
        nx, ny = self.nodes[:, 0], self.nodes[:, 1]
        reach = radius * (1 + 1e-9)
        near = (nx >= x.min() - reach) & (nx <= x.max() + reach) & (ny >= y.min() - reach) & (ny <= y.max() + reach)
        per = self.codes * len(self.views)
        for i in np.flatnonzero(near):
            if not self.active[i * per : (i + 1) * per].any():
                continue
            d2 = (x - nx[i]) ** 2 + (y - ny[i]) ** 2
            at = np.flatnonzero(d2 <= radius * radius)
            if not len(at):
                continue
            held = {c: a[at] for c, a in col.items() if c in self.read}
            dx, dy, d2 = held["_x"] - nx[i], held["_y"] - ny[i], d2[at]
            for code in np.unique(held["_c"]) if self.codes > 1 else (0,):
                for k, view in enumerate(self.views):
                    g = int((i * self.codes + code) * len(self.views) + k)
                    if not self.active[g]:
                        continue
                    q = view.params or self.p
                    on = view.rows(held["_t"], held.get("_f"))
                    if self.codes > 1:
                        on &= held["_c"] == code
                    if q.radius < radius:
                        on &= d2 <= q.radius * q.radius
                    h = view.response(held.get("_h"), held.get("_p"))
                    on &= ~np.isnan(h)
                    rows = {"h": h, "t": held["_t"], "s": held["_s"], "u": dx / q.radius, "v": dy / q.radius}
                    if on.all():
                        yield g, rows
                    elif on.any():
                        yield g, {c: a[on] for c, a in rows.items()}

    def live(self, g: int, rows: dict) -> tuple[list[np.ndarray], dict]:
        """Basis and rows that no earlier round has rejected."""
        a = self.basis(g, rows)
        on = np.ones(len(rows["h"]), bool)
        for coef, limit in self.found.get(g, ()):
            if np.isfinite(limit):
                on &= np.abs(residual(a, rows["h"], coef)) <= limit
        return ([c[on] for c in a], {k: x[on] for k, x in rows.items()}) if not on.all() else (a, rows)

    def weights(self, g: int, s: np.ndarray) -> np.ndarray:
        if not self.rules(g).weighted:
            return np.ones(len(s))
        return 1.0 / (np.where(s > 0, s, self.typical.get(g, 0.05)) ** 2 + 1e-12)


def residual(a: Sequence[np.ndarray], h: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Term by term, so that a row's residual is the same number in each pass."""
    r = h.copy()
    for c, x in zip(a, coef, strict=True):
        r -= c * x
    return r


def _pass(points: DataFrame, plan: Plan, each: Callable, add: Callable, settle: Callable) -> dict[int, np.ndarray]:
    """``each`` group of a run gives numbers, a task adds them up, ``settle`` makes a short result a group of all tasks' numbers."""

    def run(batches):
        acc: dict[int, np.ndarray] = {}

        def flush():
            keys = list(acc)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([acc[g].tobytes() for g in keys], pa.binary())], ["g", "blob"])
            acc.clear()
            return out

        for col in _unpacked(batches, plan.order):
            for g, rows in plan.groups(col):
                new = each(g, rows)
                if new is not None:
                    acc[g] = add(acc[g], new) if g in acc else new
            if len(acc) >= HELD or sum(x.nbytes for x in acc.values()) > 64 << 20:
                yield flush()
        if acc:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        blobs = sorted(table.column("blob").to_pylist())  # sums do not depend on the order in which they arrive
        return pa.table({"g": pa.array([g], pa.int64()), "blob": pa.array([settle(g, [np.frombuffer(b) for b in blobs]).tobytes()], pa.binary())})

    got = points.mapInArrow(run, "g bigint, blob binary").groupBy("g").applyInArrow(merge, "g bigint, blob binary").collect()
    return {r.g: np.frombuffer(r.blob) for r in sorted(got, key=lambda r: r.g)}


def _runs(batches) -> Iterator[dict[str, np.ndarray]]:
    held: list[pa.RecordBatch] = []

    def columns():
        table = pa.Table.from_batches(held)
        return {c: table.column(c).to_numpy().astype(np.int64 if c == "_c" else np.float64) for c in COLUMNS}

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= RUN:
            yield columns()
            held = []
    if held:
        yield columns()


def _packed(points: DataFrame, order: Sequence[str]) -> DataFrame:
    """Runs of points, a row each: what a pass reads moves as blocks of numbers, not as rows that are turned round again."""

    def run(batches):
        for col in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([col[c].astype(np.float64) for c in order]).tobytes()], pa.binary())], ["run"])

    return points.mapInArrow(run, "run binary")


def _unpacked(batches, order: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for blob in batch.column(0):
            yield dict(zip(order, np.frombuffer(blob.as_buffer()).reshape(len(order), -1), strict=True))


def _frame(points: DataFrame, plan: Plan) -> dict[int, np.ndarray]:
    """Rows, rows without a stated sigma, least t, u and v, greatest t, u and v."""
    each = lambda g, rows: np.array([len(rows["h"]), (~(rows["s"] > 0)).sum(), *(f(rows[c]) for f in (np.min, np.max) for c in "tuv")], float)
    add = lambda a, b: np.concatenate([a[:2] + b[:2], np.minimum(a[2:5], b[2:5]), np.maximum(a[5:], b[5:])])

    def settle(_, parts):
        out = parts[0]
        for b in parts[1:]:
            out = add(out, b)
        return out

    return _pass(points, plan, each, add, settle)


def _sums(points: DataFrame, plan: Plan) -> dict[int, np.ndarray]:
    """n, sum of weights, weighted sum of squares, upper triangle, right-hand side, rows of each year."""

    def each(g, rows):
        a, rows = plan.live(g, rows)
        if not len(rows["h"]):
            return None
        w, m = plan.weights(g, rows["s"]), np.stack(a)
        left, right = (m * w) @ m.T, m @ (w * rows["h"])
        first, years = plan.years[g]
        counts = np.bincount(np.floor(rows["t"]).astype(np.int64) - first, minlength=years)
        return np.concatenate([[len(w), w.sum(), (w * rows["h"] ** 2).sum()], left[np.triu_indices(len(a))], right, counts])

    return _pass(points, plan, each, lambda a, b: a + b, lambda _, parts: np.sum(parts, axis=0))


def bin_of(r: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bin of each value; -1 below all bins and BINS above them."""
    with np.errstate(invalid="ignore", over="ignore"):
        b = np.floor((r - low) * (BINS / (high - low)))
    return np.clip(b, -1, BINS).astype(np.int64)


def bracket(below: float, counts: np.ndarray, n: int) -> tuple[int, int, int, int, float, float] | None:
    """(first and last bin of the median, inner and outer reach of the deviation in bins, rows below the median's bins,
    rows inside the inner reach), or None if the bins do not hold them."""
    upto = below + np.concatenate([[0], np.cumsum(counts)])  # rows below each edge
    first, last = (int(np.searchsorted(upto, k, "right")) - 1 for k in ((n - 1) // 2, n // 2))
    if first < 0 or last >= BINS:
        return None
    furthest = min(first, BINS - 1 - last)  # reaches up to here lie inside the bins

    def between(a, b):  # rows of bins a to b
        return np.where(b >= a, upto[np.clip(b + 1, 0, BINS)] - upto[np.clip(a, 0, BINS)], 0)

    reach = np.arange(furthest + 1)
    sure, maybe = between(last + 1 - reach, first + reach - 1), between(first - reach, last + reach)
    outer = int(np.searchsorted(sure, n // 2 + 1))  # both middle deviations are surely within it
    inner = int(np.searchsorted(maybe, (n - 1) // 2, "right")) - 1  # and surely not within this
    outer, inner = outer + 1, max(inner - 1, 0)  # a bin for rounding
    if outer > furthest:
        return None
    return first, last, inner, outer, float(upto[first]), float(between(last + 1 - inner, first + inner - 1))


def wanted(b: np.ndarray, marks) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the median's bins, and rows between the two reaches."""
    first, last, inner, outer = (int(x) for x in marks[:4])
    core = (b >= last + 1 - inner) & (b <= first + inner - 1)
    return (b >= first) & (b <= last), (b >= first - outer) & (b <= last + outer) & ~core


def _brackets(points: DataFrame, plan: Plan, coefs: dict[int, np.ndarray], limits: dict[int, tuple[float, float]], n: dict[int, int]):
    """(marks, limits, moments) of each group: bins are shifted, widened or made finer until they bracket both medians."""
    marks, ranges, moments, todo, before = {}, {}, {}, dict(limits), plan.active
    while todo:
        def each(g, rows):
            a, rows = plan.live(g, rows)
            if not len(rows["h"]):
                return None
            r = residual(a, rows["h"], coefs[g])
            counts = np.bincount(bin_of(r, *todo[g]) + 1, minlength=BINS + 2)  # noqa: B023
            return np.concatenate([[r.sum(), (r * r).sum()], counts])

        def settle(g, parts):
            s = np.sum(parts, axis=0)
            counts = s[3:-1]
            found = bracket(s[2], counts, n[g])
            at = int(np.searchsorted(s[2] + np.cumsum(counts), (n[g] - 1) // 2, "right"))  # bin of the median, or past the bins
            at = -1 if s[2] > (n[g] - 1) // 2 else at
            if found is None:
                return np.array([s[0], s[1], 0, at])
            b = np.arange(BINS)
            one, two = wanted(b, found)
            return np.array([s[0], s[1], 1, at, *found, counts[one | two].sum()])

        plan.active = np.zeros(len(before), bool)
        plan.active[list(todo)] = True
        again = {}
        for g, x in _pass(points, plan, each, lambda a, b: a + b, settle).items():
            moments[g] = x[:2]
            low, high = todo[g]
            width = (high - low) / BINS
            if not x[2]:  # the median is outside, or its surroundings are
                if x[3] < 0 or x[3] >= BINS:
                    again[g] = (low - 8 * (high - low), high + 8 * (high - low))
                else:
                    middle, half = low + (x[3] + 0.5) * width, 2 * (high - low)
                    again[g] = (middle - half, middle + half)
                continue
            first, last, _, outer = x[4:8]
            fine = (low + (first - outer - 2) * width, low + (last + outer + 3) * width)
            tiny = fine[1] - fine[0] <= 1e-12 * max(abs(low), abs(high))
            if x[10] > FINER * n[g] and x[10] > 10_000 and fine[1] - fine[0] < (high - low) / 4 and not tiny:
                again[g] = fine
            else:
                marks[g], ranges[g] = x[4:10], (low, high)
        todo = again
    plan.active = before
    return marks, ranges, moments


def _medians(points: DataFrame, plan: Plan, coefs, marks, ranges, n) -> dict[int, float]:
    """The scaled median deviation of each group's residuals from their median."""

    def each(g, rows):
        a, rows = plan.live(g, rows)
        r = residual(a, rows["h"], coefs[g])
        one, two = wanted(bin_of(r, *ranges[g]), marks[g])
        values, counts = np.unique(r[one | two], return_counts=True)
        return np.concatenate([values, counts]).reshape(2, -1) if len(values) else None

    def settle(g, parts):
        values, counts = (np.concatenate(x) for x in zip(*(b.reshape(2, -1) for b in parts), strict=True))
        one, two = wanted(bin_of(values, *ranges[g]), marks[g])
        middle = np.array([(n[g] - 1) // 2, n[g] // 2])
        median = _pick(values[one], counts[one], middle - marks[g][4])
        return np.array([1.4826 * _pick(np.abs(values[two] - median), counts[two], middle - marks[g][5])])

    return {g: float(x[0]) for g, x in _pass(points, plan, each, lambda a, b: np.concatenate([a, b], axis=1), settle).items()}


def _pick(values: np.ndarray, counts: np.ndarray, places: np.ndarray) -> float:
    """Mean of the values at two places of the ordered rows."""
    order = np.argsort(values, kind="stable")
    at = np.searchsorted(np.cumsum(counts[order]), places, "right")
    return float(values[order][at].mean())


def fit_in_passes(points: DataFrame, hot: DataFrame, p, views: Sequence[View], design, *, node_xy: Sequence[str], by: Sequence[str], schema: str, typical: Callable) -> DataFrame:
    """Fits of all views at the nodes ``hot`` from points (_x, _y, _h, _t, _p, _s, _f, *by), as :func:`tilefit.fit_tiles` gives them.

    ``typical`` gives the median stated sigma of the groups, for those that have rows without one.
    """
    spark, node_xy, by, names = points.sparkSession, list(node_xy), list(by), list(views[0].keys)
    nodes = sorted((r[0], r[1]) for r in hot.select(*node_xy).collect())
    at = lambda c, i: (cell(c, p.radius) + F.col(f"_o.{i}")).alias(f"_b{i}")
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = hot.withColumn("_o", F.explode(shifts)).select(at(node_xy[0], "i"), at(node_xy[1], "j")).distinct()
    near = points.withColumn("_bi", cell("_x", p.radius)).withColumn("_bj", cell("_y", p.radius)).join(F.broadcast(around), ["_bi", "_bj"], "left_semi")
    values = sorted((tuple(r) for r in near.select(*by).distinct().collect()), key=str) if by else [()]
    if by:
        codes = spark.createDataFrame([(*v, i) for i, v in enumerate(values)], near.select(*by).schema.add("_c", IntegerType()))
        a, b = near.alias("a"), F.broadcast(codes).alias("b")
        near = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]).select("a.*", "b._c")
    else:
        near = near.withColumn("_c", F.lit(0))
    parts = max(2 * spark.sparkContext.defaultParallelism, near.count() // PART_ROWS + 1)
    plan = Plan(np.array(nodes, float).reshape(-1, 2), max(len(values), 1), views, p, design)
    place = ["_bi", "_bj", "_x", "_y", F.xxhash64("_t", "_h", "_s")]  # points at one place are spread, too
    near = near.select("_bi", "_bj", *COLUMNS).repartitionByRange(parts, *place).sortWithinPartitions("_bi", "_bj")
    near = cut(_packed(near.select(*COLUMNS), plan.order))
    frame = _frame(near, plan)
    plan.active[:] = False
    for g, x in frame.items():
        q, n, first, last = plan.rules(g), x[0], x[2], x[5]
        plan.axes[g] = own_axes(*(x[i : i + 3] - np.array([q.t_ref, 0, 0]) for i in (2, 5)))
        plan.active[g] = n >= q.min_points and last - first >= q.min_span
        plan.years[g] = int(np.floor(first)), int(np.floor(last)) - int(np.floor(first)) + 1
    if any(frame[g][1] and plan.rules(g).weighted for g in np.flatnonzero(plan.active)):
        place_of, code_of = {xy: i for i, xy in enumerate(nodes)}, {v: i for i, v in enumerate(values)}
        view_of = {tuple(v.keys.values()): k for k, v in enumerate(views)}
        for r in typical().collect():
            g = (place_of[r[0], r[1]] * plan.codes + code_of[tuple(r[2 : 2 + len(by)])]) * len(views) + view_of[tuple(r[2 + len(by) : -1])]
            plan.typical[g] = r[-1]

    fits: dict[int, dict] = {}
    rows_before: dict[int, int] = {}
    for turn in range(max((v.params or p).rounds for v in views) + 1):
        if not plan.active.any():
            break
        coefs, limits, left_over, inverses = {}, {}, {}, {}
        sums = _sums(near, plan)
        for g in np.flatnonzero(plan.active):
            q, k = plan.rules(g), len(plan.rules(g).terms)
            s = sums.get(int(g))
            if s is None:  # all rows rejected
                fits[g] |= {"nobs": 0, "years": 0}
                plan.active[g] = False
                continue
            n, sw, whh, tri, right, years = int(s[0]), s[1], s[2], s[3 : 3 + k * (k + 1) // 2], s[3 + k * (k + 1) // 2 :][:k], s[3 + k * (k + 1) // 2 + k :]
            if g in fits:
                fits[g] |= {"nobs": n, "years": int((years > 0).sum())}
            if turn >= q.rounds or rows_before.get(g) == n:  # the rounds are over, or the last one has rejected nothing
                plan.active[g] = False
                continue
            left = np.zeros((k, k))
            left[np.triu_indices(k)] = tri
            left = left + left.T - np.diag(np.diag(left))
            coef, inverse, _ = invert_normal(left[None] * (n / sw), right[None] * (n / sw), np.array([n >= k + 2]))
            if np.isnan(coef).any():
                plan.active[g] = False
                continue
            rows_before[g], left_over[g], inverses[g], coefs[g] = n, n, inverse[0], coef[0]
            spread = np.sqrt(max((whh - coef[0] @ right) / sw, 0)) + 1e-9 * np.sqrt(whh / sw) + 1e-300
            limits[g] = (-3.5 * spread, 3.5 * spread)
        if not coefs:
            break
        marks, ranges, moments = _brackets(near, plan, coefs, limits, left_over)
        mads = _medians(near, plan, coefs, marks, ranges, left_over)
        for g, coef in coefs.items():
            q, k, n, (total, squares) = plan.rules(g), len(coef), left_over[g], moments[g]
            back = moved_terms(q.terms, *(x[None] for x in plan.axes[g]))[0]
            fits[g] = {"coef": coef @ back, "cov": back.T @ inverses[g] @ back * (squares / max(n - k, 1)), "rmse": np.sqrt(max(squares / n - (total / n) ** 2, 0)), "nobs": n, "years": 0}
            plan.found.setdefault(g, []).append((coef, min(q.n_sigma * mads[g], q.residual_limit) if mads[g] >= 1e-10 else np.inf))

    rows = []
    for g in sorted(fits):
        i, code, view = g // len(views) // plan.codes, g // len(views) % plan.codes, views[g % len(views)]
        f = fits[g]
        one = {c: np.array([f[c]]) for c in ("coef", "cov", "rmse", "nobs", "years")} | {"tspan": np.array([frame[g][5] - frame[g][2]])}
        kept, columns = shape(plan.rules(g), one)
        if len(kept):
            rows.append((*nodes[i], *values[code], *[view.keys[k] for k in names], *[columns[c][0].as_py() for c in RESULT]))
    return spark.createDataFrame(rows, schema)
