"""Field operators on long tables (cell_i, cell_j, value): distance, smoothing, derivatives, zones.

A neighbour along one axis is the row with the next index, so every stencil is a join on
shifted keys or a short window inside one row or column of one block; no raster is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryoframe.operators.spatial import cell, knn_join, radius_join


def shifted(field: DataFrame, values: Sequence[str], di: int, dj: int, *, suffix: str, i: str = "cell_i", j: str = "cell_j", by: Sequence[str] = ()) -> DataFrame:
    return field.select(*by, (F.col(i) - di).alias(i), (F.col(j) - dj).alias(j), *[F.col(v).alias(f"{v}{suffix}") for v in values])


def with_neighbours(field: DataFrame, values: Sequence[str], *, i: str = "cell_i", j: str = "cell_j", by: Sequence[str] = ()) -> DataFrame:
    """Adds value_e, value_w, value_n, value_s: each cell sends itself to its four neighbours,
    and one aggregate per cell collects what arrived. One shuffle, no self-joins."""
    sent = F.array(
        *[F.struct(F.lit(d).alias("d"), F.lit(a).alias("a"), F.lit(b).alias("b")) for d, a, b in (("o", 0, 0), ("e", -1, 0), ("w", 1, 0), ("n", 0, -1), ("s", 0, 1))]
    )
    moved = field.withColumn("_m", F.explode(sent)).select(*by, (F.col(i) + F.col("_m.a")).alias(i), (F.col(j) + F.col("_m.b")).alias(j), F.col("_m.d").alias("_d"), *values)
    pick = lambda v, d: F.max(F.when(F.col("_d") == d, F.col(v)))
    return (
        moved.groupBy(*by, i, j)
        .agg(F.max(F.when(F.col("_d") == "o", 1)).alias("_own"), *[pick(v, "o").alias(v) for v in values], *[pick(v, d).alias(f"{v}_{d}") for v in values for d in "ewns"])
        .where("_own = 1")
        .drop("_own")
    )


def slope_of(value: str, low: str, high: str, step: float) -> Column:
    """Central difference, one-sided at an edge."""
    c, a, b = F.col(value), F.col(low), F.col(high)
    return (
        F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * step)).when(b.isNotNull(), (b - c) / step).when(a.isNotNull(), (c - a) / step)
    )


def gradient(field: DataFrame, values: Sequence[str], step: float, **kw) -> DataFrame:
    """Adds d{value}_dx and d{value}_dy."""
    n = with_neighbours(field, values, **kw)
    for v in values:
        n = n.withColumn(f"d{v}_dx", slope_of(v, f"{v}_w", f"{v}_e", step)).withColumn(f"d{v}_dy", slope_of(v, f"{v}_s", f"{v}_n", step))
    return n.drop(*[f"{v}_{d}" for v in values for d in "ewns"])


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [x / sum(w) for x in w]


def smooth(field: DataFrame, values: Sequence[str], sigma: float, *, i: str = "cell_i", j: str = "cell_j", by: Sequence[str] = (), tiny: float = 1e-6) -> DataFrame:
    """Gaussian smoothing that ignores nulls: smooth(v) / smooth(present), separable, on existing cells.

    Along each axis a cell sends weighted sums to its reach; the map side combines them, so
    what is shuffled is one partial row per cell and task.
    """
    if sigma <= 0:
        return field
    w = gaussian_weights(sigma)
    reach = len(w) // 2
    kernel = F.array(*[F.struct(F.lit(k - reach).alias("o"), F.lit(x).alias("w")) for k, x in enumerate(w)])
    cells = field.select(*by, i, j)
    part = field.select(*by, i, j, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values], *[F.col(v).isNotNull().cast("double").alias(f"_w_{v}") for v in values])
    for axis in (i, j):
        part = (
            part.withColumn("_k", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("_k.o"))
            .groupBy(*by, i, j).agg(*[F.sum(F.col(c) * F.col("_k.w")).alias(c) for v in values for c in (v, f"_w_{v}")])
        )
    out = cells.join(part, [*by, i, j], "left")
    return out.select(*by, i, j, *[F.when(F.col(f"_w_{v}") > tiny, F.col(v) / F.col(f"_w_{v}")).alias(v) for v in values])


def flux_divergence(field: DataFrame, step: float, *, thickness: str = "H", vx: str = "vx", vy: str = "vy", sigma: float = 0.0, min_thickness: float = 10.0, **kw) -> DataFrame:
    """d(H vx)/dx + d(H vy)/dy after smoothing; null under thin ice."""
    s = smooth(field, [thickness, vx, vy], sigma, **kw) if sigma > 0 else field
    q = s.withColumn("_qx", F.col(thickness) * F.col(vx)).withColumn("_qy", F.col(thickness) * F.col(vy))
    g = gradient(q, ["_qx", "_qy", thickness], step, **kw)
    thick = F.col(thickness) >= min_thickness
    return g.withColumn("divergence", F.when(thick, F.col("d_qx_dx") + F.col("d_qy_dy"))).drop("_qx", "_qy", "d_qx_dx", "d_qx_dy", "d_qy_dx", "d_qy_dy", f"d{thickness}_dx", f"d{thickness}_dy")


def velocity_divergence(field: DataFrame, step: float, *, vx: str = "vx", vy: str = "vy", sigma: float = 0.0, **kw) -> DataFrame:
    s = smooth(field, [vx, vy], sigma, **kw) if sigma > 0 else field
    return gradient(s, [vx, vy], step, **kw).withColumn("divergence", F.col(f"d{vx}_dx") + F.col(f"d{vy}_dy"))


def divergence_sweep(field: DataFrame, step: float, scales: Sequence[float], **kw) -> DataFrame:
    """The divergence at several smoothing scales, in long form."""
    out = None
    for s in scales:
        d = velocity_divergence(field, step, sigma=s, **kw).select("cell_i", "cell_j", "divergence").withColumn("sigma", F.lit(float(s)))
        out = d if out is None else out.unionByName(d)
    return out


def advection(field: DataFrame, step: float, *, height: str = "z", vx: str = "vx", vy: str = "vy", sigma: float = 0.0) -> DataFrame:
    """v . grad(h) with a smoothed surface."""
    s = smooth(field, [height], sigma) if sigma > 0 else field.select("cell_i", "cell_j", height)
    g = gradient(s, [height], step)
    return g.join(field.select("cell_i", "cell_j", vx, vy), ["cell_i", "cell_j"]).withColumn(
        "advection", F.col(vx) * F.col(f"d{height}_dx") + F.col(vy) * F.col(f"d{height}_dy"))


def slope_magnitude(field: DataFrame, step: float, *, height: str = "z") -> DataFrame:
    return gradient(field, [height], step).withColumn("slope", F.hypot(f"d{height}_dx", f"d{height}_dy"))


def along_flow_slope(field: DataFrame, step: float, *, bed: str = "bed", vx: str = "vx", vy: str = "vy", min_speed: float = 1.0) -> DataFrame:
    """Bed slope along the flow in m per km, where the ice moves."""
    g = gradient(field.select("cell_i", "cell_j", bed), [bed], step).join(field.select("cell_i", "cell_j", vx, vy), ["cell_i", "cell_j"])
    speed = F.hypot(vx, vy)
    return g.withColumn("flow_slope", F.when(speed >= min_speed, 1000 * (F.col(f"d{bed}_dx") * F.col(vx) + F.col(f"d{bed}_dy") * F.col(vy)) / speed))


def boundary_cells(field: DataFrame, target: Column, *, value: str = "mask_class") -> DataFrame:
    """Target cells with a 4-neighbour that is not target: only they can be nearest to an outside cell."""
    marked = field.select("cell_i", "cell_j", target.cast("int").alias("_t"))
    n = with_neighbours(marked, ["_t"])
    inner = (F.coalesce("_t_e", F.lit(0)) + F.coalesce("_t_w", F.lit(0)) + F.coalesce("_t_n", F.lit(0)) + F.coalesce("_t_s", F.lit(0))) == 4
    return n.where((F.col("_t") == 1) & ~inner).select("cell_i", "cell_j")


def distance_to_class(field: DataFrame, target: Column, pixel_m: float, *, out: str = "distance") -> DataFrame:
    """Euclidean distance of every cell to the nearest target cell, 0 on it, null when there is none."""
    edge = boundary_cells(field, target)
    cells = field.withColumn("_t", F.coalesce(target, F.lit(False)))
    src = edge.select(F.col("cell_i").alias("ei"), F.col("cell_j").alias("ej"), F.col("cell_i").cast("double").alias("sx"), F.col("cell_j").cast("double").alias("sy"))
    tgt = cells.where(~F.col("_t")).select("cell_i", "cell_j", F.col("cell_i").cast("double").alias("x"), F.col("cell_j").cast("double").alias("y"))
    near = knn_join(tgt, src, 1, target_id=["cell_i", "cell_j"], source_id=["ei", "ej"], base=4.0, levels=16)
    dist = near.select("cell_i", "cell_j", (F.sqrt("d2") * pixel_m).alias("_d"))
    return cells.join(dist, ["cell_i", "cell_j"], "left").withColumn(out, F.when(F.col("_t"), 0.0).otherwise(F.col("_d"))).drop("_t", "_d")


def to_matrix(cells: DataFrame, value: str, columns: Sequence[int]) -> DataFrame:
    """Rows of a regular grid; an absent cell stays null, never zero."""
    return cells.groupBy("cell_j").pivot("cell_i", list(columns)).agg(F.first(value))


def fuse_layers(layers: Mapping[str, DataFrame], floating: Column, *, surface: str = "surface", thickness: str = "thickness", bed: str = "bed") -> DataFrame:
    """Aligned layers to one table: draft under floating ice, water column not below zero."""
    out = None
    for name, d in layers.items():
        part = d.select("cell_i", "cell_j", F.col("value").alias(name))
        out = part if out is None else out.join(part, ["cell_i", "cell_j"])
    draft = F.when(floating, F.col(surface) - F.col(thickness))
    return out.withColumn("draft", draft).withColumn("water_column", F.when(floating, F.greatest(F.col("draft") - F.col(bed), F.lit(0.0))))


def gate_discharge(
    gates: DataFrame, field: DataFrame, *, origin: tuple[float, float], step: float, n: int = 120, density: float = 917.0, by: Sequence[str] = ("gate",),
    time: Sequence[str] = (),
) -> DataFrame:
    """Flux through straight gates (x0, y0, x1, y1): H (v . n) over n samples; positive downstream."""
    t = (F.col("_k") + 0.5) / n
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    s = gates.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_len", length)
    s = s.withColumn("px", F.col("x0") + t * (F.col("x1") - F.col("x0"))).withColumn("py", F.col("y0") + t * (F.col("y1") - F.col("y0")))
    s = s.withColumn("nx", -(F.col("y1") - F.col("y0")) / F.col("_len")).withColumn("ny", (F.col("x1") - F.col("x0")) / F.col("_len"))
    s = s.withColumn("cell_i", F.rint((F.col("px") - origin[0]) / step).cast("bigint")).withColumn("cell_j", F.rint((F.col("py") - origin[1]) / step).cast("bigint"))
    j = s.join(field, ["cell_i", "cell_j"])
    flux = F.sum(F.col("H") * (F.col("vx") * F.col("nx") + F.col("vy") * F.col("ny")) * F.col("_len") / n) * density / 1e12
    return j.groupBy(*by, *time).agg(F.count(F.lit(1)).alias("n_samples"), F.abs(flux).alias("discharge_gt"))


def in_polygon(points: DataFrame, edges: DataFrame, bucket: float, *, x: str = "x", y: str = "y", ids: Sequence[str]) -> DataFrame:
    """Points inside a closed line given as edges (x1, y1, x2, y2): crossing parity of a ray to the right.

    Edges are listed in the horizontal strips they touch, so a point only meets the edges of its strip.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.where(F.col("y1") != F.col("y2")).withColumn("_by", F.explode(F.sequence(cell(lo, bucket), cell(hi, bucket))))
    p = points.withColumn("_by", cell(y, bucket))
    at = F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hit = ((F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))) & (F.col(x) < at)
    inside = p.join(e, "_by").where(hit).groupBy(*ids).agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1").select(*ids)
    return points.join(inside, list(ids), "left_semi")


def classify_by_mask(points: DataFrame, mask: DataFrame, *, origin: tuple[float, float], step: float, limits: tuple[int, int, int, int], keep: Sequence[int], value: str = "mask_class") -> DataFrame:
    """Pixel class of each point, index clipped to the raster, kept classes only."""
    from cryoframe.operators.spatial import sample_cells

    got = sample_cells(points, mask, origin=origin, step=step, values=[value], clip=limits)
    return got.where(F.col(value).isin(list(keep)))
