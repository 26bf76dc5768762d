"""Joins by distance, nearest neighbour, cell and time, as bucketed equi-joins.

Catalyst plans a distance predicate as a nested loop. Here each join gets an
integer bucket key first, so it becomes a hash or sort-merge equi-join whose
shuffle Spark can split when one bucket is hot (AQE skew join). No side is
broadcast by hint; Spark broadcasts by measured size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(v: Column | str, size: float, offset: float = 0.0) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.floor((c + offset * size) / F.lit(float(size))).cast("bigint")


def _offsets(reach: int) -> Column:
    pairs = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])


def lattice(
    points: DataFrame, tile_m: float, step_m: float, *, x: str = "x", y: str = "y", min_x: float | None = None, min_y: float | None = None
) -> DataFrame:
    """Node lattice inside every tile that has a point: (node_x, node_y, tile_i, tile_j), tiles anchored at 0
    or at the given origin rounded down to whole tiles."""
    ox = 0.0 if min_x is None else math.floor(min_x / tile_m) * tile_m
    oy = 0.0 if min_y is None else math.floor(min_y / tile_m) * tile_m
    tiles = points.select(
        cell(F.col(x) - ox, tile_m).alias("tile_i"), cell(F.col(y) - oy, tile_m).alias("tile_j")
    ).distinct()
    n = max(int(math.ceil(tile_m / step_m - 0.5)), 1)
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return (
        tiles.withColumn("_a", F.explode(steps))
        .withColumn("_b", F.explode(steps))
        .select(
            (F.lit(ox) + F.col("tile_i") * tile_m + step_m / 2 + F.col("_a") * step_m).alias("node_x"),
            (F.lit(oy) + F.col("tile_j") * tile_m + step_m / 2 + F.col("_b") * step_m).alias("node_y"),
            "tile_i",
            "tile_j",
        )
    )


def radius_join(
    points: DataFrame,
    nodes: DataFrame,
    radius: float,
    *,
    xy: tuple[str, str] = ("x", "y"),
    node_xy: tuple[str, str] = ("node_x", "node_y"),
    by: Sequence[str] = (),
    keep_d2: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """Every (point, node) with distance at most ``radius``; equal on ``by`` where given.

    The node side, which is the smaller one, is copied to its 3 x 3 buckets; each
    point is read and shuffled once. ``how`` is inner, or left_semi / left_anti
    (points with or without a node in reach).
    """
    px, py = xy
    nx, ny = node_xy
    left = points.withColumn("_bx", cell(px, radius)).withColumn("_by", cell(py, radius))
    right = (
        nodes.withColumn("_o", F.explode(_offsets(1)))
        .withColumn("_bx", cell(nx, radius) + F.col("_o.i"))
        .withColumn("_by", cell(ny, radius) + F.col("_o.j"))
        .drop("_o")
    )
    if how != "inner":
        right = right.select("_bx", "_by", *by, F.col(nx).alias("_nx"), F.col(ny).alias("_ny"))
        nx, ny = "_nx", "_ny"
    # Hash the node side per bucket: points are shuffled once and never sorted, and Spark cannot
    # mistake them for the side to broadcast when its estimate of the exploded nodes is off.
    a, b = left.alias("a"), right.hint("shuffle_hash").alias("b")
    dx, dy = F.col(f"a.{px}") - F.col(f"b.{nx}"), F.col(f"a.{py}") - F.col(f"b.{ny}")
    cond = (F.col("a._bx") == F.col("b._bx")) & (F.col("a._by") == F.col("b._by"))
    for k in by:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = cond & (dx * dx + dy * dy <= F.lit(float(radius) ** 2))
    joined = a.join(b, cond, how)
    if how != "inner":
        return joined.drop("_bx", "_by")
    out = [F.col(f"a.{c}") for c in points.columns] + [F.col(f"b.{c}") for c in nodes.columns if c not in points.columns]
    if keep_d2:
        out.append((dx * dx + dy * dy).alias(keep_d2))
    return joined.select(*out)


def knn_candidates(
    targets: DataFrame,
    sources: DataFrame,
    k: int,
    *,
    txy: tuple[str, str] = ("x", "y"),
    sxy: tuple[str, str] = ("sx", "sy"),
    by: Sequence[str] = (),
    base: float = 1000.0,
    levels: int = 12,
    finer: int = 6,
    max_distance: float | None = None,
) -> DataFrame:
    """Pairs with ``d2`` among which are the ``min(k, n)`` nearest sources of each target.

    A count pyramid over the sources (cell size ``base`` doubled per level, from
    ``finer`` halvings below it) tells each target cell the finest level whose 3 x 3
    block holds ``k`` sources. The k-th neighbour is then no farther than the far
    corner of that block, which the 7 x 7 block covers, so one pass is exact: no
    widening loop, no whole cross join. Where sources are dense, blocks are small, so
    candidates grow with the targets and not with the product of both.
    """
    tx, ty = txy
    sx, sy = sxy
    by = list(by)
    base, levels = base / 2**finer, levels + finer
    top = levels - 1
    if max_distance is not None:  # a level whose 7 x 7 block spans the cutoff is as coarse as needed
        top = min(top, max(0, math.ceil(math.log2(max_distance / (3.0 * base)))))
    s = sources.withColumn("_c0x", cell(sx, base)).withColumn("_c0y", cell(sy, base))
    t = targets.withColumn("_c0x", cell(tx, base)).withColumn("_c0y", cell(ty, base))
    lv = F.explode(F.sequence(F.lit(0), F.lit(top)))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_l"))).cast("bigint")
    pyramid = (
        s.groupBy(*by, "_c0x", "_c0y")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_l", lv)
        .withColumn("_cx", at("_c0x"))
        .withColumn("_cy", at("_c0y"))
        .groupBy(*by, "_l", "_cx", "_cy")
        .agg(F.sum("_n").alias("_n"))
    )
    # Blocks that hold enough; each source cell counts in the nine around it, once a level.
    full = (
        pyramid.withColumn("_o", F.explode(_offsets(1)))
        .withColumn("_cx", F.col("_cx") + F.col("_o.i"))
        .withColumn("_cy", F.col("_cy") + F.col("_o.j"))
        .groupBy(*by, "_l", "_cx", "_cy")
        .agg(F.sum("_n").alias("_n"))
        .where(F.col("_n") >= k)
        .drop("_n")
    )
    places = t.select(*by, "_c0x", "_c0y").distinct()
    counted = (
        places.withColumn("_l", lv)
        .withColumn("_cx", at("_c0x"))
        .withColumn("_cy", at("_c0y"))
        .join(full, [*by, "_l", "_cx", "_cy"])
        .groupBy(*by, "_c0x", "_c0y")
        .agg(F.min("_l").alias("_l"))
    )
    # A place without enough sources around it searches at the coarsest level.
    chosen = places.join(counted, [*by, "_c0x", "_c0y"], "left").withColumn("_l", F.coalesce("_l", F.lit(top)))
    size = F.lit(float(base)) * F.pow(F.lit(2.0), F.col("_l"))
    fx = F.col(tx) / F.col("_s") - F.floor(F.col(tx) / F.col("_s"))
    fy = F.col(ty) / F.col("_s") - F.floor(F.col(ty) / F.col("_s"))
    far = F.hypot(1 + F.greatest(fx, 1 - fx), 1 + F.greatest(fy, 1 - fy)) * F.col("_s")
    gap = lambda v, c: F.greatest(
        F.lit(0.0), F.col(c) * F.col("_s") - F.col(v), F.col(v) - (F.col(c) + 1) * F.col("_s")
    )
    near = F.hypot(gap(tx, "_cx"), gap(ty, "_cy"))
    reach = F.when(F.col("_l") < top, F.col("_far")).otherwise(F.lit(float("inf")))
    if max_distance is not None:
        reach = F.least(reach, F.lit(float(max_distance)))
    probes = (
        t.join(chosen, [*by, "_c0x", "_c0y"])
        .drop("_c0x", "_c0y")
        .withColumn("_s", size)
        .withColumn("_far", far)
        .withColumn("_o", F.explode(_offsets(3)))
        .withColumn("_cx", F.floor(F.col(tx) / F.col("_s")).cast("bigint") + F.col("_o.i"))
        .withColumn("_cy", F.floor(F.col(ty) / F.col("_s")).cast("bigint") + F.col("_o.j"))
        .where(near <= reach)
        .drop("_o", "_s", "_far")
    )
    # A source is only copied to the levels some target really asked for.
    if by:
        grid = s.join(chosen.select(*by, "_l").distinct(), by)
    else:  # one row with at most ``levels`` numbers
        asked = chosen.agg(F.collect_set("_l").alias("_ls"))
        grid = s.crossJoin(F.broadcast(asked)).withColumn("_l", F.explode("_ls")).drop("_ls")
    grid = grid.withColumn("_cx", at("_c0x")).withColumn("_cy", at("_c0y")).drop("_c0x", "_c0y")
    d2 = (F.col(tx) - F.col(sx)) * (F.col(tx) - F.col(sx)) + (F.col(ty) - F.col(sy)) * (F.col(ty) - F.col(sy))
    pairs = probes.join(grid, [*by, "_l", "_cx", "_cy"]).drop("_l", "_cx", "_cy").withColumn("d2", d2)
    if max_distance is not None:
        pairs = pairs.where(F.col("d2") <= float(max_distance) ** 2)
    return pairs


def knn_join(targets: DataFrame, sources: DataFrame, k: int, *, target_id: Sequence[str], source_id: Sequence[str], **kw) -> DataFrame:
    """The ``min(k, n)`` nearest sources of each target with ``d2`` and ``rank``, ties by source id.

    Row number with a bound lets Spark prune to k rows per target before the shuffle.
    """
    order = Window.partitionBy(*target_id).orderBy("d2", *source_id)
    return knn_candidates(targets, sources, k, **kw).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_join(targets: DataFrame, sources: DataFrame, **kw) -> DataFrame:
    """The nearest source within the cutoff, with its columns and ``dist``: see :func:`nearest.nearest_join`."""
    from cryoframe.operators import nearest

    return nearest.nearest_join(targets, sources, **kw)


def nearest_epoch(
    rows: DataFrame, epochs: DataFrame, *, time: str, epoch: str, by: Sequence[str], max_gap: float | None = None
) -> DataFrame:
    """As-of join to the nearest epoch inside each group; an equal gap takes the earlier epoch.

    Epochs per group are few by nature (dated lines). They become half-open
    validity intervals cut at the midpoints, so the join is by group and interval
    and each row meets exactly one epoch.
    """
    w = Window.partitionBy(*by).orderBy(epoch)
    spans = (
        epochs.select(*by, F.col(epoch).alias("_e"))
        .distinct()
        .withColumnRenamed("_e", epoch)
        .withColumn("_from", (F.lag(epoch).over(w) + F.col(epoch)) / 2)
        .withColumn("_to", (F.lead(epoch).over(w) + F.col(epoch)) / 2)
    )
    a, b = rows.alias("a"), spans.alias("b")
    cond = F.coalesce(F.col(f"a.{time}") > F.col("b._from"), F.lit(True)) & F.coalesce(
        F.col(f"a.{time}") <= F.col("b._to"), F.lit(True)
    )
    for k in by:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    gap = F.abs(F.col(f"a.{time}") - F.col(f"b.{epoch}"))
    out = a.join(b, cond, "left").select("a.*", F.col(f"b.{epoch}").alias(epoch), gap.alias("epoch_gap"))
    if max_gap is not None:
        out = out.withColumn("epoch_valid", F.coalesce(F.col("epoch_gap") <= max_gap, F.lit(False)))
    return out


def grid_key(v: Column, origin: float, step: float) -> Column:
    return F.rint((v - F.lit(float(origin))) / F.lit(float(step))).cast("bigint")


def sample_cells(
    points: DataFrame,
    field: DataFrame,
    *,
    origin: tuple[float, float],
    step: float,
    values: Sequence[str],
    xy: tuple[str, str] = ("x", "y"),
    cells: tuple[str, str] = ("cell_i", "cell_j"),
    clip: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Value of the nearest cell. With ``clip`` = (i0, i1, j0, j1) outside points take the edge, else null."""
    i, j = grid_key(F.col(xy[0]), origin[0], step), grid_key(F.col(xy[1]), origin[1], step)
    if clip:
        i0, i1, j0, j1 = clip
        i = F.least(F.greatest(i, F.lit(i0)), F.lit(i1))
        j = F.least(F.greatest(j, F.lit(j0)), F.lit(j1))
    right = field.select(F.col(cells[0]).alias("_i"), F.col(cells[1]).alias("_j"), *values)
    return points.withColumn("_i", i).withColumn("_j", j).join(right, ["_i", "_j"], "left").drop("_i", "_j")


def stencils(field: DataFrame, value: str, *, cells: tuple[str, str] = ("cell_i", "cell_j"), by: Sequence[str] = (), wrap_i: int | None = None) -> DataFrame:
    """by, _i, _j, _f00, _f10, _f01, _f11: each cell with its neighbours to the right and above, in one row. A cell given twice counts with its larger value."""
    four = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    i = F.col(cells[0]) - F.col("_d.a")
    rows = field.where(F.col(value).isNotNull()).withColumn("_d", four).select(
        *by, (i if wrap_i is None else F.pmod(i, F.lit(wrap_i))).cast("bigint").alias("_i"), (F.col(cells[1]) - F.col("_d.b")).cast("bigint").alias("_j"), "_d", F.col(value).alias("_f")
    )
    return rows.groupBy(*by, "_i", "_j").agg(*[F.max(F.when((F.col("_d.a") == a) & (F.col("_d.b") == b), F.col("_f"))).alias(f"_f{a}{b}") for a in (0, 1) for b in (0, 1)])


def sample_bilinear(
    points: DataFrame,
    field: DataFrame,
    *,
    origin: tuple[float, float],
    step: float | tuple[float, float],
    value: str,
    ids: Sequence[str] = (),
    out: str | None = None,
    xy: tuple[str, str] = ("x", "y"),
    cells: tuple[str, str] = ("cell_i", "cell_j"),
    by: Sequence[str] = (),
    wrap_i: int | None = None,
    clamp_j: tuple[int, int] | None = None,
) -> DataFrame:
    """Bilinear value of each row of ``points``, null where any weighted corner is missing.

    ``wrap_i`` makes the first axis cyclic (longitude), ``clamp_j`` holds the second inside its range (latitude). The
    field is turned into one row for each 2 x 2 stencil, so a point is looked up once, by an equi-join, and is never
    grouped: rows that repeat stay rows, and ``ids`` are not needed (callers may still name them).
    """
    out = out or value
    step_x, step_y = step if isinstance(step, tuple) else (step, step)
    u = (F.col(xy[0]) - F.lit(float(origin[0]))) / F.lit(float(step_x))
    v = (F.col(xy[1]) - F.lit(float(origin[1]))) / F.lit(float(step_y))
    if clamp_j:
        v = F.least(F.greatest(v, F.lit(float(clamp_j[0]))), F.lit(float(clamp_j[1])))
    i = F.floor(F.col("_u")) if wrap_i is None else F.pmod(F.floor(F.col("_u")), F.lit(wrap_i))
    placed = points.withColumn("_u", u).withColumn("_v", v).withColumn("_i", i.cast("bigint")).withColumn("_j", F.floor(F.col("_v")).cast("bigint"))
    fu, fv = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    weights = {"_f00": (1 - fu) * (1 - fv), "_f10": fu * (1 - fv), "_f01": (1 - fu) * fv, "_f11": fu * fv}
    total = sum((F.when(w == 0, 0.0).otherwise(F.col(f) * w) for f, w in weights.items()), F.lit(0.0))
    looked = placed.join(stencils(field, value, cells=cells, by=by, wrap_i=wrap_i), [*by, "_i", "_j"], "left")
    return looked.select(*[F.col(c) for c in points.columns if c != out], total.alias(out))


def bracket_times(rows: DataFrame, epochs: DataFrame, *, time: str, epoch: str = "epoch", width: float = 1.0) -> DataFrame:
    """Bracketing epochs (t0, t1), the weight ``w1`` of t1, and ``clamped`` for times outside the record.

    Intervals are exploded to time buckets so the join is an equality plus a residual range.
    """
    w = Window.orderBy(epoch)  # over the distinct epochs of a field, a short list
    spans = epochs.select(epoch).distinct().select(F.col(epoch).alias("t0"), F.lead(epoch).over(w).alias("t1"))
    bucket = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    spans = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.coalesce("t1", "t0")))))
    ends = epochs.agg(F.min(epoch).alias("_lo"), F.max(epoch).alias("_hi"))
    held = rows.crossJoin(F.broadcast(ends)).withColumn("_t", F.least(F.greatest(F.col(time), F.col("_lo")), F.col("_hi")))
    return (
        held.withColumn("_b", bucket(F.col("_t")))
        .join(spans, "_b")
        .where((F.col("_t") >= F.col("t0")) & (F.col("t1").isNull() | (F.col("_t") < F.col("t1"))))
        .withColumn("w1", F.coalesce((F.col("_t") - F.col("t0")) / (F.col("t1") - F.col("t0")), F.lit(0.0)))
        .withColumn("t1", F.coalesce("t1", "t0"))
        .withColumn("clamped", F.col("_t") != F.col(time))
        .drop("_b", "_lo", "_hi", "_t")
    )


def halo_tiles(points: DataFrame, tile_m: float, halo_m: float, *, x: str = "x", y: str = "y") -> DataFrame:
    """Each point in every active tile whose core or halo holds it: adds tile_i, tile_j, is_core."""
    reach = int(math.ceil(halo_m / tile_m))
    active = points.select(cell(x, tile_m).alias("tile_i"), cell(y, tile_m).alias("tile_j")).distinct()
    near = lambda v, c: in_span(F.col(v), F.col(c) * tile_m - halo_m, (F.col(c) + 1) * tile_m + halo_m)
    return (
        points.withColumn("_o", F.explode(_offsets(reach)))
        .withColumn("tile_i", cell(x, tile_m) + F.col("_o.i"))
        .withColumn("tile_j", cell(y, tile_m) + F.col("_o.j"))
        .withColumn("is_core", (F.col("_o.i") == 0) & (F.col("_o.j") == 0))
        .drop("_o")
        .where(F.col("is_core") | (near(x, "tile_i") & near(y, "tile_j")))
        .join(F.broadcast(active), ["tile_i", "tile_j"], "left_semi")  # a row a tile; else all copies would be shuffled to ask it
    )


def in_span(v: Column, low: Column, high: Column) -> Column:
    return (v >= low) & (v < high)


def tile_manifest(tiled: DataFrame, tile_m: float) -> DataFrame:
    return (
        tiled.groupBy("tile_i", "tile_j")
        .agg(F.count_if(F.col("is_core")).alias("n_core"), F.count(F.lit(1)).alias("n_with_halo"))
        .withColumn("x_min", F.col("tile_i") * float(tile_m))
        .withColumn("y_min", F.col("tile_j") * float(tile_m))
    )


def outside_buffer(
    rows: DataFrame, others: DataFrame, buffer_m: float, *, xy: tuple[str, str] = ("x", "y"), by: Sequence[str] = ()
) -> DataFrame:
    """Rows with no other closer than ``buffer_m`` (strict), without listing all pairs of a dense area.

    Occupied fine cells settle most rows: a cell pair closer than the buffer at its
    farthest corners drops all rows of that cell, a pair farther apart than the buffer
    at its nearest corners drops none. Only rows in between meet distinct positions.
    """
    f = float(buffer_m) / 4.0
    x, y = xy
    by = list(by)
    spots = others.select(*by, F.col(x).alias("_ox"), F.col(y).alias("_oy")).distinct()
    spots = spots.withColumn("_qx", cell("_ox", f)).withColumn("_qy", cell("_oy", f))
    own = rows.withColumn("_px", cell(x, f)).withColumn("_py", cell(y, f))
    probe = (
        own.select(*by, "_px", "_py").distinct().withColumn("_o", F.explode(_offsets(5)))
        .withColumn("_qx", F.col("_px") + F.col("_o.i")).withColumn("_qy", F.col("_py") + F.col("_o.j"))
        .withColumn("_far", F.hypot(F.abs("_o.i") + 1, F.abs("_o.j") + 1) * f)
        .withColumn("_near", F.hypot(F.greatest(F.abs("_o.i") - 1, F.lit(0)), F.greatest(F.abs("_o.j") - 1, F.lit(0))) * f)
        .where(F.col("_near") < buffer_m)
        .join(spots.select(*by, "_qx", "_qy").distinct(), [*by, "_qx", "_qy"])
    )
    settled = probe.where(F.col("_far") < buffer_m).select(*by, "_px", "_py").distinct()
    open_cells = probe.join(settled, [*by, "_px", "_py"], "left_anti").select(*by, "_px", "_py", "_qx", "_qy")
    close = (
        own.select(*by, "_px", "_py", x, y).distinct()
        .join(open_cells, [*by, "_px", "_py"])
        .join(spots, [*by, "_qx", "_qy"])
        .where((F.col(x) - F.col("_ox")) ** 2 + (F.col(y) - F.col("_oy")) ** 2 < float(buffer_m) ** 2)
        .select(*by, x, y)
        .distinct()
    )
    return (
        own.join(settled, [*by, "_px", "_py"], "left_anti").join(close, [*by, x, y], "left_anti").drop("_px", "_py")
    )


def ring_samples(nodes: DataFrame, radius_m: float, n: int = 16, *, x: str = "x", y: str = "y") -> DataFrame:
    """``n`` positions on a circle around each node: adds ring_x, ring_y."""
    angle = F.col("_k") * F.lit(2 * math.pi / n)
    return (
        nodes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("ring_x", F.col(x) + radius_m * F.cos(angle))
        .withColumn("ring_y", F.col(y) + radius_m * F.sin(angle))
        .drop("_k")
    )


def in_boxes(points: DataFrame, boxes: DataFrame, halo_m: float, bucket_m: float, *, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside any half-open box grown by a halo; boxes (x0, x1, y0, y1) are exploded to buckets."""
    span = lambda lo, hi: F.explode(
        F.sequence(cell(F.col(lo) - halo_m, bucket_m), cell(F.col(hi) + halo_m, bucket_m))
    )
    b = boxes.withColumn("_bx", span("x0", "x1")).withColumn("_by", span("y0", "y1")).alias("b")
    a = points.withColumn("_bx", cell(x, bucket_m)).withColumn("_by", cell(y, bucket_m)).alias("a")
    cond = (
        (F.col("a._bx") == F.col("b._bx"))
        & (F.col("a._by") == F.col("b._by"))
        & in_span(F.col(f"a.{x}"), F.col("b.x0") - halo_m, F.col("b.x1") + halo_m)
        & in_span(F.col(f"a.{y}"), F.col("b.y0") - halo_m, F.col("b.y1") + halo_m)
    )
    return a.join(b, cond, "left_semi").drop("_bx", "_by")


def match_names(rows: DataFrame, catalogue: DataFrame, *, name: str, value: str, fallback: Column, families: Sequence[str] = ()) -> DataFrame:
    """Value by normalised name: exact, else the largest value of a family (names with a common start),
    else the only catalogue key contained in the name, else the fallback. Distinct names, not rows, are compared."""
    cat = catalogue.select(normal_name(F.col(name)).alias("_key"), F.col(value).alias("_val")).where(F.col("_key") != "")
    cat = cat.groupBy("_key").agg(F.max("_val").alias("_val"))
    names = rows.select(F.col(name).alias("_name")).distinct().withColumn("_norm", normal_name(F.col("_name")))
    inside = F.col("_norm").contains(F.col("_key"))
    kin: Column = F.lit(False)
    for start in families:
        kin = kin | (F.col("_norm").startswith(start) & F.col("_key").startswith(start))
    hits = names.join(cat, inside | kin, "left").groupBy("_name").agg(
        F.max(F.when(F.col("_norm") == F.col("_key"), F.col("_val"))).alias("_exact"),
        F.max(F.when(kin, F.col("_val"))).alias("_family"),
        F.count_if(inside).alias("_n"),
        F.max(F.when(inside, F.col("_val"))).alias("_only"),
    )
    found = F.coalesce(F.col("_exact"), F.col("_family"), F.when(F.col("_n") == 1, F.col("_only")))
    picked = hits.select("_name", found.alias("_found"))
    return (
        rows.join(picked, F.col(name) == F.col("_name"), "left")
        .withColumn(value, F.coalesce("_found", fallback))
        .withColumn("matched", F.col("_found").isNotNull())
        .drop("_name", "_found")
    )


def normal_name(c: Column) -> Column:
    """ASCII-fold, lower case, letters and digits only."""
    # Accented letters and what they fold to.
    accented, plain = "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"
    return F.regexp_replace(F.translate(F.lower(c), accented, plain), "[^a-z0-9]", "")
