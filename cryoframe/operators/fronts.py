"""Dated lines: densification, front classification, annual transition zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cryoframe.operators.spatial import nearest_epoch, nearest_join, radius_join
from cryoframe.session import cut


def wkt_vertices(lines: DataFrame, keys: Sequence[str], *, wkt: str = "wkt") -> DataFrame:
    """Vertices of LINESTRING / MULTILINESTRING text with their part and order; other text is skipped."""
    text = F.upper(F.trim(F.col(wkt)))
    body = F.when(text.startswith("MULTILINESTRING"), F.regexp_extract(text, r"^MULTILINESTRING\s*\(\s*\((.*)\)\s*\)$", 1)).when(
        text.startswith("LINESTRING"), F.regexp_extract(text, r"^LINESTRING\s*\((.*)\)$", 1))
    parts = lines.select(*keys, F.posexplode(F.split(body, r"\)\s*,\s*\(")).alias("part", "_p"))
    verts = parts.select(*keys, "part", F.posexplode(F.split("_p", r"\s*,\s*")).alias("seq", "_v"))
    xy = F.split(F.trim("_v"), r"\s+")
    out = verts.select(*keys, "part", "seq", F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))
    return out.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def densify(lines: DataFrame, keys: Sequence[str], step: float, *, wkt: str = "wkt") -> DataFrame:
    """Points along each line at equal spacing of at most ``step``, both ends included.

    A line's vertices are ordered in one window; a line is one geometry of one file row.
    """
    v = wkt_vertices(lines, keys, wkt=wkt)
    w = Window.partitionBy(*keys, "part").orderBy("seq")
    seg = v.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where(F.col("x2").isNotNull())
    seg = seg.withColumn("_l", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    seg = seg.withColumn("_to", F.sum("_l").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("_l"))
    whole = Window.partitionBy(*keys, "part")
    seg = seg.withColumn("_all", F.sum("_l").over(whole)).where((F.col("_all") > 0) & (F.col("_l") > 0))
    n = F.greatest(F.ceil(F.col("_all") / step), F.lit(1)).cast("int")
    gap = F.col("_all") / F.col("_n")
    # Sample k sits in the segment whose span holds k * gap; the last sample belongs to the last segment.
    first, last = F.ceil(F.col("_from") / gap - 1e-9).cast("int"), F.ceil(F.col("_to") / gap - 1e-9).cast("int") - 1
    end = F.abs(F.col("_to") - F.col("_all")) < 1e-6
    seg = seg.withColumn("_n", n).withColumn("_a", first).withColumn("_b", F.when(end, F.col("_n")).otherwise(last)).where(F.col("_b") >= F.col("_a"))
    k = seg.withColumn("k", F.explode(F.sequence("_a", "_b")))
    t = (F.col("k") * gap - F.col("_from")) / F.col("_l")
    return k.select(*keys, "part", "k", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def classify_front(
    points: DataFrame, fronts: DataFrame, *, ids: Sequence[str], distance: str, front_distance: str, time: str = "t_year", shelf: str = "shelf", epoch: str = "epoch",
    tolerance: float = 0.0, assignment_max: float = 150_000.0, max_search: float = 100_000.0, max_gap: float = 0.5, reference_step: float = 2_000.0,
    fail_closed: bool = True, base: float = 2_000.0,
) -> DataFrame:
    """Is a point landward of the calving front of its own time?

    The nearest reference vertex gives the shelf, the nearest epoch inside that shelf the front
    to use, its nearest vertex the front's distance to grounded ice. ``margin`` is that distance
    less the tolerance and the point's own; inside means margin >= 0. Every step leaves its
    flag, and a point that could not be tested is outside when ``fail_closed``.

    ``fronts``: shelf, epoch, x, y and ``front_distance``; ``points`` carry ``distance``.
    """
    ref = fronts.select(shelf, F.rint(F.col("x") / reference_step).alias("_qx"), F.rint(F.col("y") / reference_step).alias("_qy"), "x", "y")
    ref = ref.groupBy(shelf, "_qx", "_qy").agg(F.min(F.struct("x", "y")).alias("_v")).select(shelf, F.col("_v.x").alias("sx"), F.col("_v.y").alias("sy"))
    slim = points.select(*ids, "x", "y", time, distance)
    near = nearest_join(slim, ref, target_id=ids, source_id=[shelf, "sx", "sy"], base=base, max_distance=assignment_max)
    placed = near.select(*ids, "x", "y", time, distance, shelf)
    # Three branches read this table; written once, the shelf search is not run again for each.
    dated = cut(nearest_epoch(placed, fronts.select(shelf, epoch).distinct(), time=time, epoch=epoch, by=[shelf], max_gap=max_gap))
    verts = fronts.select(shelf, epoch, F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(front_distance).alias("_df"))
    hit = nearest_join(dated.where("epoch_valid"), verts, target_id=ids, source_id=["sx", "sy"], by=[shelf, epoch], base=base, max_distance=max_search)
    margin = F.col("_df") - tolerance - F.col(distance)
    hit = hit.select(*ids, F.col("dist").alias("front_dist"), margin.alias("margin"))
    out = slim.select(*ids).join(dated.select(*ids, shelf, epoch, "epoch_gap", "epoch_valid"), list(ids), "left").join(hit, list(ids), "left")
    tested = F.col("margin").isNotNull()
    return (
        out.withColumn("assigned", F.col(shelf).isNotNull()).withColumn("epoch_valid", F.coalesce("epoch_valid", F.lit(False)))
        .withColumn("near_front", F.col("front_dist").isNotNull()).withColumn("tested", tested)
        .withColumn("inside", F.when(tested, F.col("margin") >= 0).otherwise(F.lit(not fail_closed)))
    )


def front_reason() -> Column:
    return (
        F.when(~F.col("assigned"), "no_shelf").when(~F.col("epoch_valid"), "epoch_gap").when(~F.col("near_front"), "no_front")
        .when(~F.col("tested"), "no_distance").when(~F.col("inside"), "seaward").otherwise("kept")
    )


def front_counters(result: DataFrame, buffers: Sequence[float] = (0.0, 2000.0, 5000.0, 10000.0), *, shelf: str = "shelf") -> tuple[DataFrame, DataFrame]:
    """(rows per shelf and reason, kept rows per front buffer)."""
    reasons = result.groupBy(shelf, front_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    fan = result.where("tested").withColumn("buffer", F.explode(F.array(*[F.lit(float(b)) for b in buffers])))
    kept = fan.groupBy("buffer").agg(F.count(F.lit(1)).alias("n_tested"), F.count_if(F.col("margin") >= F.col("buffer")).alias("n_kept"))
    return reasons, kept


def transition_zones(cells: DataFrame, lines: DataFrame, max_radius: float, *, year: str = "year") -> DataFrame:
    """Cells within the transition radius of a year's line: (cell, year, radius, support, distance).

    ``lines`` are vertices with year, radius and ``matched`` (own width or fallback).
    """
    verts = lines.select(F.col("x").alias("vx"), F.col("y").alias("vy"), year, "radius", "matched")
    j = radius_join(cells.select("cell_i", "cell_j", "x", "y"), verts, max_radius, node_xy=("vx", "vy"), keep_d2="d2")
    j = j.where(F.sqrt("d2") <= F.col("radius"))
    return j.groupBy("cell_i", "cell_j", year).agg(
        F.max("radius").alias("radius"), F.min(F.sqrt("d2")).alias("distance"), F.when(F.bool_or("matched"), 2).otherwise(3).alias("support"))


def classify_state(points: DataFrame, zones: DataFrame, *, year: str = "year", mask_class: str = "mask_class") -> DataFrame:
    """State 1 grounded, 2 transition of that very year, 3 floating, 0 unknown; support 4 marks a cell
    that was a transition zone in another year. A missing year is never interpolated."""
    exact = zones.select("cell_i", "cell_j", year, F.col("support").alias("_xs"), F.col("radius").alias("transition_radius"))
    ever = zones.groupBy("cell_i", "cell_j").agg(F.max("radius").alias("_hr"))
    m = F.col(mask_class)
    default = F.when(m == 2, 1).when(m == 3, 3).otherwise(0)
    known = F.when(m.isin(2, 3), 1).otherwise(0)
    j = points.join(exact, ["cell_i", "cell_j", year], "left").join(ever, ["cell_i", "cell_j"], "left")
    here, before = F.col("_xs").isNotNull(), F.col("_hr").isNotNull()
    return (
        j.withColumn("state", F.when(here, 2).when(before, 0).otherwise(default).cast("int"))
        .withColumn("support", F.when(here, F.col("_xs")).when(before, 4).otherwise(known).cast("int"))
        .withColumn("line_year", F.when(here, F.col(year)).otherwise(0))
        .withColumn("transition_radius", F.when(here, F.col("transition_radius")).when(before, F.col("_hr")).otherwise(0.0))
        .drop("_xs", "_hr")
    )
