"""Ordered operators along satellite tracks, without a window that spans a whole beam.

There are six beams; a window partitioned by beam is six tasks, whatever the size
of the table. So order is resolved in two levels: rows inside a (beam, time slice),
then one summary row per slice. A slice is an hour of data by default, so the
summary has at most hours x beams rows and every window in the first level is short.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cryoframe.operators.skew import edge_table, with_slice
from cryoframe.session import ship

HOUR = 1.0 / 8766.0
#: Rows of a group of chunks on average, and values of frames that are sorted at a time.
GROUP_ROWS, FRAMES = 100_000, 400_000


def _slice(t: str, width: float) -> Column:
    return F.floor(F.col(t) / F.lit(width)).cast("bigint")


def track_ids(
    df: DataFrame,
    gap: float,
    *,
    beam: str = "beam",
    time: str = "t_year",
    ties: Sequence[str] = (),
    slice_width: float = HOUR,
    out: str = "track_id",
    position: str | None = "pos",
) -> DataFrame:
    """Zero-based dense track number over (beam, time): a new track on a new beam or a gap above ``gap``.

    ``position`` adds the row's place within its beam.
    """
    inner = Window.partitionBy(beam, "_s").orderBy(time, *ties)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    per_beam = Window.partitionBy(beam).orderBy("_s")
    sliced = df.withColumn("_s", _slice(time, slice_width))
    # Whether the first row of a slice opens a track depends on the last time of the slice before.
    local = (
        sliced.withColumn("_prev", F.lag(time).over(inner))
        .withColumn("_new", F.when(F.col(time) - F.col("_prev") > gap, 1).otherwise(0))
        .withColumn("_rn", F.row_number().over(inner))
        .withColumn("_k", F.sum("_new").over(upto))
    )
    times = Window.partitionBy(beam, "_s").orderBy(time)
    opens = (
        sliced.select(beam, "_s", time)
        .withColumn("_new", F.when(F.col(time) - F.lag(time).over(times) > gap, 1).otherwise(0))
        .groupBy(beam, "_s")
        .agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.sum("_new").alias("_in"), F.count(F.lit(1)).alias("_m"))
        .withColumn("_before", F.lag("_hi").over(per_beam))
        .withColumn("_open", F.when(F.col("_before").isNull() | (F.col("_lo") - F.col("_before") > gap), 1).otherwise(0))
    )
    run = per_beam.rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        opens.withColumn("_all", F.sum(F.col("_in") + F.col("_open")).over(run))
        .withColumn("_rows", F.sum("_m").over(run))
        .select(beam, "_s", (F.col("_all") - F.col("_in")).alias("_base"), (F.col("_rows") - F.col("_m")).alias("_row0"))
    )
    totals = opens.groupBy(beam).agg(F.sum(F.col("_in") + F.col("_open")).alias("_tracks"))
    # One row per beam, and beams may be many: a running sum inside slices of them, and one over the slices' sums.
    dealt = with_slice(totals.crossJoin(F.broadcast(edge_table(totals, [], beam))), beam)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slices = dealt.groupBy("_slice").agg(F.sum("_tracks").alias("_m")).withColumn("_start", F.coalesce(F.sum("_m").over(before(Window.orderBy("_slice"))), F.lit(0)))
    inside = F.coalesce(F.sum("_tracks").over(before(Window.partitionBy("_slice").orderBy(beam))), F.lit(0))
    starts = dealt.withColumn("_in_slice", inside).join(slices, "_slice").select(beam, (F.col("_start") + F.col("_in_slice")).alias("_first"))
    placed = local.join(offsets, [beam, "_s"]).join(starts, beam)
    placed = placed.withColumn(out, (F.col("_first") + F.col("_base") + F.col("_k") - 1).cast("bigint"))
    if position:
        placed = placed.withColumn(position, (F.col("_row0") + F.col("_rn") - 1).cast("bigint"))
    return placed.drop("_s", "_prev", "_new", "_rn", "_k", "_base", "_row0", "_first")


def rolling_medians(values: np.ndarray, there: np.ndarray, first: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
    """Median over the up to 2*half+1 rows around each row from its sequence's ``first`` up to, not including, ``end``.

    ``there`` marks rows that have a value; NaN where a frame has none. Frames are ordered a block of rows at a time.
    """
    out, v = np.full(len(values), np.nan), np.where(there, values, np.nan)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(v, half, constant_values=np.nan), 2 * half + 1)
    below, place = np.concatenate([[0], np.cumsum(there)]), np.arange(len(v))
    low, high = np.maximum(place - half, first), np.minimum(place + half + 1, end)
    n, offsets = below[high] - below[low], np.arange(-half, half + 1)
    step = max(FRAMES // (2 * half + 1), 1)
    for a in range(0, len(v), step):
        block = slice(a, a + step)
        at, some = place[block], frames[block].copy()
        cut_off = np.flatnonzero((high[block] - low[block]) < 2 * half + 1)  # frames that a sequence's end cuts off
        idx = at[cut_off, None] + offsets
        some[cut_off] = np.where((idx >= low[at[cut_off], None]) & (idx < high[at[cut_off], None]), some[cut_off], np.nan)
        some.sort(axis=1)  # what is not there comes last
        m, row = n[block], np.arange(len(at))
        out[block] = np.where(m > 0, (some[row, np.maximum(m - 1, 0) // 2] + some[row, np.minimum(m // 2, 2 * half)]) / 2, np.nan)
    return out


def _frames_of(table: pa.Table, keys: Sequence[str], position: str, height: str, settings: Sequence[tuple[int, int]], mad_floor: float) -> pa.Table:
    """Own rows of some chunks with _resid and _mad of each setting (half of the window, half of the wide one)."""
    codes = [np.asarray(table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices) for c in keys]
    order = np.lexsort((table.column(position).to_numpy(), *codes))
    changes = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)])
    begin = np.flatnonzero(changes)
    n = np.diff(np.append(begin, len(order)))
    first, end = np.repeat(begin, n), np.repeat(begin + n, n)
    column = table.column(height).combine_chunks()
    h, there = np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False))[order], ~np.asarray(column.is_null())[order]
    own = np.asarray(table.column("_own").combine_chunks().to_numpy(zero_copy_only=False))[order]
    out = table.take(pa.array(order[own]))
    for k, (half, wide) in enumerate(settings):
        resid = h - rolling_medians(h, there, first, end, half)
        mad = 1.4826 * rolling_medians(np.abs(resid), there, first, end, wide)
        mad = np.where(np.isnan(mad) & ~there, mad_floor, np.maximum(mad, mad_floor))
        out = out.append_column(f"_resid{k}", pa.array(resid[own], mask=~there[own])).append_column(f"_mad{k}", pa.array(mad[own]))
    return out


def with_chunks(df: DataFrame, position: str, length: int, halo: int, *, chunk: str = "_chunk", own: str = "_own") -> DataFrame:
    """Cut an ordered sequence into equal chunks that carry ``halo`` neighbours on both sides.

    A frame of at most ``halo`` rows is then complete for every row marked ``own``,
    and no chunk is larger than ``length + 2 * halo``, however long the track is.
    """
    c = F.floor(F.col(position) / F.lit(length)).cast("bigint")
    left = F.floor((F.col(position) - halo) / F.lit(length)).cast("bigint")
    right = F.floor((F.col(position) + halo) / F.lit(length)).cast("bigint")
    return df.withColumn(own, c).withColumn(chunk, F.explode(F.sequence(left, right))).withColumn(own, F.col(own) == F.col(chunk))


def along_track_flags(
    df: DataFrame,
    *,
    height: str,
    beam: str = "beam",
    track: str = "track_id",
    position: str = "pos",
    window: int = 21,
    mad_factor: int = 5,
    n_sigma: float = 5.0,
    mad_floor: float = 0.1,
    chunk_rows: int = 100_000,
    settings: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Residual to a rolling median, rolling scaled MAD, edge exemption and the rejection flag.

    Adds ``resid``, ``mad``, ``interior``, ``bad``; with ``settings``, pairs of a window and a MAD factor, only a flag for each,
    ``bad0``, ``bad1`` and so on, all from one pass. Frames stop at the ends of a track, so one track never sees another;
    positions come from :func:`track_ids`.
    """
    ship(df.sparkSession)
    frames = []
    for w, factor in [(window, mad_factor)] if settings is None else settings:
        wide = max(w * factor, w)
        frames.append(((w + (1 - w % 2)) // 2, (wide + 1 - wide % 2) // 2))
    # Frames of wide windows are sorted in numpy: as arrays of a Spark window each row would collect and sort boxed values.
    ends = df.groupBy(track).agg(F.min(position).alias("_first"), F.max(position).alias("_last"))
    chunks = with_chunks(df.join(ends, track), position, chunk_rows, max(h + w for h, w in frames))
    keys = [beam, "_chunk", track]
    groups = max(df.count() // GROUP_ROWS, df.sparkSession.sparkContext.defaultParallelism)
    dealt = chunks.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    schema = StructType([*dealt.schema.fields, *(StructField(f"{c}{k}", DoubleType()) for k in range(len(frames)) for c in ("_resid", "_mad"))])
    done = dealt.groupBy("_group").applyInArrow(lambda t: _frames_of(t, keys, position, height, frames, mad_floor), schema)
    inside = lambda half: (F.col(position) - F.col("_first") >= half) & (F.col("_last") - F.col(position) >= half)
    bad = lambda k: F.coalesce(inside(frames[k][0]) & (F.abs(f"_resid{k}") > n_sigma * F.col(f"_mad{k}")), F.lit(False))
    if settings is not None:
        return done.select(*df.columns, *[bad(k).alias(f"bad{k}") for k in range(len(frames))])
    columns = [F.col("_resid0").alias("resid"), F.col("_mad0").alias("mad"), inside(frames[0][0]).alias("interior"), bad(0).alias("bad")]
    return done.select(track, *[c for c in df.columns if c != track], *columns)


def track_direction(df: DataFrame, *, track: str = "track_id", time: str = "t_year", y: str = "y", ties: Sequence[str] = ()) -> DataFrame:
    """Ascending when the last y exceeds the first; equal counts as descending."""
    at = F.struct(F.col(time), *[F.col(c) for c in ties])
    return df.groupBy(track).agg(
        (F.max_by(y, at) > F.min_by(y, at)).alias("ascending"), F.count(F.lit(1)).alias("n_pts")
    )


def overpass_leverage(
    df: DataFrame, *, keys: Sequence[str], time: str = "t_year", tolerance: float = 1.0 / 365.25, slice_width: float = 0.25
) -> DataFrame:
    """Sum of squared deviations of pass-mean times per group, passes split at gaps above ``tolerance``.

    Distinct (group, time) values are enough to find the gaps; rows only add weights to the
    mean, so the ordered part runs on pre-aggregated times, cut into slices.
    """
    keys = list(keys)
    # Pre-aggregation: one row per distinct time with its multiplicity.
    times = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_w")).withColumn("_s", _slice(time, slice_width))
    inner = Window.partitionBy(*keys, "_s").orderBy(time)
    per = Window.partitionBy(*keys).orderBy("_s")
    marked = times.withColumn("_new", F.when(F.col(time) - F.lag(time).over(inner) > tolerance, 1).otherwise(0)).withColumn(
        "_k", F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    )
    slices = (
        marked.groupBy(*keys, "_s")
        .agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.sum("_new").alias("_in"))
        .withColumn("_b", F.lag("_hi").over(per))
        .withColumn("_open", F.when(F.col("_b").isNull() | (F.col("_lo") - F.col("_b") > tolerance), 1).otherwise(0))
        .withColumn("_base", F.sum(F.col("_in") + F.col("_open")).over(per.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in"))
        .select(*keys, "_s", "_base")
    )
    return (
        marked.join(slices, [*keys, "_s"])
        .withColumn("_pass", F.col("_base") + F.col("_k"))
        .groupBy(*keys, "_pass")
        .agg((F.sum(F.col(time) * F.col("_w")) / F.sum("_w")).alias("_c"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_passes"), (F.var_pop("_c") * F.count(F.lit(1))).alias("leverage"))
    )
