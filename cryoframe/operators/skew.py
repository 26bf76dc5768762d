"""Exact group statistics that do not depend on how large one group is.

``percentile`` keeps every distinct value of a group in one task. That is the
best plan while a group is bounded, and no plan at all for a group holding a
third of a table. So each function first counts its groups (keys only, map-side
combined) and sends only the groups above ``limit`` through *sliced selection*:

1. a mergeable quantile sketch gives ``STRATA`` edges per large group;
2. rows are counted by (group, slice), which is all that this pass shuffles;
3. a running count over the at most 4,096 slices of a group says which
   slice holds the wanted rank, and only rows of that slice move and are ordered,
   ties as one row with a count.

The sketch decides where work goes, never what the answer is: results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cryoframe.session import cut

GROUP_LIMIT = 2_000_000
STRATA = 64


def large_groups(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame | None:
    """Keys of groups above ``limit`` rows, or None when there are none.

    The result has at most rows/limit rows, which is what makes broadcasting it safe.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return None if hot.isEmpty() else hot.drop("_n")


def split_large(
    df: DataFrame, keys: Sequence[str], hot: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of bounded groups, rows of large groups)."""
    if hot is None:
        return df, None
    small = df.join(F.broadcast(hot), list(keys), "left_anti")
    large = df.join(F.broadcast(hot), list(keys), "left_semi")
    return small, large


def edge_table(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group: ``STRATA`` + 1 edges of equal mass up to the sketch's error."""
    cuts = [float(i) / STRATA for i in range(STRATA + 1)]
    return rows.groupBy(*keys).agg(F.percentile_approx(value, cuts, 20 * STRATA).alias("_e"))


def with_slice(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``_slice``, non-decreasing in the value; needs the column of the edge table.

    A stratum by binary search, then equal widths inside it: plain arithmetic that compiles,
    no per-row loop over an array.
    """
    v = F.col(value)
    out = rows.withColumn("_c0", F.lit(0))
    step = STRATA // 2
    while step:  # binary search: log2(STRATA) small projections
        out = out.withColumn("_c0", F.col("_c0") + F.when(v > F.get("_e", F.col("_c0") + step), step).otherwise(0))
        step //= 2
    low, high = F.get("_e", F.col("_c0")), F.get("_e", F.col("_c0") + 1)
    inner = F.floor(F.try_divide(v - low, high - low) * STRATA)
    inside = F.least(F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)), F.lit(STRATA - 1))
    return out.withColumn("_slice", (F.col("_c0") * STRATA + inside).cast("int")).drop("_c0", "_e")


def _sliced_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # One row per large group: cheap to write, and it spares every later branch the sketch.
    edges = cut(edge_table(rows, keys, "_v"))
    sliced = with_slice(rows.join(F.broadcast(edges), keys), "_v")
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    slices = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_upto", F.sum("_m").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_before", F.col("_upto") - F.col("_m"))
        .withColumn("_total", F.sum("_m").over(Window.partitionBy(*keys)))
    )
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    wanted = cut(
        slices.withColumn("_q", F.explode(names))
        .withColumn("_pos", F.col("_q.p") * (F.col("_total") - 1))
        .withColumn(
            "_r",
            F.explode(
                F.array(
                    F.struct(F.floor("_pos").alias("rank"), (1 - (F.col("_pos") - F.floor("_pos"))).alias("w")),
                    F.struct((F.floor("_pos") + 1).alias("rank"), (F.col("_pos") - F.floor("_pos")).alias("w")),
                )
            ),
        )
        .where((F.col("_r.w") > 0) & (F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_upto")))
        .select(*keys, "_slice", F.col("_q.name").alias("_name"), F.col("_r.w").alias("_w"),
                (F.col("_r.rank") - F.col("_before")).alias("_local"))
    )
    run = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    # Wanted ranks are a few rows a large group, so rows of other slices are dropped where they are.
    picked = (
        sliced.join(F.broadcast(wanted.select(*keys, "_slice").distinct()), [*keys, "_slice"], "left_semi")
        .groupBy(*keys, "_slice", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_to", F.sum("_c").over(run))
        .join(wanted, [*keys, "_slice"])
        .where((F.col("_local") < F.col("_to")) & (F.col("_local") >= F.col("_to") - F.col("_c")))
    )
    return picked.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_name") == n, F.col("_v") * F.col("_w"))).alias(n) for n in probs]
    )


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    limit: int = GROUP_LIMIT,
    hot: DataFrame | None | str = "check",
) -> DataFrame:
    """One row per group: the group's row count ``n`` (non-null values) and linear quantiles."""
    keys = list(keys)
    if not keys:
        whole = df.withColumn("_one", F.lit(1))
        return group_quantiles(whole, ["_one"], value, probs, limit=limit).drop("_one")
    if isinstance(hot, str):
        hot = large_groups(df, keys, limit)
    small, large = split_large(df, keys, hot)
    native = small.groupBy(*keys).agg(
        F.count(value).alias("n"), *[F.percentile(F.col(value), F.lit(float(p))).alias(n) for n, p in probs.items()]
    )
    if large is None:
        return native
    sliced = large.groupBy(*keys).agg(F.count(value).alias("n")).join(
        _sliced_quantiles(large, keys, value, probs), keys, "left"
    )
    return native.unionByName(sliced)


def group_median_mad(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    med: str = "med",
    mad: str = "mad",
    scale: float = 1.4826,
    limit: int = GROUP_LIMIT,
    hot: DataFrame | None | str = "check",
) -> DataFrame:
    """One row per group: ``n``, median and ``scale`` times the median absolute deviation."""
    keys = list(keys)
    if not keys:
        whole = df.withColumn("_one", F.lit(1))
        return group_median_mad(whole, ["_one"], value, med=med, mad=mad, scale=scale, limit=limit).drop("_one")
    if isinstance(hot, str):
        hot = large_groups(df, keys, limit)
    small, large = split_large(df, keys, hot)
    # The window and the aggregate share one hash partitioning: a single shuffle.
    native = (
        small.withColumn("_med", F.median(value).over(Window.partitionBy(*keys)))
        .groupBy(*keys)
        .agg(
            F.count(value).alias("n"),
            F.max("_med").alias(med),
            (F.lit(scale) * F.median(F.abs(F.col(value) - F.col("_med")))).alias(mad),
        )
    )
    if large is None:
        return native
    centre = _sliced_quantiles(large, keys, value, {med: 0.5})
    spread = _sliced_quantiles(
        large.join(F.broadcast(centre), keys).withColumn("_d", F.abs(F.col(value) - F.col(med))), keys, "_d", {mad: 0.5}
    )
    sizes = large.groupBy(*keys).agg(F.count(value).alias("n"))
    sliced = sizes.join(centre, keys, "left").join(spread.withColumn(mad, F.lit(scale) * F.col(mad)), keys, "left")
    return native.unionByName(sliced)


def attach_median_mad(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    n: str = "n",
    med: str = "med",
    mad: str = "mad",
    scale: float = 1.4826,
    limit: int = GROUP_LIMIT,
    hot: DataFrame | None | str = "check",
) -> DataFrame:
    """Every row with its group's row count, median and scaled MAD (E05).

    Rows of large groups are never shuffled by group: their few statistics are broadcast.
    """
    keys = list(keys)
    if isinstance(hot, str):
        hot = large_groups(df, keys, limit)
    small, large = split_large(df, keys, hot)
    w = Window.partitionBy(*keys)
    rows = (
        small.withColumn(n, F.count(F.lit(1)).over(w))
        .withColumn(med, F.median(value).over(w))
        .withColumn(mad, F.lit(scale) * F.median(F.abs(F.col(value) - F.col(med))).over(w))
    )
    if large is None:
        return rows
    sizes = large.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    centre = _sliced_quantiles(large, keys, value, {med: 0.5})
    spread = _sliced_quantiles(
        large.join(F.broadcast(centre), keys).withColumn("_d", F.abs(F.col(value) - F.col(med))), keys, "_d", {mad: 0.5}
    ).withColumn(mad, F.lit(scale) * F.col(mad))
    stats = sizes.join(centre, keys, "left").join(spread, keys, "left")
    return rows.unionByName(large.join(F.broadcast(stats), keys))


def stretch(df: DataFrame, value: str, probs: Mapping[str, float], **kw) -> DataFrame:
    """Quantiles of a whole column as a one-row table."""
    return group_quantiles(df, [], value, probs, **kw).drop("n")
