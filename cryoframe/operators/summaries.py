"""Report-style aggregates: one shuffle each, partial sums first, medians through the skew-safe path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cryoframe.operators.skew import group_quantiles
from cryoframe.operators.spatial import cell


def flag_profile(flags: DataFrame, categories: Sequence[str], floats: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(value counts per categorical flag, percentiles per float flag), both in long form."""
    cats = flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).cast("bigint").alias("value")) for c in categories])).alias("_f"))
    counts = cats.select("_f.*").groupBy("flag", "value").agg(F.count(F.lit(1)).alias("n"))
    nums = flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).cast("double").alias("value")) for c in floats])).alias("_f")).select("_f.*")
    q = group_quantiles(nums.where(F.col("value").isNotNull()), ["flag"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})
    return counts, q


def audit_cube(rows: DataFrame, *, size: float = 50_000.0) -> DataFrame:
    """Counts by (cell, year, state), by (year, state) and by (year, support) in one pass."""
    keyed = rows.select(cell("x", size).alias("cell_x"), cell("y", size).alias("cell_y"), "year", "state", "support")
    return keyed.groupingSets(
        [[F.col("cell_x"), F.col("cell_y"), F.col("year"), F.col("state")], [F.col("year"), F.col("state")], [F.col("year"), F.col("support")]],
        F.col("cell_x"), F.col("cell_y"), F.col("year"), F.col("state"), F.col("support"),
    ).agg(F.count(F.lit(1)).alias("n"))


def multi_level(rows: DataFrame, levels: Sequence[Sequence[str]], value: str, *, terms: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, p10 and p90 of a value at several grouping levels, with term medians.

    Rows are expanded once per level; each level is then an ordinary skew-safe group.
    """
    every = list(dict.fromkeys(k for level in levels for k in level))
    variants = F.array(*[F.struct(F.lit(i).alias("level"), *[(F.col(k) if k in level else F.lit(None)).cast("string").alias(k) for k in every]) for i, level in enumerate(levels)])
    fan = rows.select(value, *terms, F.explode(variants).alias("_l")).select("_l.*", value, *terms)
    fan = fan.select("level", *[F.coalesce(k, F.lit("*")).alias(k) for k in every], value, *terms)
    keys = ["level", *every]
    out = group_quantiles(fan, keys, value, {"median": 0.5, "p10": 0.1, "p90": 0.9}).join(fan.groupBy(*keys).agg(F.avg(value).alias("mean")), keys)
    for t in terms:
        out = out.join(group_quantiles(fan, keys, t, {f"{t}_median": 0.5}).drop("n"), keys)
    return out


def class_report(nodes: DataFrame, classes: Sequence[str], *, column: str = "reliability") -> DataFrame:
    """Per class: count, percent, medians, thinning percent. A class without nodes is a row with n = 0."""
    listed = nodes.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    total = nodes.agg(F.count(F.lit(1)).alias("_total"))
    base = nodes.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg("dhdt").alias("dhdt_mean"), (100 * F.avg((F.col("dhdt") < 0).cast("double"))).alias("thinning_pct"))
    for c, name in (("dhdt", "dhdt_median"), ("nobs", "nobs_median"), ("rmse", "rmse_median"), ("dhdt_err", "sigma_median"), ("snr", "snr_median")):
        base = base.join(group_quantiles(nodes, [column], c, {name: 0.5}).drop("n"), column)
    out = listed.join(base, column, "left").crossJoin(F.broadcast(total))
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("pct", F.when(F.col("n") > 0, 100.0 * F.col("n") / F.col("_total"))).drop("_total")


def density_histogram(df: DataFrame, value: str, low: float, high: float, width: float) -> DataFrame:
    """Share per unit in fixed bins; values outside are left to the tails and not counted."""
    bins = int(round((high - low) / width))
    inside = df.where((F.col(value) >= low) & (F.col(value) < high)).select(F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = inside.agg(F.count(F.lit(1)).alias("_t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / (F.col("_t") * width)).drop("_t").withColumn("left_edge", low + F.col("bin") * width)


def shape(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, median, biased skewness, percent below zero."""
    base = df.agg(F.avg(value).alias("mean"), F.skewness(value).alias("skewness"), (100 * F.avg((F.col(value) < 0).cast("double"))).alias("thinning_pct"))
    return base.crossJoin(F.broadcast(group_quantiles(df, [], value, {"median": 0.5}).drop("n")))


def retention(rows: DataFrame, kept: Column, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(kept).alias("n_kept")).withColumn(
        "fraction", F.try_divide(F.col("n_kept"), F.col("n_before")))


def log_bins(df: DataFrame, x: str, value: str, low: float, high: float, *, bins: int = 15, min_rows: int = 20) -> DataFrame:
    """Quartiles of a value in logarithmic classes of x."""
    span = F.log(F.lit(high / low))
    b = F.floor(F.log(F.col(x) / low) / span * bins).cast("int")
    held = df.where((F.col(x) >= low) & (F.col(x) < high)).withColumn("bin", b)
    return group_quantiles(held, ["bin"], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).where(F.col("n") >= min_rows)


def balanced_panel(series: DataFrame, keys: Sequence[str], value: str, *, year: str = "year") -> DataFrame:
    """Only keys seen in every year, with the anomaly to their first year.

    A key's rows are its years, so the per-key arrays and windows are short.
    """
    years = series.agg(F.count_distinct(year).alias("_all"))
    full = series.groupBy(*keys).agg(F.count_distinct(year).alias("_y"), F.min_by(value, year).alias("_first"))
    kept = full.crossJoin(F.broadcast(years)).where(F.col("_y") == F.col("_all")).select(*keys, "_first")
    return series.join(kept, list(keys)).withColumn("anomaly", F.col(value) - F.col("_first")).drop("_first")


def first_year_anomaly(series: DataFrame, keys: Sequence[str], value: str, *, year: str = "year", out: str = "anomaly") -> DataFrame:
    first = series.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(year))).alias("_first"))
    return series.join(first, list(keys)).withColumn(out, F.col(value) - F.col("_first")).drop("_first")


def reasons_top(rows: DataFrame, reason: str, k: int = 6) -> DataFrame:
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), reason).limit(k)


def representative_regions(points: DataFrame, *, size: float = 50_000.0, min_rows: int = 20_000, floating_share: float = 0.2, n: int = 6, mask_class: str = "mask_class") -> DataFrame:
    """Half floating, half grounded cells, densest first: two bounded top-k lists."""
    g = points.groupBy(cell("x", size).alias("cell_x"), cell("y", size).alias("cell_y")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(mask_class) == 3).cast("double")).alias("floating"))
    dense = g.where(F.col("n") >= min_rows)
    order = [F.col("n").desc(), F.col("cell_x"), F.col("cell_y")]
    half = n // 2
    a = dense.where(F.col("floating") > floating_share).orderBy(*order).limit(half).withColumn("kind", F.lit("floating"))
    b = dense.where(F.col("floating") <= floating_share).orderBy(*order).limit(n - half).withColumn("kind", F.lit("grounded"))
    return a.unionByName(b)


def longest_pass(points: DataFrame, key: str, *, min_rows: int = 3000) -> DataFrame:
    """The group with the longest bounding-box diagonal among those large enough. One row."""
    g = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diagonal"))
    return g.where(F.col("n") >= min_rows).orderBy(F.col("diagonal").desc(), key).limit(1)


def head_tail(series: DataFrame, keys: Sequence[str], box: str, value: str, *, k: int = 3) -> DataFrame:
    """Median of the first and of the last ``k`` boxes per group; a group holds one row per box."""
    up, down = Window.partitionBy(*keys).orderBy(box), Window.partitionBy(*keys).orderBy(F.col(box).desc())
    r = series.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).where((F.col("_u") <= k) | (F.col("_d") <= k))
    return r.groupBy(*keys).agg(F.median(F.when(F.col("_u") <= k, F.col(value))).alias("head"), F.median(F.when(F.col("_d") <= k, F.col(value))).alias("tail"))


def coverage_counts(rows: DataFrame, year: str, sensor: str, track: str) -> DataFrame:
    """Rows and distinct tracks by year and by year and sensor."""
    return rows.groupingSets([[F.col(year)], [F.col(year), F.col(sensor)]], F.col(year), F.col(sensor)).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(track).alias("n_tracks"))


def years_without(rows: DataFrame, year: str, first: int, last: int) -> DataFrame:
    span = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(year))
    return span.join(rows.select(F.col(year).cast("int").alias(year)).distinct(), year, "left_anti")


def bootstrap_median(df: DataFrame, value: str, *, draws: int, index: str, seed: int = 0, alpha: float = 0.05, pick: Column | None = None) -> DataFrame:
    """Percentile interval of the median over resamples with replacement.

    ``index`` numbers the rows 0..n-1. Each replicate draws n indexes by hash and looks them up
    by equi-join, so a replicate is a set of rows spread over the cluster. ``pick`` may give
    the drawn index as a Column of (``rep``, ``slot``, ``_n``) in place of the seeded hash.
    """
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    slots = df.select(F.col(index).cast("bigint").alias("slot")).crossJoin(F.broadcast(n)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = pick if pick is not None else F.pmod(F.xxhash64(F.lit(seed), "rep", "slot"), F.col("_n"))
    taken = slots.withColumn("_i", drawn).join(df.select(F.col(index).cast("bigint").alias("_i"), value), "_i")
    medians = group_quantiles(taken, ["rep"], value, {"m": 0.5})
    return medians.agg(
        F.percentile("m", F.lit(alpha / 2)).alias("ci_lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("ci_hi"), F.count(F.lit(1)).alias("draws"))


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of several columns in long form."""
    fan = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_v")).select("_v.*")
    return group_quantiles(fan.where(F.col("value").isNotNull()), ["variable"], "value", probs)
