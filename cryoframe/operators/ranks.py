"""Global order without a global window: ranks, quantile classes, false-discovery control, folds.

Values are first reduced to (value, count), then cut into slices; running totals over
the slices are a small table. No window in this module spans a whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cryoframe.operators.skew import edge_table, group_quantiles, with_slice


def value_positions(df: DataFrame, value: str) -> DataFrame:
    """(value, count, below, total): how many rows hold a smaller value, for each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("count"))
    edges = edge_table(counts, [], value)
    sliced = with_slice(counts.crossJoin(F.broadcast(edges)), value).withColumnRenamed("_slice", "_s")
    # At most STRATA squared rows reach this window.
    run = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        sliced.groupBy("_s").agg(F.sum("count").alias("_m"))
        .withColumn("_upto", F.sum("_m").over(run))
        .withColumn("total", F.sum("_m").over(Window.partitionBy()))
        .select("_s", (F.col("_upto") - F.col("_m")).alias("_before"), "total")
    )
    inner = Window.partitionBy("_s").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.join(F.broadcast(offsets), "_s")
        .withColumn("below", F.col("_before") + F.sum("count").over(inner) - F.col("count"))
        .drop("_s", "_before")
    )


def with_average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the 1-based average rank; ties share the mean of their places, null stays null."""
    pos = value_positions(df, value).select(F.col(value).alias("_v"), (F.col("below") + (F.col("count") + 1) / 2).alias(out))
    return df.join(pos, F.col(value) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the rank correlation over rows where both are present."""
    both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = with_average_rank(with_average_rank(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("spearman_r"))


def _t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t through the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    inc = front * f / a
    return 0.5 * (1 - inc if flip else inc)


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return 2 * _t_sf(abs(t), df) if df > 0 and math.isfinite(t) else math.nan


@F.pandas_udf(T.DoubleType())
def _student_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_p(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal deviate."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None).astype("float64")


def spatial_correlation(df: DataFrame, a: str, b: str, *, correlation_length: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation with the naive p and the p for the effective sample size
    area / (pi L^2), held between 2 and n. One row."""
    both = df.select(x, y, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = with_average_rank(with_average_rank(both, a, "_ra"), b, "_rb")
    area = (F.max(x) - F.min(x)) * (F.max(y) - F.min(y))
    one = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("spearman_r"), area.alias("_area"))
    one = one.withColumn(
        "n_effective", F.greatest(F.least(F.col("_area") / (math.pi * correlation_length**2), F.col("n").cast("double")), F.lit(2.0))
    )
    t = lambda n: F.col("spearman_r") * F.sqrt((n - 2) / (1 - F.col("spearman_r") ** 2))
    ok = F.abs("spearman_r") < 1
    return (
        one.withColumn("p_naive", _student_udf(F.when(ok, t(F.col("n"))), (F.col("n") - 2).cast("double")))
        .withColumn("p_corrected", _student_udf(F.when(ok & (F.col("n_effective") > 3), t(F.col("n_effective"))), F.col("n_effective") - 2))
        .withColumn("significant_naive", F.coalesce(F.col("p_naive") < 0.05, F.lit(False)))
        .withColumn("significant_corrected", F.coalesce(F.col("p_corrected") < 0.05, F.lit(False)))
        .drop("_area")
    )


def fdr(df: DataFrame, p: str, *, alpha: float = 0.05, adjusted: str = "p_fdr", reject: str = "significant") -> DataFrame:
    """Benjamini-Hochberg. Equal p share one adjusted value, so the work is on distinct p:
    slices of about equal numbers of them by a quantile sketch, a running count upward, a running minimum downward."""
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_c"))
    edges = edge_table(counts, [], p)  # one row
    sliced = with_slice(counts.crossJoin(F.broadcast(edges)), p).withColumnRenamed("_slice", "_s")
    down = Window.orderBy("_s")  # over the slices, at most some thousand
    slices = sliced.groupBy("_s").agg(F.sum("_c").alias("_m"))
    slices = slices.withColumn("_upto", F.sum("_m").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_m").over(Window.partitionBy()))
    slices = slices.withColumn("_before", F.col("_upto") - F.col("_m"))
    inner = Window.partitionBy("_s").orderBy(p)
    ranked = sliced.join(slices.select("_s", "_before", "_all"), "_s").withColumn(
        "_raw", F.col(p) * F.col("_all") / (F.col("_before") + F.sum("_c").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    )
    later = (
        ranked.groupBy("_s").agg(F.min("_raw").alias("_best"))
        .withColumn("_rest", F.min("_best").over(down.rowsBetween(1, Window.unboundedFollowing)))
        .select("_s", "_rest")
    )
    own = F.min("_raw").over(inner.rowsBetween(0, Window.unboundedFollowing))
    table = ranked.withColumn("_own", own).join(later, "_s").select(
        F.col(p).alias("_p"), F.least(F.col("_own"), F.col("_rest"), F.lit(1.0)).alias(adjusted)
    )
    return df.join(table, F.col(p) == F.col("_p"), "left").drop("_p").withColumn(reject, F.coalesce(F.col(adjusted) <= alpha, F.lit(False)))


def quartile_class(df: DataFrame, value: str, out: str = "quartile", *, parts: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Right-closed quantile classes 0..parts-1 with linear edges; duplicate edges collapse."""
    names = {f"_q{i}": i / parts for i in range(parts + 1)}
    edges = group_quantiles(df, by, value, names).drop("n")
    all_edges = F.array_distinct(F.array(*names))
    one = edges.select(*by, all_edges.alias("_edges"))
    held = df.join(one, list(by), "left") if by else df.crossJoin(F.broadcast(one))
    below = F.size(F.filter(F.col("_edges"), lambda e: e < F.col(value)))
    return held.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("_edges")


def block_folds(df: DataFrame, n_folds: int, key: Sequence[str], *, order: Column | None = None, seed: int = 0, out: str = "fold") -> DataFrame:
    """Whole units (blocks, tracks) dealt round-robin to folds in a seeded order.

    Units are counted, ordered by hash slice in two levels, and joined back.
    """
    units = df.select(*key).distinct().withColumn("_o", order if order is not None else F.xxhash64(F.lit(seed), *key))
    if order is None:
        units = units.withColumn("_s", F.shiftright("_o", 54))
    else:
        edges = edge_table(units, [], "_o")
        units = with_slice(units.crossJoin(F.broadcast(edges)), "_o").withColumnRenamed("_slice", "_s")
    inner = Window.partitionBy("_s").orderBy("_o", *key)
    sizes = units.groupBy("_s").agg(F.count(F.lit(1)).alias("_m"))
    sizes = sizes.withColumn("_b", F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).drop("_m")
    dealt = units.withColumn("_r", F.row_number().over(inner)).join(sizes, "_s")
    dealt = dealt.select(*key, F.pmod(F.col("_b") + F.col("_r") - 1, F.lit(n_folds)).cast("int").alias(out))
    return df.join(dealt, list(key))


def leaked(train: DataFrame, test: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row: observations that are in both parts. Zero, or the split is wrong."""
    both = train.select(*ids).intersect(test.select(*ids))
    return both.agg(F.count(F.lit(1)).alias("n_leaked"))


def assert_no_leak(train: DataFrame, test: DataFrame, ids: Sequence[str]) -> None:
    n = leaked(train, test, ids).first()["n_leaked"]
    if n:
        raise AssertionError(f"{n} observations are in both train and test")


def hash_sample(df: DataFrame, n: int, ids: Sequence[str], *, by: Sequence[str] = (), seed: int = 0, order: Column | None = None) -> DataFrame:
    """At most ``n`` rows per ``by``, without replacement, the same ones on every run (F01)."""
    key = order if order is not None else F.xxhash64(F.lit(seed), *ids)
    if not by:
        return df.orderBy(key, *ids).limit(n)
    w = Window.partitionBy(*by).orderBy(key, *ids)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def kendall_exact_table(n_max: int = 33) -> list[tuple[int, int, float]]:
    """(n, discordant, two-sided p) without ties, from the recurrence over inversion counts."""
    rows, counts = [], np.ones(1)
    for n in range(2, n_max + 1):
        grown = np.zeros(n * (n - 1) // 2 + 1)
        for shift in range(n):
            grown[shift : shift + counts.size] += counts
        counts = grown / n  # kept as probabilities, so nothing overflows
        cum = np.cumsum(counts)
        top = n * (n - 1) // 2
        for d in range(top + 1):
            c = min(d, top - d)
            rows.append((n, d, 1.0 if 2 * c == top else min(1.0, 2.0 * float(cum[c]))))
    return rows
