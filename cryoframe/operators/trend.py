"""Mann-Kendall and Sen per node series.

A series has one row per node and period, so its length is the number of periods: it
is held as one sorted array and its pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryoframe.operators.ranks import fdr, kendall_exact_table, normal_p
from cryoframe.session import cut


def _pairs(series: str, same: str | None = None) -> Column:
    """Struct (dt, dy) of every later minus earlier element, inside the same ``same`` field if given."""
    items = F.col(series)

    def later(a: Column, i: Column) -> Column:
        rest = F.slice(items, i + 2, F.size(items))
        keep = F.filter(rest, lambda b: (b["t"] > a["t"]) & ((b[same] == a[same]) if same else F.lit(True)))
        return F.transform(keep, lambda b: F.struct((b["t"] - a["t"]).alias("dt"), (b["v"] - a["v"]).alias("dy")))

    return F.flatten(F.transform(items, later))


def _median_of(arr: Column) -> Column:
    n = F.size(arr)
    return F.when(n > 0, (F.try_element_at(arr, ((n + 1) / 2).cast("int")) + F.try_element_at(arr, (n / 2).cast("int") + 1)) / 2)


def _tie_sum(values: Column, f) -> Column:
    """Sum of f(multiplicity) over the distinct values of an array."""
    counts = F.transform(F.array_distinct(values), lambda d: F.size(F.filter(values, lambda x: x == d)).cast("double"))
    return F.aggregate(F.transform(counts, f), F.lit(0.0), lambda acc, c: acc + c)


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def _label(p: Column, slope: Column, alpha: float) -> Column:
    return (
        F.when(p.isNull(), "insufficient")
        .when((p < alpha) & (slope < 0), "decreasing")
        .when((p < alpha) & (slope > 0), "increasing")
        .otherwise("no_trend")
    )


def mann_kendall_sen(series: DataFrame, keys: Sequence[str], *, time: str = "year", value: str = "h_node", alpha: float = 0.05) -> DataFrame:
    """tau-b, p (exact for short tie-free series, else normal), Sen slope with its interval, intercept, label."""
    grouped = (
        series.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v")))).alias("_z"))
        .withColumn("n", F.size("_z"))
        .where(F.col("n") >= 3)
        .withColumn("_p", _pairs("_z"))
        .withColumn("_s", _total(F.transform("_p", lambda q: F.signum(q["dy"]))))
        .withColumn("_slopes", F.sort_array(F.transform("_p", lambda q: q["dy"] / q["dt"])))
        .withColumn("_v", F.col("_z.v"))
    )
    n = F.col("n").cast("double")
    y2 = _tie_sum(F.col("_v"), lambda c: c * (c - 1) / 2)
    y1 = _tie_sum(F.col("_v"), lambda c: c * (c - 1) * (2 * c + 5))
    all_pairs = n * (n - 1) / 2
    var = (n * (n - 1) * (2 * n + 5) - F.col("_y1")) / 18
    z_half = NormalDist().inv_cdf(1 - alpha / 2)
    m = F.size("_slopes")
    spread = F.lit(z_half) * F.sqrt(F.greatest(var, F.lit(0.0)))
    hi = F.least(F.rint((m + spread) / 2).cast("int"), m - 1)
    lo = F.greatest(F.rint((m - spread) / 2).cast("int") - 1, F.lit(0))
    body = (
        grouped.withColumn("_y2", y2)
        .withColumn("_y1", y1)
        .withColumn("tau", F.try_divide(F.col("_s"), F.sqrt(all_pairs * (all_pairs - F.col("_y2")))))
        .withColumn("sens_slope", _median_of(F.col("_slopes")))
        .withColumn("sens_lo", F.try_element_at("_slopes", lo + 1))
        .withColumn("sens_hi", F.try_element_at("_slopes", hi + 1))
        .withColumn(
            "intercept",
            _median_of(F.sort_array(F.col("_v"))) - F.col("sens_slope") * _median_of(F.sort_array(F.col("_z.t"))),
        )
        .withColumn("_dis", F.when((F.col("_y2") == 0) & (F.col("n") <= 33), ((all_pairs - F.col("_s")) / 2).cast("int")))
    )
    # The exact distribution up to n = 33 is a fixed table of a few thousand rows.
    exact = series.sparkSession.createDataFrame(kendall_exact_table(), "n int, _dis int, _pe double")
    return (
        body.join(F.broadcast(exact), ["n", "_dis"], "left")
        .withColumn("p_value", F.when(F.col("_y2") < all_pairs, F.coalesce("_pe", normal_p(F.col("_s") / F.sqrt(var)))))
        .withColumn("trend", _label(F.col("p_value"), F.col("sens_slope"), alpha))
        .select(*keys, "n", "tau", "p_value", "sens_slope", "sens_lo", "sens_hi", "intercept", "trend")
    )


def seasonal_mann_kendall_sen(
    series: DataFrame, keys: Sequence[str], *, time: str = "year", month: str = "month", value: str = "h_node", alpha: float = 0.05
) -> DataFrame:
    """The same with pairs inside one calendar month only, so the annual cycle cancels."""
    rows = series.where(F.col(value).isNotNull() & F.col(time).isNotNull() & F.col(month).between(1, 12))
    z = (
        rows.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v"), F.col(month).cast("int").alias("m")))).alias("_z"))
        .where(F.size("_z") >= 4)
        .withColumn("_p", _pairs("_z", "m"))
        .withColumn("_s", _total(F.transform("_p", lambda q: F.signum(q["dy"]))))
        .withColumn("_slopes", F.sort_array(F.transform("_p", lambda q: q["dy"] / q["dt"])))
    )

    def month_variance(m: Column) -> Column:
        vals = F.transform(F.filter("_z", lambda e: e["m"] == m), lambda e: e["v"])
        k = F.size(vals).cast("double")
        return F.when(k >= 2, (k * (k - 1) * (2 * k + 5) - _tie_sum(vals, lambda c: c * (c - 1) * (2 * c + 5))) / 18).otherwise(0.0)

    def month_used(m: Column) -> Column:
        k = F.size(F.filter("_z", lambda e: e["m"] == m))
        return F.when(k >= 2, k).otherwise(0).cast("double")

    months = F.sequence(F.lit(1), F.lit(12))
    q = NormalDist().inv_cdf(1 - alpha / 2)
    m = F.size("_slopes")
    reach = F.lit(q) * F.sqrt("_var")
    lo = F.greatest(F.floor((m - reach) / 2).cast("int"), F.lit(0))
    hi = F.least(F.ceil((m + reach) / 2).cast("int"), m - 1)
    score = F.when(F.col("_s") > 0, F.col("_s") - 1).when(F.col("_s") < 0, F.col("_s") + 1).otherwise(0.0) / F.sqrt("_var")
    return (
        z.withColumn("_var", _total(F.transform(months, month_variance)))
        .withColumn("n", _total(F.transform(months, month_used)).cast("int"))
        .where((F.col("_var") > 0) & (F.size("_slopes") > 0))
        .withColumn("tau", F.col("_s") / m)
        .withColumn("p_value", normal_p(score))
        .withColumn("sens_slope", _median_of(F.col("_slopes")))
        .withColumn("sens_lo", F.try_element_at("_slopes", lo + 1))
        .withColumn("sens_hi", F.try_element_at("_slopes", hi + 1))
        .withColumn("intercept", _median_of(F.sort_array(F.transform("_z", lambda e: e["v"] - F.col("sens_slope") * e["t"]))))
        .withColumn("trend", _label(F.col("p_value"), F.col("sens_slope"), alpha))
        .select(*keys, "n", "tau", "p_value", "sens_slope", "sens_lo", "sens_hi", "intercept", "trend")
    )


def trend_table(
    series: DataFrame, keys: Sequence[str] = ("node_x", "node_y"), *, variant: str = "auto", min_epochs: int = 4, alpha: float = 0.05,
    time: str = "year", month: str = "month", value: str = "h_node", correct: bool = True,
) -> DataFrame:
    """Trend per node with false-discovery control over all tested nodes; the label follows that decision."""
    if variant not in ("original", "auto", "seasonal"):
        raise ValueError(f"unknown variant {variant!r}")
    if variant == "seasonal" and month not in series.columns:
        raise ValueError("the seasonal variant needs a month column")
    series = cut(series)  # one row a node and period, read by every part of the test
    enough = series.groupBy(*keys).agg(F.count_distinct(time).alias("_e")).where(F.col("_e") >= min_epochs).select(*keys)
    held = series.join(enough, list(keys), "left_semi")
    fn = seasonal_mann_kendall_sen if variant == "seasonal" else mann_kendall_sen
    extra = {"month": month} if variant == "seasonal" else {}
    tested = fn(held, keys, time=time, value=value, alpha=alpha, **extra).where(F.col("trend") != "insufficient").withColumnRenamed("n", "n_epochs")
    tested = cut(tested)
    if not correct:
        return tested.withColumn("p_fdr", F.col("p_value")).withColumn("significant", F.col("p_value") <= alpha)
    judged = fdr(tested, "p_value", alpha=alpha)
    return judged.withColumn(
        "trend",
        F.when(~F.col("significant"), "no_trend").when(F.col("sens_slope") < 0, "decreasing").otherwise("increasing"),
    )


def sampling_check(months: DataFrame, *, time: str = "t_year", surfaces: str = "n_refsurfs", year: str = "year", month: str = "month") -> DataFrame:
    """Correlation of time with the number of reference surfaces: a drift in sampling can pose as a trend."""
    return months.agg(
        F.corr(time, surfaces).alias("r_time_sampling"), F.count_distinct(year, month).alias("n_months"), F.avg(surfaces).alias("mean_surfaces")
    )
