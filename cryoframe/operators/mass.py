"""Mass change and its uncertainty; regional series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryoframe.functions.physics import ICE_DENSITY, KG_PER_GT, OCEAN_AREA_M2
from cryoframe.operators.summaries import balanced_panel


def mass_balance(
    grid: DataFrame, cell_m: float, correlation_length: float, *, value: str = "pred", var: str | None = "var", by: Sequence[str] = (),
    ice_density: float = ICE_DENSITY, ocean_area: float = OCEAN_AREA_M2,
) -> DataFrame:
    """Volume, mass and sea-level rate with independent and correlated uncertainty, in one aggregate."""
    a = cell_m**2
    gpm = ocean_area * 1e-3 * 1000.0 / KG_PER_GT
    to_gt = ice_density / KG_PER_GT
    v = F.col(value)
    ok = F.when(v.isNotNull() & (F.col(var) >= 0), F.col(var)) if var else F.lit(None).cast("double")
    held = grid.where(v.isNotNull())
    g = (held.groupBy(*by) if by else held).agg(F.count(F.lit(1)).alias("n_cells"), F.sum(v).alias("_sum"), F.avg(v).alias("dhdt_mean"), F.coalesce(F.sqrt(F.avg(ok)), F.lit(0.0)).alias("sigma_bar"))
    area = F.col("n_cells") * a
    ind = F.col("sigma_bar") * F.sqrt(area * a)
    cor = F.col("sigma_bar") * F.sqrt(area * (math.pi * correlation_length**2))
    return (
        g.withColumn("area_km2", area / 1e6).withColumn("dvdt_m3", F.col("_sum") * a).withColumn("dmdt_gt", F.col("dvdt_m3") * to_gt)
        .withColumn("sle_mm", -F.col("dmdt_gt") / gpm).withColumn("sigma_gt_independent", ind * to_gt).withColumn("sigma_gt_correlated", cor * to_gt)
        .withColumn("sigma_sle_correlated", F.col("sigma_gt_correlated") / gpm).withColumn("inflation", F.when(F.col("sigma_bar") > 0, F.lit(math.sqrt(math.pi) * correlation_length / cell_m)))
        .drop("_sum")
    )


def two_component_sigma(area_m2: Column, cell_m: float, sigma_white: Column, sigma_corr: Column, length_corr: float, *, length_white: float | None = None, ice_density: float = ICE_DENSITY) -> dict[str, Column]:
    """White error over its own cell, correlated error over pi L^2; variances add."""
    aw = cell_m**2 if length_white is None else math.pi * length_white**2
    w, c = sigma_white**2 * area_m2 * aw, sigma_corr**2 * area_m2 * (math.pi * length_corr**2)
    k = ice_density / KG_PER_GT
    return {"sigma_gt": F.sqrt(w + c) * k, "white_gt": F.sqrt(w) * k, "correlated_gt": F.sqrt(c) * k}


def systematic_sigma(df: DataFrame, sigma: str, cell_m: float, *, ice_density: float = ICE_DENSITY) -> DataFrame:
    """A fully correlated error: the mean sigma over the whole area, not reduced by the number of cells."""
    return df.agg(F.avg(sigma).alias("sigma_mean"), F.count(F.lit(1)).alias("n")).withColumn("sigma_gt", F.col("sigma_mean") * F.col("n") * (cell_m**2 * ice_density / KG_PER_GT))


def rate_sweep(grid: DataFrame, cell_m: float, correlation_length: float, rates: Sequence[float] = (-0.1, -0.05, -0.02, 0.0, 0.02, 0.05, 0.1), *, value: str = "pred", var: str | None = "var") -> DataFrame:
    """The balance after removing each uniform rate, and its change against removing none."""
    fan = grid.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates]))).withColumn(value, F.col(value) - F.col("rate"))
    b = mass_balance(fan, cell_m, correlation_length, value=value, var=var, by=["rate"])
    zero = b.where(F.col("rate") == 0).select(F.col("dmdt_gt").alias("_z"))
    return b.crossJoin(F.broadcast(zero)).withColumn("delta_gt", F.col("dmdt_gt") - F.col("_z")).drop("_z")


def cumulative_mass(series: DataFrame, keys: Sequence[str], value: str, cell_m: float, *, year: str = "year", ice_density: float = ICE_DENSITY) -> DataFrame:
    """Mean anomaly of the balanced panel times its area: mass by year. The mean, because mass is a sum."""
    panel = balanced_panel(series, keys, value, year=year)
    k = cell_m**2 * ice_density / KG_PER_GT
    return panel.groupBy(year).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("anomaly").alias("mean_anomaly")).withColumn(
        "mass_gt", F.col("mean_anomaly") * F.col("n_nodes") * k).withColumn("mwe", F.col("mean_anomaly") * ice_density / 1000)


def calibrate_slope_error(flags: DataFrame, *, slope: str, sigma: str, bins: int = 24, min_per_bin: int = 500) -> DataFrame:
    """sigma^2 = v0^2 + (sh * slope)^2 from medians in quantile classes of slope. One row."""
    from cryoframe.operators.ranks import quartile_class
    from cryoframe.operators.skew import group_quantiles, large_groups

    binned = quartile_class(flags.where(F.col(slope).isNotNull() & F.col(sigma).isNotNull()), slope, "bin", parts=bins)
    hot = large_groups(binned, ["bin"])
    m = group_quantiles(binned, ["bin"], slope, {"_s": 0.5}, hot=hot).join(group_quantiles(binned, ["bin"], sigma, {"_e": 0.5}, hot=hot).drop("n"), "bin").where(F.col("n") >= min_per_bin)
    sq = m.select((F.col("_s") ** 2).alias("x"), (F.col("_e") ** 2).alias("y"))
    fit = sq.agg(F.regr_slope("y", "x").alias("_b"), F.regr_intercept("y", "x").alias("_a"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n_bins"))
    return fit.select(F.sqrt(F.greatest("_a", F.lit(0.0))).alias("sigma_vertical"), F.sqrt(F.greatest("_b", F.lit(0.0))).alias("sigma_horizontal"), "r2", "n_bins")


SEA_DENSITY, HEAT_CAPACITY = 1027.0, 3990.0


def layer_metrics(
    profiles: DataFrame, keys: Sequence[str], *, depth: str = "depth", low: float = 400.0, high: float = 1000.0, thermal: str = "thermal_driving",
    temperature: str = "theta", salinity: str = "salinity", u: str = "u", v: str = "v", warm: float = 0.0, salty: float = 34.5,
) -> DataFrame:
    """Thickness-weighted layer metrics of ocean profiles, thermal driving supplied.

    A level's thickness runs half way to its neighbours; only levels inside the layer count.
    A profile has as many rows as levels, so its window is short.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(depth)
    d, up, down = F.col(depth), F.col("_up"), F.col("_down")
    held = profiles.withColumn("_up", F.lag(depth).over(w)).withColumn("_down", F.lead(depth).over(w))
    held = held.withColumn("_tu", F.lag(temperature).over(w)).withColumn("_td", F.lead(temperature).over(w))
    top = F.coalesce((d + up) / 2, F.greatest(d - (down - d) / 2, F.lit(0.0)))
    bottom = F.coalesce((d + down) / 2, F.least(d + (d - up) / 2, F.lit(high)))
    hu, hd, t = d - up, down - d, F.col(temperature)
    inner = (hu * hu * F.col("_td") + (hd * hd - hu * hu) * t - hd * hd * F.col("_tu")) / (hu * hd * (hu + hd))
    grad = F.coalesce(inner, (F.col("_td") - t) / hd, (t - F.col("_tu")) / hu)
    held = held.withColumn("_w", F.when(d.between(low, high), F.greatest(bottom - top, F.lit(0.0)))).withColumn("_g", F.when(d.between(100.0, high), grad))
    weight = F.col("_w")
    mean = lambda c: F.try_divide(F.sum(weight * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), weight)))
    seen = F.count(F.when(weight.isNotNull(), F.col(thermal))) > 0
    is_warm = (F.col(temperature) >= warm) & (F.col(salinity) >= salty)
    return (
        held.groupBy(*keys)
        .agg(mean(thermal).alias("thermal_driving"), mean(u).alias("u_mean"), mean(v).alias("v_mean"),
             F.when(seen, F.sum(F.greatest(F.col(thermal), F.lit(0.0)) * weight) * (SEA_DENSITY * HEAT_CAPACITY)).alias("heat_content"),
             F.when(seen, F.coalesce(F.sum(F.when(is_warm, weight)), F.lit(0.0))).alias("warm_thickness"),
             F.max_by(depth, F.when(F.col("_g").isNotNull(), F.struct("_g", F.negate(F.col(depth))))).alias("thermocline_depth"))
        .withColumn("speed_mean", F.hypot("u_mean", "v_mean"))
    )
