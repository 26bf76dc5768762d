"""Filters, decisions and class labels as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_WATER, BARE_ROCK, GROUNDED, FLOATING = 0, 1, 2, 3


@dataclass(frozen=True)
class FlagLimits:
    """Thresholds of the segment flags; None switches a rule off."""

    require_zero_quality: bool = True
    max_spread: float | None = 1.0
    max_significance: float | None = None
    min_photons: float | None = None
    max_msw: float | None = 4
    max_cloud: float | None = None
    max_blowing_snow: float | None = None
    max_dem_difference: float | None = 100.0


def flag_rules(columns: Sequence[str], limits: FlagLimits, height: str | None = None) -> dict[str, Column]:
    """Rejection rule per criterion that is on and whose column exists. Null never rejects,
    except in the quality test, where an unknown quality is not zero."""
    above = {
        "h_robust_sprd": limits.max_spread,
        "snr_significance": limits.max_significance,
        "msw_flag": limits.max_msw,
        "cloud_flg_asr": limits.max_cloud,
        "bsnow_conf": limits.max_blowing_snow,
    }
    rules: dict[str, Column] = {}
    if limits.require_zero_quality and "atl06_quality_summary" in columns:
        rules["quality"] = ~F.col("atl06_quality_summary").eqNullSafe(F.lit(0))
    for name, bound in above.items():
        if bound is not None and name in columns:
            rules[name] = F.coalesce(F.col(name) > bound, F.lit(False))
    if limits.min_photons is not None and "n_fit_photons" in columns:
        rules["n_fit_photons"] = F.coalesce(F.col("n_fit_photons") < limits.min_photons, F.lit(False))
    if limits.max_dem_difference is not None and height and "dem_h" in columns:
        rules["dem_h"] = F.coalesce(F.abs(F.col(height) - F.col("dem_h")) > limits.max_dem_difference, F.lit(False))
    return rules


def flag_keep(rules: Mapping[str, Column]) -> Column:
    keep: Column = F.lit(True)
    for bad in rules.values():
        keep = keep & ~bad
    return keep


def flag_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows each rule alone rejects, in one map-side combined aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flag_keep(rules)).alias("kept"),
        *[F.count_if(bad).alias(f"bad_{name}") for name, bad in rules.items()],
    )


def in_box(x: str, y: str, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.col(x).between(x0, x1) & F.col(y).between(y0, y1)


def grounded_keep(mask_class: Column, to_nongrounded: Column, to_floating: Column, coast_m: float, line_m: float) -> Column:
    return F.coalesce((mask_class == GROUNDED) & (to_nongrounded >= coast_m) & (to_floating >= line_m), F.lit(False))


def grounded_reason(mask_class: Column, to_nongrounded: Column, to_floating: Column, coast_m: float, line_m: float) -> Column:
    return (
        F.when(~mask_class.eqNullSafe(F.lit(GROUNDED)), "class")
        .when(~F.coalesce(to_nongrounded >= coast_m, F.lit(False)), "coast")
        .when(~F.coalesce(to_floating >= line_m, F.lit(False)), "grounding_line")
        .otherwise("kept")
    )


def shelf_keep(mask_class: Column, to_water: Column, to_grounded: Column, zone_m: float, front_m: float) -> Column:
    return F.coalesce((mask_class == FLOATING) & (to_grounded >= zone_m) & (to_water >= front_m), F.lit(False))


# Published reliability thresholds.
RELIABILITY: dict[str, dict[str, float]] = {
    "reliable": {"min_obs": 5000, "min_years": 5, "max_rmse": 1.0, "max_sigma": 0.15, "min_snr": 2.0, "min_span": 4.0},
    "acceptable": {"min_obs": 500, "min_years": 4, "max_rmse": 2.5, "max_sigma": 0.5, "min_snr": 0.0, "min_span": 3.0},
}


def _meets(th: Mapping[str, float], years: Column) -> Column:
    ok = (
        F.col("dhdt").isNotNull()
        & (F.col("dhdt_err") > 0)
        & (F.col("nobs") >= th["min_obs"])
        & (years >= th["min_years"])
        & (F.col("rmse") <= th["max_rmse"])
        & (F.col("dhdt_err") <= th["max_sigma"])
        & (F.col("tspan") >= th["min_span"])
    )
    if th["min_snr"] > 0:
        ok = ok & (F.try_divide(F.abs(F.col("dhdt")), F.col("dhdt_err")) >= th["min_snr"])
    return F.coalesce(ok, F.lit(False))


def classify_nodes(nodes: DataFrame, criteria: Mapping[str, Mapping[str, float]] = RELIABILITY) -> DataFrame:
    """Reliability label with the two numbers it rests on. ``tspan`` stands in for a missing year count."""
    years = F.col("n_years_node" if "n_years_node" in nodes.columns else "tspan").cast("double")
    return (
        nodes.withColumn("snr", F.try_divide(F.abs(F.col("dhdt")), F.col("dhdt_err")))
        .withColumn("n_years_used", years)
        .withColumn(
            "reliability",
            F.when(_meets(criteria["reliable"], years), "reliable")
            .when(_meets(criteria["acceptable"], years), "acceptable")
            .otherwise("unreliable"),
        )
    )


def joint_class(fast_speed: float = 100.0, min_pixels: int = 5, z: float = 1.96) -> dict[str, Column]:
    """Trend against speed. Without a speed or an error a node is inconclusive, never stable by omission."""
    d, s = F.col("dhdt"), F.col("dhdt_err")
    has_v = F.coalesce(F.col("speed").isNotNull() & (F.col("n_pixels") >= min_pixels), F.lit(False))
    has_s = F.coalesce(s > 0, F.lit(False))
    thinning = F.coalesce(has_s & (d + z * s < 0), F.lit(False))
    stable = F.coalesce(has_s & (F.abs(d) <= z * s), F.lit(False))
    fast = F.coalesce(has_v & (F.col("speed") >= fast_speed), F.lit(False))
    label = (
        F.when(stable & fast, "stable_fast")
        .when(stable & has_v, "stable_slow")
        .when(thinning & fast, "thinning_fast")
        .when(thinning & has_v, "thinning_slow")
        .otherwise("inconclusive")
    )
    return {"velocity_available": has_v, "thinning_significant": thinning, "compatible_with_zero": stable,
            "fast_flow": fast, "joint_class": label}


def parcel_reliability(displacement: Column, rmse: Column) -> Column:
    return (
        F.when((displacement < 5000) & (rmse <= 2), "reliable")
        .when(displacement < 10000, "acceptable")
        .otherwise("unreliable")
    )


def support_class(distance: Column, high_m: float, max_m: float, near_m: float = 7500.0) -> Column:
    return (
        F.when(distance <= near_m, "observed_near")
        .when(distance <= high_m, "interpolated")
        .when(distance <= max_m, "weak_extrapolation")
        .otherwise("constrained")
    )


def corrected_height(height: Column, terms: Sequence[Column], mask_class: Column | None) -> Column:
    """Height minus corrections; a missing correction counts as zero, and with a class only floating rows change."""
    total: Column = F.lit(0.0)
    for t in terms:
        total = total + F.coalesce(F.nanvl(t.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    if mask_class is None:
        return height - total
    return height - F.when(mask_class == FLOATING, total).otherwise(0.0)


@dataclass(frozen=True)
class CorrectionPolicy:
    """Which corrections apply. The long-period tide enters only by an explicit, checked choice."""

    terms: Sequence[str] = ("tide_ocean", "dac")
    gate_to_floating: bool = True
    apply_equilibrium: bool = False
    tide_model_has_equilibrium: bool | None = None

    def checked_terms(self) -> list[str]:
        if not self.apply_equilibrium and "tide_equilibrium" in self.terms:
            raise ValueError("tide_equilibrium is listed, but apply_equilibrium is off")
        if self.apply_equilibrium and self.tide_model_has_equilibrium is not False:
            raise ValueError("state tide_model_has_equilibrium=False before applying the equilibrium tide")
        extra = ["tide_equilibrium"] if self.apply_equilibrium and "tide_equilibrium" not in self.terms else []
        return [*self.terms, *extra]


def apply_corrections(df: DataFrame, policy: CorrectionPolicy = CorrectionPolicy(), height: str = "h_elv", out: str = "h_corr") -> DataFrame:
    terms = policy.checked_terms()
    missing = [c for c in terms if c not in df.columns]
    if missing:
        raise ValueError(f"correction columns missing: {', '.join(missing)}")
    if policy.gate_to_floating and "mask_class" not in df.columns:
        raise ValueError("gating to floating ice needs the column mask_class")
    gate = F.col("mask_class") if policy.gate_to_floating else None
    return df.withColumn(out, corrected_height(F.col(height).cast("double"), [F.col(c) for c in terms], gate))


def replace_tide(df: DataFrame, predicted: str = "tide_predicted", tide: str = "tide_ocean") -> DataFrame:
    """Keep the original tide beside the prediction that replaces it where there is one."""
    return df.withColumn(f"{tide}_got", F.col(tide)).withColumn(
        tide, F.coalesce(F.nanvl(F.col(predicted), F.lit(None).cast("double")), F.col(tide))
    )


def dem_residual(height: Column, dem: Column, limit_m: float = 200.0) -> Column:
    r = height - dem
    return F.when(F.abs(r) <= limit_m, r)
