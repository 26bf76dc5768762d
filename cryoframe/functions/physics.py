"""Physical relations as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ICE_DENSITY = 917.0
WATER_DENSITY = 1027.0
KG_PER_GT = 1.0e12
OCEAN_AREA_M2 = 3.618e14


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _poly(t: Column, coefficients: Sequence[float]) -> Column:
    """Horner form, lowest power first."""
    acc: Column = F.lit(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        acc = acc * t + F.lit(k)
    return acc


def freezing_point(salinity: Column | str, pressure_dbar: Column | float) -> Column:
    s = _c(salinity)
    return -0.0575 * s + 1.710523e-3 * F.pow(F.greatest(s, F.lit(0.0)), F.lit(1.5)) - 2.154996e-4 * _c(pressure_dbar)


# The practical salinity scale of 1978, lowest power first.
PSS_C35 = 42.9140
PSS_RT = (0.6766097, 2.00564e-2, 1.104259e-4, -6.9698e-7, 1.0031e-9)
PSS_A = (0.0080, -0.1692, 25.3851, 14.0941, -7.0261, 2.7081)
PSS_B = (0.0005, -0.0056, -0.0066, -0.0375, 0.0636, -0.0144)
PSS_K = 0.0162
PSS_E = (2.070e-5, -6.370e-10, 3.989e-15)
PSS_D = (3.426e-2, 4.464e-4, 4.215e-1, -3.107e-3)


def practical_salinity(conductivity: Column | str, temperature: Column | str, pressure_dbar: Column | float) -> Column:
    """Salinity from conductivity in mS/cm, temperature in Celsius and pressure in dbar."""
    t, p = _c(temperature), _c(pressure_dbar)
    r = _c(conductivity) / PSS_C35
    d1, d2, d3, d4 = PSS_D
    rp = 1 + p * _poly(p, PSS_E) / (1 + d1 * t + d2 * t * t + (d3 + d4 * t) * r)
    root = F.sqrt(F.greatest(r / (rp * _poly(t, PSS_RT)), F.lit(0.0)))
    warm = (t - 15.0) / (1.0 + PSS_K * (t - 15.0))
    return _poly(root, PSS_A) + warm * _poly(root, PSS_B)


def bearing(u: Column | str, v: Column | str) -> Column:
    return F.pmod(F.degrees(F.atan2(_c(u), _c(v))) + 360.0, F.lit(360.0))


def hydrostatic_factor(water: float = WATER_DENSITY, ice: float = ICE_DENSITY) -> float:
    return water / (water - ice)


def thickness_rate(dhdt: Column | str, floating: Column, water: float = WATER_DENSITY, ice: float = ICE_DENSITY) -> Column:
    """Surface rate to thickness rate. The floating mask is mandatory: grounded ice has no such factor."""
    return F.when(floating, _c(dhdt) * F.lit(hydrostatic_factor(water, ice)))


def basal_melt(thickness_rate_: Column, divergence: Column, smb: Column | None, floating: Column) -> Column:
    return F.when(floating, (F.coalesce(smb, F.lit(0.0)) if smb is not None else F.lit(0.0)) - thickness_rate_ - divergence)


def height_above_flotation(bed: Column | str, thickness: Column | str, ice: float = ICE_DENSITY, water: float = WATER_DENSITY) -> Column:
    return _c(thickness) - F.lit(water / ice) * F.greatest(-_c(bed), F.lit(0.0))


def years_to_flotation(haf: Column | str, dhdt: Column | str, min_loss: float = 0.02) -> Column:
    loss = -_c(dhdt)
    return F.when(_c(haf) <= 0, F.lit(0.0)).when(loss > min_loss, _c(haf) / loss)


def geolocation_sigma(slope: Column | str, vertical: float, horizontal: float) -> Column:
    s = _c(slope)
    return F.sqrt(F.lit(vertical**2) + F.lit(horizontal**2) * s * s)


def rate_sigma_from_leverage(sigma: Column, leverage: Column) -> Column:
    return F.when(leverage > 0, sigma / F.sqrt(leverage))


def harmonic(t: Column | str, period: float, kind: str = "cos") -> Column:
    arg = F.lit(2 * math.pi / period) * _c(t)
    return F.cos(arg) if kind == "cos" else F.sin(arg)


def annual_amplitude_phase(sin_coef: Column | str, cos_coef: Column | str) -> tuple[Column, Column]:
    """Amplitude and the phase as day of year."""
    a, b = _c(sin_coef), _c(cos_coef)
    return F.hypot(a, b), F.pmod(F.atan2(b, a) / F.lit(2 * math.pi), F.lit(1.0)) * 365.25


def variogram_model(name: str, h: Column, nugget: Column | float, sill: Column | float, reach: Column | float) -> Column:
    c0, c1, a = _c(nugget), _c(sill), _c(reach)
    if name == "spherical":
        r = h / a
        body = F.when(h >= a, c1).otherwise(c0 + (c1 - c0) * (1.5 * r - 0.5 * r * r * r))
    elif name == "exponential":
        body = c0 + (c1 - c0) * (1 - F.exp(-h / a))
    else:
        raise ValueError(f"unknown variogram model {name!r}")
    return F.when(h == 0, F.lit(0.0)).otherwise(body)


def orthometric(h: Column | str, geoid: Column | str) -> Column:
    return _c(h) - _c(geoid)


def remove_rate(rate: Column | str, other: Column | str) -> Column:
    """rate minus a correction rate whose absence counts as zero."""
    return _c(rate) - F.coalesce(_c(other), F.lit(0.0))


def add_advection(rate: Column | str, vx: Column | str, gx: Column | str, vy: Column | str, gy: Column | str) -> Column:
    return _c(rate) + _c(vx) * _c(gx) + _c(vy) * _c(gy)


def combined_sigma(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_c(a) * _c(a) + _c(b) * _c(b))
