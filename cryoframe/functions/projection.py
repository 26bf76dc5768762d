"""South polar stereographic projection (WGS84, true scale at 71 S) in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the latitude of true scale.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
TRUE_LATITUDE = 71.0

ECC = math.sqrt(FLATTENING * (2.0 - FLATTENING))


def _half_angle(lat: float) -> float:
    s = ECC * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (ECC / 2)


_PHI = math.radians(TRUE_LATITUDE)
_SCALE = SEMI_MAJOR * math.cos(_PHI) / math.sqrt(1 - (ECC * math.sin(_PHI)) ** 2) / _half_angle(_PHI)


def to_polar(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres from degrees."""
    phi = -F.radians(lat)
    s = F.lit(ECC) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(ECC / 2))
    rho = F.lit(_SCALE) * t
    lam = F.radians(lon)
    return rho * F.sin(lam), rho * F.cos(lam)


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees; the conformal latitude is expanded to the sixth harmonic pair."""
    e2 = ECC**2
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.hypot(x, y) / F.lit(_SCALE))
    a = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360
    b = 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520
    c = 7 * e2**3 / 120 + 81 * e2**4 / 1120
    d = 4279 * e2**4 / 161280
    phi = chi + a * F.sin(2 * chi) + b * F.sin(4 * chi) + c * F.sin(6 * chi) + d * F.sin(8 * chi)
    return F.degrees(F.atan2(x, y)), -F.degrees(phi)
