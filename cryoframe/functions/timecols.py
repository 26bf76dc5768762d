"""Decimal years, months and seasons as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_YEAR = 2018.0
SECONDS_PER_YEAR = 31557600.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def year_from_delta(delta_s: Column | str, epoch: float = EPOCH_YEAR, per_year: float = SECONDS_PER_YEAR) -> Column:
    return F.lit(epoch) + _c(delta_s) / F.lit(per_year)


def delta_from_year(t_year: Column | str, epoch: float = EPOCH_YEAR, per_year: float = SECONDS_PER_YEAR) -> Column:
    return (_c(t_year) - F.lit(epoch)) * F.lit(per_year)


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def month_of(t_year: Column | str) -> Column:
    """Calendar month of a decimal year, honouring leap years."""
    t = _c(t_year)
    year = F.floor(t).cast("int")
    length = days_in_year(year)
    doy = F.least(F.floor((t - F.floor(t)) * length).cast("int"), length - 1)
    return F.month(F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy))


def decimal_year(moment: Column | str) -> Column:
    m = _c(moment)
    return F.year(m) + (F.dayofyear(m) - 1) / F.lit(365.25)


def first_late_month(months: Sequence[int]) -> int | None:
    """First month after the widest gap of a season that crosses December, else None."""
    ordered = sorted(set(months))
    if 1 not in ordered or 12 not in ordered:
        return None
    gaps = [b - a for a, b in zip(ordered, ordered[1:])]
    return ordered[gaps.index(max(gaps)) + 1]


def season_year(t_year: Column | str, months: Sequence[int]) -> Column:
    """The year a season is named after: late months belong to the next one."""
    t = _c(t_year)
    year = F.floor(t).cast("int")
    late = first_late_month(months)
    if late is None:
        return year
    month = F.floor((t - F.floor(t)) * 12).cast("int") + 1
    return year + F.when(month >= late, 1).otherwise(0)


def phase_stretch(t_year: Column | str, low: Column | float, high: Column | float) -> Column:
    """Map the observed part [low, high] of each year onto the whole year."""
    t = _c(t_year)
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.floor(t) + F.try_divide(t - F.floor(t) - lo, hi - lo)
