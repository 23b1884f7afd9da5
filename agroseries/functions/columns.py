"""Row-wise expressions. All take and return a Column and stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agroseries.functions import constants as k


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Calendar -----------------------------------------------------------------------------------


def month_start(date: Column | str) -> Column:
    return F.trunc(as_column(date), "MM")


def shift_years(date: Column | str, years: int) -> Column:
    """Same day ``years`` later (or earlier); 29 February becomes 28 February in a common year."""
    return F.add_months(as_column(date), 12 * years)


def shift_months(date: Column | str, months: Column | int) -> Column:
    return F.add_months(as_column(date), months)


def year_start(year: Column | str) -> Column:
    return F.make_date(as_column(year), F.lit(1), F.lit(1))


def year_gap(later: Column | str, earlier: Column | str) -> Column:
    return F.year(as_column(later)) - F.year(as_column(earlier))


def duration_days(text: Column | str) -> Column:
    """Days of a duration text such as ``"1 day"``; only its first character counts."""
    return F.substring(as_column(text), 1, 1).cast("int")


def duration_label(months: Column | str) -> Column:
    months = as_column(months)
    unit = F.when(months == 1, " month").otherwise(" months")
    return F.concat(months.cast("string"), unit)


# Arithmetic ---------------------------------------------------------------------------------


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient; NULL where the denominator is zero."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def clamp_zero(c: Column | str) -> Column:
    """0 for negative values and for NaN."""
    c = as_column(c)
    return F.when((c < 0) | F.isnan(c), F.lit(0)).otherwise(c)


def fill_nan(c: Column | str, value: float = 0.0) -> Column:
    return F.nanvl(as_column(c), F.lit(value))


def fill_missing(c: Column | str, value: float = 0.0) -> Column:
    return F.coalesce(as_column(c), F.lit(value))


def percent_to_fraction(c: Column | str) -> Column:
    return as_column(c) / 100


def age_ramp(
    age: Column | str,
    age_start: float,
    age_end: float,
    value_start: Column | float,
    value_end: Column | float,
) -> Column:
    """Linear from ``value_start`` at ``age_start`` to ``value_end`` at ``age_end``, flat outside."""
    age = as_column(age)
    low, high = F.lit(value_start).cast("double"), F.lit(value_end).cast("double")
    inside = low + (age - age_start) * (high - low) / (age_end - age_start)
    return F.when(age <= age_start, low).when(age >= age_end, high).otherwise(inside)


def water_stress(ftsw: Column | str, threshold: Column | float = k.FTSW_STRESS_THRESHOLD) -> Column:
    """1 above the threshold, proportional to the soil water fraction below it; NaN stays NaN."""
    ftsw = as_column(ftsw)
    above = (ftsw > threshold) & ~F.isnan(ftsw)
    return F.when(above, F.lit(1.0)).otherwise(ftsw / threshold)


# Light --------------------------------------------------------------------------------------


def par_to_global(par: Column | str, par_fraction: float = k.PAR_FRACTION) -> Column:
    return as_column(par) / par_fraction


def irradiance_to_daily_mj(watts: Column | str) -> Column:
    """W m-2 held for a day, in MJ m-2 d-1."""
    return as_column(watts) * 60 * 60 * 24 * 1e-6


def irradiance_to_daily_par(watts: Column | str, par_fraction: float = k.PAR_FRACTION) -> Column:
    return irradiance_to_daily_mj(watts) * par_fraction


# Yield units (input in grams of carbon per plant) -------------------------------------------


def grams_to_kg(c: Column | str) -> Column:
    return as_column(c) * 1e-3


def carbon_to_dry_kg(c: Column | str, carbon: float = k.CARBON_FRUIT) -> Column:
    return as_column(c) * 1e-3 / carbon


def carbon_to_fresh_kg(
    c: Column | str, carbon: float = k.CARBON_FRUIT, fresh: float = k.DRY_TO_FRESH
) -> Column:
    return carbon_to_dry_kg(c, carbon) * fresh


def carbon_to_fresh_t_ha(
    c: Column | str,
    carbon: float = k.CARBON_FRUIT,
    fresh: float = k.DRY_TO_FRESH,
    area: Column | float = k.SCENE_AREA_M2,
) -> Column:
    return as_column(c) * 1e-6 / carbon * fresh / area * k.M2_PER_HA


def carbon_to_dry_t_ha(
    c: Column | str, carbon: float = k.CARBON_LEAF, area: Column | float = k.SCENE_AREA_M2
) -> Column:
    return as_column(c) * 1e-6 / carbon / area * k.M2_PER_HA


def area_index(leaf_area: Column | str, area: Column | float = k.SCENE_AREA_M2) -> Column:
    return as_column(leaf_area) / area
