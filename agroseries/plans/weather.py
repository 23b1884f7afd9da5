"""Weather preparation: normalise, clean, align sites, index steps and months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.functions import columns as c
from agroseries.functions import constants as k
from agroseries.operators.joins import common_period
from agroseries.operators.ordered import Blocks
from agroseries.operators.reshape import drop_missing, extend_years, select_renamed
from agroseries.operators.series import month_index, row_index


def day_blocks(date: str = "date") -> dict[str, Column]:
    """Blocks of a series with many rows a day; there are no more of them than days."""
    return {"_day": F.col(date)}


def hour_blocks(time: str) -> dict[str, Column]:
    return {"_hour": F.date_trunc("hour", F.col(time))}


def normalize_weather(
    df: DataFrame,
    plain: Mapping[str, str],
    percent: Mapping[str, str],
    par: str,
    par_fraction: float = k.PAR_FRACTION,
    duration_days: int = 1,
) -> DataFrame:
    """Columns under their common names and units.

    ``plain`` and ``percent`` map new names to columns; percentages become fractions. ``par`` is
    kept as ``Ri_PAR_f`` and gives the global radiation ``Rg``.
    """
    return select_renamed(
        df,
        {
            **plain,
            "duration": F.lit(duration_days),
            **{name: c.percent_to_fraction(source) for name, source in percent.items()},
            "Ri_PAR_f": par,
            "Rg": c.par_to_global(par, par_fraction),
        },
    )


def index_weather(
    df: DataFrame,
    by: Sequence[str] = ("Site",),
    order: Sequence[str] = ("date",),
    date: str = "date",
    blocks: Blocks = None,
    offset: int = k.MONTH_OFFSET,
) -> DataFrame:
    """Step number within each site and month number over all of them."""
    monthly = month_index(df, date, offset)
    return row_index(monthly, by, order, blocks)


def prepare_weather(
    df: DataFrame,
    by: Sequence[str] = ("Site",),
    order: Sequence[str] = ("date",),
    date: str = "date",
    blocks: Blocks = None,
    offset: int = k.MONTH_OFFSET,
) -> DataFrame:
    """Complete rows of the period common to all sites, with step and month numbers."""
    complete = drop_missing(df)
    aligned = common_period(complete, by, date)
    return index_weather(aligned, by, order, date, blocks, offset)


def generate_weather(
    df: DataFrame,
    copies: Sequence[tuple[str, str, int]],
    start: str,
    by: Sequence[str] = (),
    order: Sequence[str] = ("date",),
    date: str = "date",
    blocks: Blocks = None,
    offset: int = k.MONTH_OFFSET,
) -> DataFrame:
    """A longer series made by repeating years of a shorter one, with step and month numbers."""
    return index_weather(extend_years(df, copies, start, date), by, order, date, blocks, offset)
