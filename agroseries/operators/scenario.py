"""Scenario grids, management windows and comparisons between scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.functions import aggregates as a
from agroseries.functions import columns as c
from agroseries.functions import constants as k
from agroseries.operators.joins import lookup_one

SCENARIO = ("rank_leaves_left", "window_duration")


def scenario_grid(
    df: DataFrame,
    start_date: Column | str,
    ranks: tuple[int, int, int] = k.SCENARIO_RANKS,
    durations: Sequence[int] = k.SCENARIO_DURATIONS_MONTHS,
) -> DataFrame:
    """Every rank (first, last, step) with every window, for each row of ``df``.

    Start dates and durations are paired position by position, then combined with the ranks. Both
    lists are arrays on the row, so the grid needs no join.
    """
    starts = F.array_repeat(c.as_column(start_date), len(durations))
    windows = F.arrays_zip(
        starts.alias("start_date"), F.array(*[F.lit(d) for d in durations]).alias("window_duration")
    )
    first, last, step = ranks
    return (
        df.withColumn("rank_leaves_left", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
        .withColumn("_window", F.explode(windows))
        .select("*", "_window.start_date", "_window.window_duration")
        .drop("_window")
        .withColumn("duration_label", c.duration_label("window_duration"))
        .transform(window_end)
    )


def window_end(
    df: DataFrame,
    start: str = "start_date",
    duration: str = "window_duration",
    end: str = "end_date",
) -> DataFrame:
    """End of a window: as given, else start plus duration in months (NULL when neither is known)."""
    computed = c.shift_months(start, F.col(duration))
    given = F.coalesce(F.col(end), computed) if end in df.columns else computed
    return df.withColumn(end, given)


def windows_without_end(
    df: DataFrame, duration: str = "window_duration", end: str = "end_date"
) -> DataFrame:
    """Rows that break the rule that a window has a duration or an end."""
    return df.where(F.col(duration).isNull() & F.col(end).isNull())


def window_bounds(
    windows: DataFrame,
    calendar: DataFrame,
    keys: Sequence[str] = (),
    date: str = "date",
    month: str = "months_after_planting",
    strict: bool = False,
) -> DataFrame:
    """Month numbers at the start and the end of each window.

    A date must occur exactly once in the calendar; otherwise the bound is NULL (or an error).
    """
    same = {name: name for name in keys}
    started = lookup_one(
        windows, calendar, {**same, "start_date": date}, month, "start_map", strict
    )
    return lookup_one(started, calendar, {**same, "end_date": date}, month, "end_map", strict)


def total_at_end(
    df: DataFrame,
    value: str,
    order: a.Order = "year",
    keys: Sequence[str] = SCENARIO,
    out: str = "t_ha",
    area: float = k.SCENE_AREA_M2,
) -> DataFrame:
    """Last cumulated harvest of each scenario, in t/ha."""
    last = a.last_by(value, order).cast("double")
    return df.groupBy(*keys).agg(c.carbon_to_fresh_t_ha(last, area=area).alias(out))


def total_since(
    df: DataFrame,
    value: str,
    since: int,
    strict: bool = False,
    year: str = "year",
    keys: Sequence[str] = SCENARIO,
    out: str = "t_ha",
    area: float = k.SCENE_AREA_M2,
) -> DataFrame:
    """Harvest of each scenario from a year on (``strict``: after that year), in t/ha."""
    period = F.col(year) > since if strict else F.col(year) >= since
    total = F.sum(value).cast("double")
    return df.where(period).groupBy(*keys).agg(c.carbon_to_fresh_t_ha(total, area=area).alias(out))


def loss_at_end(
    df: DataFrame,
    relative: str,
    order: a.Order = "months_after_planting",
    keys: Sequence[str] = SCENARIO,
    out: str = "loss",
) -> DataFrame:
    """One minus the last relative value of each scenario."""
    return df.groupBy(*keys).agg((1.0 - a.last_by(relative, order)).alias(out))


def open_leaf_area(
    df: DataFrame,
    after: str,
    scenario: Mapping[str, object],
    step: str = "timestep",
    date: str = "date",
    state: str = "state",
    leaf_area: str = "leaf_area",
    area: float = k.SCENE_AREA_M2,
) -> DataFrame:
    """Area of the open leaves per step in one scenario, from the day after a date on, by step.

    The sort is of one row per step, after the aggregation.
    """
    chosen = F.col(date) >= F.date_add(F.lit(after).cast("date"), 1)
    for name, value in scenario.items():
        chosen &= F.col(name) == value
    opened = df.where(chosen & (F.col(state) == k.OPENED))
    summed = opened.groupBy(step).agg(F.sum(leaf_area).alias("leaf_area"))
    index = c.area_index(F.col("leaf_area").cast("double"), area)
    return summed.withColumn("lai_opened", index).orderBy(step)


def count_decisions(
    df: DataFrame,
    decision: str = k.PRUNED_IN_WINDOW,
    keys: Sequence[str] = SCENARIO,
    column: str = "pruning_decision",
    out: str = "n_leaves",
) -> DataFrame:
    """Rows of each scenario with one decision; scenarios without any are left out."""
    return df.where(F.col(column) == decision).groupBy(*keys).agg(F.count("*").alias(out))
