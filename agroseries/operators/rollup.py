"""Group aggregates: months, years, scenarios, states, organs to plants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.functions import aggregates as a
from agroseries.functions import columns as c
from agroseries.functions import constants as k

Pairs = Mapping[str, str | Column] | None


def rollup(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: a.Order = "timestep",
    *,
    month: str | None = None,
    span: str | None = None,
    sums: Pairs = None,
    means: Pairs = None,
    lasts: Pairs = None,
    firsts: Pairs = None,
    gains: Pairs = None,
    maxima: Pairs = None,
    minima: Pairs = None,
    counts: Pairs = None,
    others: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One aggregation with any mix of aggregates; each mapping is output name to input.

    ``month`` names a date column whose first value is floored to its month (output ``date``),
    ``span`` a step column whose covered steps are counted (output ``nb_timesteps``). ``counts``
    maps to conditions, ``others`` to ready aggregate expressions. Everything is computed in a single
    shuffle with map-side combine.
    """
    parts: list[Column] = []
    if month:
        parts.append(c.month_start(a.first_by(month, order)).alias("date"))
    if span:
        parts.append(a.step_span(span).alias("nb_timesteps"))
    kinds = [
        (sums, lambda x: F.sum(c.as_column(x))),
        (means, a.mean),
        (lasts, lambda x: a.last_by(x, order)),
        (firsts, lambda x: a.first_by(x, order)),
        (gains, lambda x: a.increase(x, order)),
        (maxima, lambda x: F.max(c.as_column(x))),
        (minima, lambda x: F.min(c.as_column(x))),
        (counts, lambda x: F.count_if(c.as_column(x))),
    ]
    for pairs, make in kinds:
        parts += [make(source).alias(out) for out, source in (pairs or {}).items()]
    parts += [expression.alias(out) for out, expression in (others or {}).items()]
    return df.groupBy(*keys).agg(*parts)


def year_rollup(
    df: DataFrame, keys: Sequence[str], date: str = "date", order: a.Order = "timestep", **aggregates
) -> DataFrame:
    """Roll-up by calendar year and ``keys``."""
    return rollup(df, [*keys, F.year(date).alias("year")], order, **aggregates)


def state_counts(
    df: DataFrame,
    keys: Sequence[str],
    states: Mapping[str, Sequence[str]],
    state: str = "state",
    decisions: Mapping[str, str] | None = None,
    decision: str = "pruning_decision",
    opened_sums: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    opened: str = k.OPENED,
    lasts: Pairs = None,
    order: a.Order = "timestep",
) -> DataFrame:
    """Rows of each group in given states; one output per entry of ``states`` and ``decisions``.

    ``opened_sums`` adds up a column over the rows in the opened state only, ``lasts`` takes the value
    at the last step of the group by ``order``.
    """
    parts = [F.count_if(F.col(state).isin(*labels)).alias(out) for out, labels in states.items()]
    parts += [F.count_if(F.col(decision) == d).alias(out) for out, d in (decisions or {}).items()]
    parts.append(F.count("*").alias("n_rows"))
    in_state = F.col(state) == opened
    parts += [a.sum_where(x, in_state).alias(out) for out, x in (opened_sums or {}).items()]
    parts += [F.sum(x).alias(out) for out, x in (sums or {}).items()]
    parts += [a.last_by(x, order).alias(out) for out, x in (lasts or {}).items()]
    return df.groupBy(*keys).agg(*parts)


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def mean_positive(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean over the rows above zero (NaN is not); NULL for a group without any."""
    above = (F.col(value) > 0) & ~F.isnan(value)
    return df.groupBy(*keys).agg(a.mean_where(value, above).alias(out))


def mean_of_state(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    label: str,
    out: str,
    state: str = "state",
    fill: float | None = 0.0,
) -> DataFrame:
    """Mean over the rows in one state; ``fill`` where a group has none."""
    average = a.mean_where(value, F.col(state) == label)
    filled = average if fill is None else F.coalesce(average, F.lit(fill))
    return df.groupBy(*keys).agg(filled.alias(out))


def mean_with_distinct(
    df: DataFrame, keys: Sequence[str], value: str, distinct: str, out: str
) -> DataFrame:
    """Group mean repeated for each distinct value of another column in the group.

    The rows are aggregated once to (keys, distinct); the group mean comes from those few partial
    sums and is joined back to them, so no set of values is ever gathered in one row.
    """
    parts = df.groupBy(*keys, distinct).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_count")
    )
    groups = parts.groupBy(*[F.col(x).alias(f"_{x}") for x in keys]).agg(
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_count")).alias(out)
    )
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in keys]
    return parts.join(groups, same).select(*keys, distinct, out)


def last_sum(
    df: DataFrame, keys: Sequence[str], order: a.Order, first: str, second: str, out: str
) -> DataFrame:
    """Sum of the last values of two columns."""
    total = a.last_by(first, order) + a.last_by(second, order)
    return df.groupBy(*keys).agg(total.alias(out))


def rate_summary(
    months: DataFrame,
    keys: Sequence[str] = ("Site",),
    month: str = "months_after_planting",
    count: str = "phytomer_count",
    thermal_time: str = "TEff",
    steps: str = "nb_timesteps",
) -> DataFrame:
    """Totals of a month table with emission rates per degree day, per step, and steps per organ."""
    totals = rollup(
        months,
        keys,
        month,
        lasts={month: month},
        maxima={count: count},
        sums={thermal_time: thermal_time, steps: steps},
    )
    heat = F.col(thermal_time).cast("double")
    return totals.withColumns(
        {
            "phytomer_per_TT": c.ratio(F.col(count).cast("double"), heat),
            "phytomer_per_day": c.ratio(F.col(count).cast("double"), steps),
            "days_per_phytomer": c.ratio(F.col(steps).cast("double"), count),
        }
    )


def organs_to_plant(
    df: DataFrame,
    keys: Sequence[str] = ("Site", "timestep"),
    date: str = "date",
    sums: Mapping[str, str] | None = None,
    maxima: Mapping[str, str] | None = None,
) -> DataFrame:
    """Organ rows added up per plant and step."""
    return rollup(df, [*keys, date], sums=sums, maxima=maxima)


def organ_mass_year(
    plant: DataFrame,
    keys: Sequence[str] = ("Site",),
    date: str = "date",
    step: str = "timestep",
    biomass: str = "biomass",
    carbon: float = k.CARBON_LEAF,
    area: float = k.SCENE_AREA_M2,
    minima: Mapping[str, str] | None = None,
    radius: str | None = None,
) -> DataFrame:
    """Standing dry mass per year (t/ha), taken at the yearly minimum; stem diameter from radius."""
    year = year_rollup(
        plant,
        keys,
        date,
        step,
        span=step,
        minima={
            "biomass_ton_ms": biomass,
            **(minima or {}),
            **({"diameter": radius} if radius else {}),
        },
    )
    mass = c.carbon_to_dry_t_ha(F.col("biomass_ton_ms").cast("double"), carbon, area)
    year = year.withColumn("biomass_ton_ms", mass)
    return year.withColumn("diameter", F.col("diameter") * 2) if radius else year


def mean_of_means(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the group means: each group counts the same, whatever its number of rows."""
    return df.groupBy(*keys).agg(a.mean(value).alias("_mean")).agg(F.avg("_mean").alias(out))


def point_mean_diff(
    df: DataFrame, position: str, later: int, earlier: int, value: str, out: str
) -> DataFrame:
    """Mean at one position of the series minus mean at another, over the whole table."""
    chosen = df.where(F.col(position).isin(later, earlier))
    difference = a.mean_where(value, F.col(position) == later) - a.mean_where(
        value, F.col(position) == earlier
    )
    return chosen.agg(difference.alias(out))


def table_summary(df: DataFrame, value: str, date: str) -> DataFrame:
    """Row count, sum, mean and extremes of one column, and the date range, in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(value).alias("sum_value"),
        a.mean(value).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def distinct_values(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()


def distinct_count(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact number of distinct values per group, aggregated by value before by group."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias(out))
