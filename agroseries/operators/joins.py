"""Joins of outputs with weather, observations, parameters and other scenarios.

All are equi-joins on the natural keys. None carries a broadcast hint: the planner broadcasts a side
only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise the
adaptive skew join splits a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroseries.functions import columns as c


def join_weather(
    df: DataFrame, weather: DataFrame, on: Sequence[str] = ("Site", "timestep")
) -> DataFrame:
    """Attach weather to every row; rows without weather stay, with NULLs."""
    return df.join(weather, list(on), "left")


def join_renamed(
    left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "left"
) -> DataFrame:
    """Join on keys that are named differently; the left names are kept."""
    renamed = right.withColumnsRenamed({theirs: ours for ours, theirs in on.items()})
    return left.join(renamed, list(on), how)


def join_complete(
    left: DataFrame, right: DataFrame, on: Mapping[str, str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Left join followed by dropping incomplete rows, done as the inner join it amounts to."""
    joined = join_renamed(left, right, on, "inner")
    return joined.na.drop("any", subset=list(columns) if columns else None)


def common_period(
    df: DataFrame, by: Sequence[str] = ("Site",), date: str = "date", raw: str | None = None
) -> DataFrame:
    """Rows within the period that all series cover.

    The bounds are scalar subqueries: two partial aggregations down to one row, evaluated once and
    used as plain values in the scan filter. Where ``date`` is made from a timestamp column, name that one
    as ``raw``: the bounds then also hold for it directly, so that the scan can skip row groups.
    """
    series = df.groupBy(*by).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    bounds = series.agg(F.max("_from").alias("start_date"), F.min("_to").alias("end_date"))
    start, end = (bounds.select(n).scalar() for n in ("start_date", "end_date"))
    within = F.col(date).between(start, end)
    if raw:
        kind = df.schema[raw].dataType
        until = bounds.select(F.date_add(F.col("end_date").cast("date"), 1).cast(kind)).scalar()
        within &= (F.col(raw) >= bounds.select(F.col("start_date").cast(kind)).scalar()) & (F.col(raw) < until)
    return df.where(within)


def two_points(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    first: int,
    second: int,
    suffixes: tuple[str, str],
) -> DataFrame:
    """Complete rows of one position of the series beside those of another, by key.

    One aggregation over the rows at either position; a key has one row per position.
    """
    values = [n for n in df.columns if n not in keys]
    near = df.where(F.col(position).isin(first, second))
    picked = [
        F.max(F.when(F.col(position) == point, F.col(n))).alias(f"{n}{suffix}")
        for point, suffix in zip((first, second), suffixes, strict=True)
        for n in values
    ]
    return near.groupBy(*keys).agg(*picked).na.drop("any")


def lookup_one(
    df: DataFrame,
    table: DataFrame,
    on: Mapping[str, str],
    value: str,
    out: str,
    strict: bool = False,
) -> DataFrame:
    """Value of the one row of ``table`` with the key.

    NULL where there is no such row or more than one; ``strict`` raises an error instead.
    """
    unique = table.groupBy(*[F.col(theirs).alias(ours) for ours, theirs in on.items()]).agg(
        F.count("*").alias("_matches"), F.min(value).alias("_found")
    )
    found = F.when(F.col("_matches") == 1, F.col("_found"))
    if strict:
        found = found.otherwise(F.raise_error(F.lit("lookup key without exactly one row")))
    return df.join(unique, list(on), "left").withColumn(out, found).drop("_matches", "_found")


def attach_parameters(
    df: DataFrame,
    parameters: DataFrame,
    key: str,
    paths: Mapping[str, str],
    kind: str = "double",
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Parameters of a long (key, path, value) table as columns, by key.

    ``paths`` maps output columns to paths. Each key has its own values: an override for one site
    never shows at another. A path without a value takes ``defaults[path]``.
    """
    wide = (
        parameters.where(F.col("path").isin(*paths.values()))
        .groupBy(key)
        .agg(
            *[
                F.max(F.when(F.col("path") == path, F.col("value").cast(kind))).alias(out)
                for out, path in paths.items()
            ]
        )
    )
    known = {
        out: F.coalesce(F.col(out), F.lit(defaults[path]).cast(kind))
        for out, path in paths.items()
        if path in (defaults or {})
    }
    return df.join(wide, key, "left").withColumns(known)


def relative_to_baseline(
    df: DataFrame,
    on: Sequence[str],
    baseline: Column | str,
    value: str,
    out: str,
) -> DataFrame:
    """Value over the value of the baseline scenario at the same ``on`` (month, site).

    The table holds one row per scenario and ``on``, so a window partition is only as long as the
    list of scenarios, and the table is read once, which a join with itself would do twice. NULL
    where the baseline has no row.
    """
    chosen = F.expr(baseline) if isinstance(baseline, str) else baseline
    base = F.max(F.when(chosen, F.col(value).cast("double"))).over(Window.partitionBy(*on))
    return df.withColumn(out, c.ratio(F.col(value).cast("double"), base))
