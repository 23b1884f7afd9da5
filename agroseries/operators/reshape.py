"""Selecting, tagging, stacking and uniting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.functions import columns as c


def select_renamed(df: DataFrame, names: Mapping[str, str | Column]) -> DataFrame:
    """Keep ``names`` (output to input) in the given order."""
    return df.select(*[c.as_column(source).alias(out) for out, source in names.items()])


def tag(df: DataFrame, **constants: object) -> DataFrame:
    """Add constant columns: a site, a scenario, a duration."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def other_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [name for name in df.columns if name not in keys]


def to_long(
    df: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str] | None = None,
    variable: str = "variable",
    value: str = "value",
) -> DataFrame:
    """One row per key and measured variable; all columns but the keys unless listed."""
    return df.unpivot(list(keys), list(variables or other_columns(df, keys)), variable, value)


def scale_frame(df: DataFrame, divisor: float, keys: Sequence[str] = ()) -> DataFrame:
    """Divide every column; ``keys`` stay as they are (none by default)."""
    return df.select(*[F.col(n) if n in keys else (F.col(n) / divisor).alias(n) for n in df.columns])


def unite(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; the frames must have the same columns, in any order."""
    return reduce(DataFrame.unionByName, frames)


def unite_tagged(frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Rows of all frames, each tagged with its key."""
    return unite([tag(df, **{name: key}) for key, df in frames.items()])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def sort_output(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Total order for a sink. Operators never need it: they carry their own order keys."""
    return df.orderBy(*keys)


def sort_ignoring_case(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(F.lower(name), name)


def slice_scale(
    df: DataFrame,
    scale: str,
    variables: Sequence[str],
    organ: str = "organ",
    keys: Sequence[str] = ("date", "node"),
) -> DataFrame:
    """Chosen variables of one scale of a long output table."""
    return df.where(F.col(organ) == scale).select(*keys, *variables)


def slice_scales(
    df: DataFrame, chosen: Mapping[str, Sequence[str]], organ: str = "organ", **options
) -> dict[str, DataFrame]:
    """One slice per scale; scales without a chosen variable are left out."""
    return {s: slice_scale(df, s, v, organ, **options) for s, v in chosen.items() if v}


def select_members(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a chosen set, of any size."""
    return df.join(chosen.select(key), key, "left_semi")


def extend_years(
    df: DataFrame,
    copies: Sequence[tuple[str, str, int]],
    start: str | None = None,
    date: str = "date",
) -> DataFrame:
    """Fill a series by repeating parts of it in other years.

    Each copy is (first day, last day, shift in years), both days included, and sees the rows that
    earlier copies have made. Rows before ``start`` are dropped at the end; rows without a date are
    kept once. A row works out the dates it stands for, copy by copy, so the table is read once and
    nothing is shuffled.
    """
    day = F.col(date)
    for first_day, last_day, years in copies:
        copied = day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
        both = F.when(copied, F.array(day, c.shift_years(day, years))).otherwise(F.array(day))
        df = df.withColumn(date, F.explode(both))
    if start is None:
        return df
    return df.where(day.isNull() | (day >= F.lit(start).cast("date")))
