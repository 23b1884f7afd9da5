"""Data checks. Each returns one row: ``check``, ``ok``, ``n_bad``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.operators.scenario import windows_without_end


def _verdict(df: DataFrame, name: str, bad: Column) -> DataFrame:
    counted = df.agg(F.coalesce(bad, F.lit(0)).cast("bigint").alias("n_bad"))
    return counted.select(
        F.lit(name).alias("check"), (F.col("n_bad") == 0).alias("ok"), F.col("n_bad")
    )


def check_all(df: DataFrame, condition: Column, name: str = "all") -> DataFrame:
    """Every row meets the condition; a row where it is unknown counts as bad."""
    return _verdict(df, name, F.count_if(~F.coalesce(condition, F.lit(False))))


def check_non_negative(
    df: DataFrame, columns: Sequence[str], name: str = "non_negative"
) -> DataFrame:
    """No value below zero in any of the columns."""
    negative = F.lit(0)
    for column in columns:
        negative += F.count_if(F.col(column) < 0)
    return _verdict(df, name, negative)


def check_max_equals(
    df: DataFrame, column: str, expected: object, name: str = "max_equals"
) -> DataFrame:
    different = ~F.max(column).eqNullSafe(F.lit(expected))
    return _verdict(df, name, different.cast("int"))


def check_in_range(
    value: DataFrame, observed: DataFrame, column: str, name: str = "in_range"
) -> DataFrame:
    """A one-row value lies strictly between the least and the largest observed value."""
    first = observed.columns[0]
    bounds = observed.agg(F.struct(F.min(first).alias("low"), F.max(first).alias("high"))).scalar()
    return check_all(value, (F.col(column) > bounds["low"]) & (F.col(column) < bounds["high"]), name)


def check_window_end(
    df: DataFrame, duration: str = "window_duration", end: str = "end_date", name: str = "window_end"
) -> DataFrame:
    """Every window has a duration or an end."""
    return _verdict(windows_without_end(df, duration, end), name, F.count(F.lit(1)))


def check_unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """Exactly one row per key."""
    groups = df.groupBy(*keys).count()
    return _verdict(groups, name, F.count_if(F.col("count") != 1))


def check_tables_equal(
    left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "tables_equal", buckets: int = 4096
) -> DataFrame:
    """Both tables hold the same rows for the same keys; ``n_bad`` counts the keys with other rows.

    Rows are compared as a multiset, so keys may repeat, and NULL equals NULL. Nothing is joined: the
    rows of one table count plus, those of the other minus, and row counts and two 64-bit sums of row
    hashes are added up per bucket of keys. Equal tables shuffle a row per bucket and task, however
    many rows a key has. Only the buckets that differ are added up again, by key.
    """
    columns = [*keys, *[n for n in left.columns if n not in keys]]
    sides = [df.select(*columns, F.lit(sign).alias("_side")) for df, sign in ((left, 1), (right, -1))]
    both = sides[0].unionByName(sides[1])
    cells = [*columns, *[F.isnull(n) for n in columns]]  # a hash leaves NULLs out
    parts = {f"_hash_{k}": F.xxhash64(F.lit(k), *cells).cast("decimal(20,0)") * F.col("_side") for k in (1, 2)}
    marked = both.withColumns({"_bucket": F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(buckets)), **parts})

    def unequal(df: DataFrame, *by: str) -> DataFrame:
        sums = [F.sum(n).alias(n) for n in ("_side", *parts)]
        return df.groupBy(*by).agg(*sums).where(F.greatest(*[F.abs(F.col(n)) for n in ("_side", *parts)]) != 0)

    open_buckets = unequal(marked, "_bucket").select("_bucket")
    bad = unequal(marked.join(open_buckets, "_bucket", "left_semi"), *keys)
    return _verdict(bad, name, F.count(F.lit(1)))
