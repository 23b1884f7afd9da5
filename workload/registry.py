from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under the name of its function."""

    def register(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


def doubles(df: DataFrame) -> DataFrame:
    """DECIMAL results as doubles: sums are exact up to here, and the type is the same everywhere."""
    exact = [f.name for f in df.schema if isinstance(f.dataType, DecimalType)]
    return df.withColumns({n: F.col(n).cast("double") for n in exact})


def num(value: float) -> str:
    """A double literal in SQL; without an exponent it would be read as a decimal."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"
