"""Aggregate expressions for ``groupBy(...).agg(...)``.

All of them combine on the map side, so a group that holds a third of the table still reaches the
shuffle as one small row per task. First and last need an order key; give a single numeric column
where there is one (its buffer fits hash aggregation, a struct of several columns does not).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from agroseries.functions.columns import as_column

Order = Column | str | Sequence[str]


def order_key(order: Order) -> Column:
    """One comparable column for a one- or many-column order."""
    if isinstance(order, (Column, str)):
        return as_column(order)
    return as_column(order[0]) if len(order) == 1 else F.struct(*order)


def mean(c: Column | str) -> Column:
    """Mean as exact sum over count: on DECIMAL input the result does not depend on task order."""
    c = as_column(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def mean_where(c: Column | str, condition: Column) -> Column:
    """Mean over the rows that meet the condition; NULL when there is none."""
    return mean(F.when(condition, as_column(c)))


def sum_where(c: Column | str, condition: Column) -> Column:
    return F.sum(F.when(condition, as_column(c)).otherwise(0))


def first_by(c: Column | str, order: Order) -> Column:
    return F.min_by(as_column(c), order_key(order))


def last_by(c: Column | str, order: Order) -> Column:
    return F.max_by(as_column(c), order_key(order))


def increase(c: Column | str, order: Order) -> Column:
    """Last value minus first value, by the order key."""
    return last_by(c, order) - first_by(c, order)


def step_span(step: Column | str) -> Column:
    """Steps covered by a group, both ends counted."""
    step = as_column(step)
    return F.max(step) - F.min(step) + 1
