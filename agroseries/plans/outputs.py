"""Looking at outputs: one tidy table per scale, of chosen variables and nodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroseries.operators.joins import join_weather
from agroseries.operators.reshape import select_members, slice_scales, to_long


def scale_tables(
    outputs: DataFrame,
    weather: DataFrame,
    chosen: Mapping[str, Sequence[str]],
    on: Sequence[str] = ("timestep",),
    organ: str = "organ",
    keys: Sequence[str] = ("date", "node"),
) -> dict[str, DataFrame]:
    """Dated long tables (key, variable, value), one per scale with chosen variables."""
    dated = join_weather(outputs, weather, on)
    slices = slice_scales(dated, chosen, organ, keys=keys)
    return {scale: to_long(table, keys) for scale, table in slices.items()}


def nodes_of(
    table: DataFrame, variable: str, nodes: DataFrame, keys: Sequence[str] = ("date", "node")
) -> DataFrame:
    """One variable of the chosen nodes of a scale table."""
    one = table.where(F.col("variable") == variable).select(*keys, "value")
    return select_members(one, nodes, "node")
