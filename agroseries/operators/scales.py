"""Passing values between the scales of a plant: organs to plant, scene to organs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroseries.functions import aggregates as a


def scale_gather(
    organs: Mapping[str, DataFrame],
    values: Mapping[str, str],
    out: str,
    keys: Sequence[str] = ("Site", "timestep"),
) -> DataFrame:
    """One variable of several organ tables, summarised per plant and step.

    ``values`` maps each organ to its column. A consumer of the gathered vector needs its sum, mean
    or size, so these are aggregated directly; the vector itself is never built in a row.
    """
    frames = [
        organs[organ].select(*keys, F.col(column).alias(out)) for organ, column in values.items()
    ]
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame)
    return united.groupBy(*keys).agg(
        F.sum(out).alias(out), a.mean(out).alias(f"{out}_mean"), F.count("*").alias(f"{out}_n")
    )


def scale_broadcast(
    nodes: DataFrame,
    single: DataFrame,
    values: Mapping[str, str],
    keys: Sequence[str] = ("Site", "timestep"),
) -> DataFrame:
    """Values of a one-node scale on every node of another; ``values`` maps new names to columns."""
    given = single.select(*keys, *[F.col(column).alias(out) for out, column in values.items()])
    return nodes.join(given, list(keys), "left")
