"""Ordered scans (running sums, row numbers, previous values) that survive a hot series.

``Window.partitionBy(series)`` hands a whole series to one task. Sites are few, so that is a third
of the table per task. Here a series is cut into consecutive *blocks*: the blocks are summarised
with a partial aggregation, the summaries are scanned, and each block starts from a seed row that
carries what came before it. The rows are shuffled once, by (series, block), and no task sees more
than one block. Blocks may be nested (month, then day): the summaries are then scanned the same
way, so their windows stay small too.

Seeds join the rows as extra rows sorted in front of the block, not through a join, so NULL series
keys keep their group and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroseries.functions.aggregates import order_key
from agroseries.sources.shared import saved

Blocks = Mapping[str, Column] | None

SEED = "_scan_seed"


class Carry(NamedTuple):
    """A value carried along a series.

    ``total`` summarises a block, ``scan`` combines values and seeds in the window.
    """

    value: Column
    total: Callable[[Column], Column]
    scan: Callable[[Column], Column]


def carry_sum(value: Column) -> Carry:
    return Carry(value, F.sum, F.sum)


def carry_min(value: Column) -> Carry:
    return Carry(value, F.min, F.min)


def carry_last(value: Column, order: Sequence[str]) -> Carry:
    return Carry(value, lambda c: F.max_by(c, order_key(order)), F.last)


def carry_count() -> Carry:
    return carry_sum(F.lit(1).cast("bigint"))


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    carries: Mapping[str, Carry],
    blocks: Blocks = None,
    upto: int = 0,
    keep_blocks: bool = False,
) -> DataFrame:
    """Add one column per carry: its scan from the start of the series to row ``upto`` (0 or -1).

    ``order`` must be unique within a series. ``blocks`` maps names to expressions that never
    decrease along ``order``, coarse first; without blocks a series is one window partition, which
    suits series of a bounded length only (a row per day or month). The plan is the same at every size.
    """
    blocks = dict(blocks or {})
    values = {f"_value_{name}": carry for name, carry in carries.items()}
    work = df.withColumns({**blocks, **{v: c.value for v, c in values.items()}})
    cell = [*by, *blocks]
    sequence = [F.col(c) for c in order]

    if blocks:
        *coarse, finest = blocks
        totals = work.groupBy(*cell).agg(*[c.total(F.col(v)).alias(v) for v, c in values.items()])
        before = scan(
            totals,
            by,
            [finest],
            {v: Carry(F.col(v), _total_of_totals(c, finest), c.scan) for v, c in values.items()},
            {name: F.col(name) for name in coarse},
            upto=-1,
            keep_blocks=True,
        )
        seeds = before.select(*cell, *values).withColumn(SEED, F.lit(0))
        work = work.withColumn(SEED, F.lit(1)).unionByName(seeds, allowMissingColumns=True)
        sequence = [F.col(SEED), *sequence]

    window = (
        Window.partitionBy(*cell).orderBy(*sequence).rowsBetween(Window.unboundedPreceding, upto)
    )
    # computed under fresh names: a carry may replace the column it reads
    work = work.withColumns({f"_scan{v}": c.scan(F.col(v)).over(window) for v, c in values.items()})
    if blocks:
        work = work.where(F.col(SEED) == 1)
    results = {name: F.col(f"_scan_value_{name}") for name in carries}
    dropped = [*values, *[f"_scan{v}" for v in values], SEED]
    if not keep_blocks:
        dropped += [b for b in blocks if b not in df.columns]
    return work.withColumns(results).drop(*[c for c in dropped if c not in carries])


def _total_of_totals(carry: Carry, finest: str) -> Callable[[Column], Column]:
    """How block summaries add up: the last of lasts is the one of the latest block."""
    if carry.scan is F.last:
        return lambda c: F.max_by(c, F.col(finest))
    return carry.scan


def even_blocks(
    df: DataFrame, by: Sequence[str], order: Sequence[str], partitions: int
) -> DataFrame:
    """Column ``_block``: blocks of about equal size for any distribution of the rows.

    For a series without a calendar, or with most of its rows on one day; pass
    ``{"_block": F.col("_block")}`` as blocks to the operator. They are range partitions of (series, order). The rows are written with their block number, as
    a recomputed range partitioning may cut elsewhere.
    """
    ranged = df.repartitionByRange(partitions, *by, *order)
    return saved(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def summaries_before(
    totals: DataFrame, series: str, blocks: Sequence[str], rows: str, amount: str, least: str
) -> DataFrame:
    """What came before each block: (series, blocks, ``rows``, ``amount``, ``least``), all earlier blocks.

    ``totals`` has a row per block: its number of rows, the sum of its amounts, and the least value of
    amount minus position inside it. Such summaries add up: of two blocks in a row the later one's least value
    moves by the amount and the rows of the earlier one. Nested blocks (coarse first) are summed up
    and scanned level by level, so no window holds more than the blocks of one coarse block. ``series``
    is a struct, which joins with NULLs inside.
    """
    *coarse, finest = blocks
    group = Window.partitionBy(series, *coarse).orderBy(finest)
    earlier = group.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    before = totals.withColumns(
        {
            "_before_rows": F.coalesce(F.sum(rows).over(earlier), none),
            "_before_sum": F.coalesce(F.sum(amount).over(earlier), none),
        }
    )
    moved = F.col("_before_sum") - F.col("_before_rows") + F.col(least)
    before = before.withColumn("_before_moved", moved).withColumn("_before_least", F.min("_before_moved").over(earlier))
    key = F.struct(series, *coarse)
    if coarse:
        sums = [F.sum(rows).alias(rows), F.sum(amount).alias(amount), F.min("_before_moved").alias(least)]
        above = summaries_before(before.groupBy(series, *coarse).agg(*sums), series, coarse, rows, amount, least)
        above = above.select(key.alias("_before_key"), *[F.col(n).alias(f"_above_{n}") for n in (rows, amount, least)])
        before = before.withColumn("_before_key", key).join(above, "_before_key")
        over = {n: F.col(f"_above_{n}") for n in (rows, amount, least)}
        inside = over[amount] - over[rows] + F.col("_before_least")
        before = before.withColumns(
            {
                "_before_least": F.least(over[least], inside),
                "_before_rows": over[rows] + F.col("_before_rows"),
                "_before_sum": over[amount] + F.col("_before_sum"),
            }
        )
    renamed = {"_before_rows": rows, "_before_sum": amount, "_before_least": least}
    return before.select(series, *blocks, *[F.col(n).alias(out) for n, out in renamed.items()])
