"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows of source partition p belong to shard s in a uniformly random assignment follows a
multivariate hypergeometric law. The counts are drawn first (numbers only, partitions times shards),
so every row knows its shard from its place in a local permutation: permute each partition locally,
deal consecutive runs to the shards, exchange once, permute again inside the shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroseries.sources.shared import saved

BROADCAST_BYTES = 64 << 20
PART, PLACE, CELL, KEY = "__llm_part", "__llm_place", "__llm_cell", "__llm_key"


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good items among ``drawn`` of ``good + bad``: inverse transform over log weights.

    The window is 12 standard deviations around the mean, beyond which no double is left. It has no
    limit on the population, where numpy's own sampler stops at a billion.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mean = drawn * good / total
    spread = math.sqrt(mean * (bad / total) * (total - drawn) / max(1, total - 1))
    reach = 12 * spread + 12
    low, high = max(low, math.floor(mean - reach)), min(high, math.ceil(mean + reach))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; rows sum to ``counts``, columns to ``sizes``."""
    rng = np.random.default_rng(seed)
    left = [int(s) for s in sizes]
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest, others = int(n), sum(left)
        for s, open_places in enumerate(left):
            others -= open_places
            matrix[p, s] = hypergeometric(rng, open_places, others, rest)
            rest -= int(matrix[p, s])
        left = [a - int(b) for a, b in zip(left, matrix[p], strict=True)]
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(
    df: DataFrame,
    shards: int,
    seed: int = 42,
    rows_per_cell: int = 1 << 14,
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """All rows and columns of ``df`` with their shard and their slot (from 0, gapless) in it.

    Every assignment of rows to (shard, slot) is equally likely, and shard sizes differ by at most
    one. Rows are told apart by their place in the input, so nulls, equal rows and empty texts are
    rows like any other; an empty table gives none. Columns already named like ``shard`` or ``slot``
    are replaced, all others pass through.

    The partition of a row and its place in the local permutation are written to the shared folder
    before anything depends on them, so a retried task cannot deal differently. Inside a shard, rows
    fall into cells by a random key; a task sorts one cell, whatever the size of the shard. The
    matrix and the cell counts are numbers per partition and per cell; the matrix is broadcast while
    it is under ``BROADCAST_BYTES`` and joined by partition beyond that.
    """
    spark = df.sparkSession
    low_bits = F.lit((1 << 33) - 1)
    keyed = df.drop(shard, slot).withColumn(PART, F.spark_partition_id())
    keyed = keyed.withColumn(KEY, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    permuted = keyed.sortWithinPartitions(KEY).drop(KEY)
    placed = permuted.withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(low_bits))
    staged = saved(placed, "shuffle")

    counts = sorted((r[0], r[1]) for r in staged.groupBy(PART).count().collect())
    rows = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], even_sizes(rows, shards), seed)
    ends = spark.createDataFrame(
        [(p, row.tolist()) for (p, _), row in zip(counts, matrix.cumsum(axis=1), strict=True)],
        f"{PART} int, __llm_ends array<bigint>",
    )
    if matrix.nbytes <= BROADCAST_BYTES:
        ends = F.broadcast(ends)
    place = F.col(PLACE)
    dealt = staged.join(ends, PART).withColumn(
        shard, F.size(F.filter("__llm_ends", lambda end: end <= place)).cast("int")
    )
    cells = max(1, math.ceil(rows / shards / rows_per_cell))
    dealt = dealt.withColumn(KEY, F.xxhash64(F.lit(seed + 1), PART, PLACE)).withColumn(
        CELL, F.pmod(KEY, F.lit(cells))
    )
    sizes = saved(dealt.groupBy(shard, CELL).agg(F.count("*").alias("__llm_n")), "cells")
    before = Window.partitionBy(shard).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, CELL, F.coalesce(F.sum("__llm_n").over(before), F.lit(0)).alias("__llm_start"))
    in_cell = F.row_number().over(Window.partitionBy(shard, CELL).orderBy(KEY)) - 1
    numbered = dealt.join(starts, [shard, CELL]).withColumn(
        slot, (F.col("__llm_start") + in_cell).cast("bigint")
    )
    return numbered.select(*[c for c in df.columns if c not in (shard, slot)], shard, slot)
