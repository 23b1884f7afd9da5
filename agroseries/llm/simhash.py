"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is cut into 32 segments of two bits. Its embedding has one coordinate per
segment, the number of set bits (0, 1, 2). Flipping one bit moves one coordinate by one, so the
Manhattan distance of embeddings never exceeds the bit distance of fingerprints: close fingerprints
have close embeddings. The coordinates are kept in unary (00, 01, 11), which makes the Manhattan
distance the bit count of an XOR.

Grid: the coordinates are split into bands so that two embeddings within the limit agree up to one
step in at least one band. A fingerprint is stored once per band under its cell and looks into that
cell and the cells one step up (one step down is the other one's step up). The join keeps a pair only
if the Manhattan distance and then the true bit distance hold, so nothing but links leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.llm.components import components
from agroseries.sources.shared import saved

SEGMENTS = 32
LOW = 0x5555555555555555
BLOCK = 1 << 16
FP, ROW = "__llm_fp", "__llm_row"


def fingerprint_of(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of ASCII-lower-cased word shingles (XXH64); 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    digest, ones, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for begin in range(0, count, BLOCK):
        some = words[begin : min(begin + BLOCK, count) + width - 1]
        spans = zip(*[some[k:] for k in range(width)])
        hashes = np.array([digest(b" ".join(s), seed) for s in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return simhash(text.cast("binary"))


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def embedding(fp: Column) -> Column:
    """Segment bit counts in unary, two bits each."""
    low, up = F.lit(LOW), F.shiftright(fp, 1)
    some = fp.bitwiseOR(up).bitwiseAND(low)
    both = fp.bitwiseAND(up).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bands(distance: int) -> list[list[int]]:
    """Segments of each band; within ``distance`` some band differs by at most one step."""
    n = distance // 2 + 1
    return [list(range(b * SEGMENTS // n, (b + 1) * SEGMENTS // n)) for b in range(n)]


def links(fingerprints: DataFrame, distance: int) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (column ``fp``) within ``distance`` bits, once each."""
    bands = _bands(distance)
    masks = [_signed(sum(3 << (2 * s) for s in band)) for band in bands]
    steps = distance // len(bands)
    base = fingerprints.select("fp").distinct().withColumn("u", embedding(F.col("fp")))
    u = F.col("u")

    def cell(band: int, key: Column) -> Column:
        return F.struct(F.lit(band).alias("band"), key.bitwiseAND(F.lit(masks[band])).alias("cell"))

    def up(band: int, s: int) -> Column:
        low, high = F.lit(_signed(1 << (2 * s))), F.lit(_signed(2 << (2 * s)))
        raised = u.bitwiseOR(F.shiftleft(u.bitwiseAND(low), 1)).bitwiseOR(low)
        return F.when(u.bitwiseAND(high) == 0, cell(band, raised))

    homes = [cell(b, u) for b in range(len(bands))]
    looks = homes + ([up(b, s) for b in range(len(bands)) for s in bands[b]] if steps else [])
    stored = base.select(F.col("fp").alias("a"), u.alias("ua"), F.inline(F.array(*homes)))
    asking = base.select(F.col("fp").alias("b"), u.alias("ub"), F.inline(F.filter(F.array(*looks), lambda x: x.isNotNull())))
    moved = F.col("ua").bitwiseXOR(F.col("ub"))
    near = [F.bit_count(moved.bitwiseAND(F.lit(m))) <= steps for m in masks]
    first = F.lit(True)  # of the bands that would find a pair, only the first does
    for b in range(1, len(bands)):
        earlier = near[0]
        for n in near[1:b]:
            earlier = earlier | n
        first = first & ((stored["band"] != b) | ~earlier)
    own = F.bit_count(moved.bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in masks]), stored["band"] + 1))) == 0
    found = (
        (stored["band"] == asking["band"]) & (stored["cell"] == asking["cell"])
        & (~own | (F.col("a") < F.col("b")))
        & (F.bit_count(moved) <= distance)
        & first
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )
    return stored.join(asking, found).select("a", "b")


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 3, distance: int = 3
) -> DataFrame:
    """The rows and columns of ``df`` with ``FP``, ``ROW``, ``component_id`` and ``keeper``.

    Rows are linked when their fingerprints differ in at most ``distance`` bits; ``component_id`` is
    the smallest id reachable and ``keeper`` marks one row of each component, the one with that id
    (of repeated ids the first row). Null and empty texts have fingerprint zero and link like any
    other; null ids take part but name a component only if it has no other id. Whole texts count.
    An empty table gives none. A column of ``df`` named like an added one is replaced.

    Copies are folded into their fingerprint before any join, so a group of equal texts is one row
    of the search, however large.
    """
    rows = df.drop("component_id", "keeper").withColumn(FP, fingerprint(F.col(text_col), shingle))
    rows = saved(rows.withColumn(ROW, F.monotonically_increasing_id()), "simhash")
    ids = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(ROW).alias("row"))
    distinct = saved(rows.groupBy(F.col(FP).alias("fp")).agg(F.min(ids).alias("first")), "fingerprints")
    found = saved(links(distinct, distance), "links")
    label = components(found, "a", "b")
    named = distinct.join(label, distinct["fp"] == label["node"], "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("first").alias("least"))
    classes = named.join(smallest, "label").select(
        F.col("fp").alias(FP), F.col("least.id").alias("component_id"), F.col("least.row").alias("__llm_least")
    )
    classes = saved(classes, "classes")
    return rows.join(classes, FP).withColumn("keeper", F.col(ROW) == F.col("__llm_least")).drop("__llm_least")
