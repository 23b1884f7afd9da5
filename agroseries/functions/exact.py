"""Exact sums of DOUBLE values, in native columns.

A double is an integer times a power of two. It is cut into *limbs* of 24 bits at fixed places, which
are added up as BIGINT, so a sum does not depend on the order of its terms, on partial aggregation
or on how a series is cut. Afterwards the limbs are carried and rounded to the nearest double once.

Values are multiples of 2 ** -LOW below 2 ** LOW in magnitude (about 1e79, and steps of 1e-79 or more). Others raise
an error instead of being dropped. A limb has room for 2 ** 39 terms, beyond which BIGINT sums raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, COUNT = 24, 22
LOW = WIDTH * COUNT // 2
BASE = 1 << WIDTH


def _power(exponent: int) -> Column:
    return F.lit(2.0**exponent)


def _whole(value: Column) -> Column:
    """Whole part of a non-negative double as a double; from 2 ** 53 on it is one."""
    return F.when(value < _power(53), F.floor(value).cast("double")).otherwise(value)


def split(df: DataFrame, value: Column, limbs: Sequence[str]) -> DataFrame:
    """``df`` with the COUNT limbs of a DOUBLE, lowest first; NULL for NULL, NaN and infinite values.

    Step by step in columns, so that no step is written out once for each of its uses.
    """
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    scaled = F.col("_scaled")
    inside = (scaled < _power(2 * LOW)) & (scaled == _whole(scaled))
    error = F.raise_error(F.lit("a value beyond the range of exact sums")).cast("double")
    df = df.withColumn("_scaled", F.abs(finite) * _power(LOW)).withColumns(
        {
            "_sign": F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint"),
            "_scaled": F.when(inside | scaled.isNull(), scaled).otherwise(error),
        }
    )
    df = df.withColumns({f"_whole_{k}": _whole(scaled * _power(-WIDTH * k)) for k in range(COUNT)})
    wholes = [F.col(f"_whole_{k}") for k in range(COUNT)] + [F.lit(0.0)]
    cut = {n: F.col("_sign") * (low - high * BASE).cast("bigint") for n, low, high in zip(limbs, wholes, wholes[1:])}
    return df.withColumns(cut).drop("_scaled", "_sign", *[f"_whole_{k}" for k in range(COUNT)])


def _carried(limbs: Column) -> Column:
    """Digits in [0, 2 ** WIDTH), lowest first, and after them the carry, -1 if the sum is negative."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(state: Column, limb: Column) -> Column:
        total = limb + state["carry"]
        carry = F.shiftright(total, WIDTH)
        digit = total.bitwiseAND(F.lit(BASE - 1))
        return F.struct(carry.alias("carry"), F.array_append(state["digits"], digit).alias("digits"))

    padded = F.concat(limbs, F.array_repeat(F.lit(0).cast("bigint"), 3))  # room for the sum of many terms
    return F.aggregate(padded, start, step, lambda x: F.array_append(x["digits"], x["carry"]))


def rounded(df: DataFrame, limbs: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``, the double nearest to a sum of limbs, ties to even; NULL if there was no term.

    The four highest digits make two integers of at most 48 bits, of which the lower one gets an odd last bit
    if lower digits follow. Adding the two is then the only rounding.
    """
    summed = F.array(*[F.col(n) for n in limbs])
    df = df.withColumn("_limbs", summed).withColumn("_digits", _carried(F.col("_limbs")))
    df = df.withColumn("_negative", F.element_at("_digits", -1) < 0)
    turned = F.when(F.col("_negative"), _carried(F.transform("_limbs", lambda x: -x))).otherwise(F.col("_digits"))
    df = df.withColumn("_digits", F.reverse(F.slice(turned, 1, COUNT + 3)))
    # leading zeros go, so that the highest digit is not zero; at least four digits stay
    place = F.transform("_digits", lambda d, i: F.when(d != 0, i))
    df = df.withColumn("_first", F.least(F.coalesce(F.array_min(place), F.lit(COUNT)), F.lit(COUNT - 1)) + 1)
    df = df.withColumn("_top", F.slice("_digits", F.col("_first"), F.lit(4)))
    rest = F.exists(F.slice("_digits", F.col("_first") + 4, F.lit(COUNT + 3)), lambda d: d != 0)
    top = F.col("_top")
    high = (top[0] * BASE + top[1]).cast("double")
    low = (top[2] * BASE + top[3]).bitwiseOR(rest.cast("bigint")).cast("double")
    exponent = (COUNT - F.col("_first")).cast("double") * WIDTH - LOW
    value = (high * _power(2 * WIDTH) + low) * F.pow(F.lit(2.0), exponent)
    signed = F.when(F.col("_negative"), -value).otherwise(value)
    made = df.withColumn("_rounded", F.when(F.col(limbs[0]).isNotNull(), signed))
    return made.withColumn(out, F.col("_rounded")).drop(*limbs, "_limbs", "_digits", "_negative", "_first", "_top", "_rounded")
