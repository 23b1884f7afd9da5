"""What a weather table must satisfy before anything is joined to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def contract_violations(
    df: DataFrame, schema: StructType, key: Sequence[str] = ("Site", "date")
) -> DataFrame:
    """(column, problem, n_bad) rows; none when the table fulfils the contract.

    Problems: a missing column, another type, NULLs in a column, keys that occur more than once.
    The NULL counts take one pass, the key counts one aggregation.
    """
    spark = df.sparkSession
    have = {field.name: field.dataType for field in df.schema}
    structural = [
        (f.name, "missing column" if f.name not in have else "type", 1)
        for f in schema
        if have.get(f.name) != f.dataType
    ]
    present = [f.name for f in schema if f.name in have]

    found = []
    if present:
        nulls = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in present])
        found.append(nulls.unpivot([], present, "column", "n_bad").withColumn("problem", F.lit("null")))
    if all(name in have for name in key):
        repeated = df.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("n_bad"))
        found.append(
            repeated.withColumns({"column": F.lit(",".join(key)), "problem": F.lit("repeated key")})
        )
    if structural:
        found.append(
            spark.createDataFrame(structural, "column string, problem string, n_bad bigint")
        )
    violations = found[0]
    for more in found[1:]:
        violations = violations.unionByName(more)
    return violations.where(F.col("n_bad") > 0).select("column", "problem", "n_bad")
