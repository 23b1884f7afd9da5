"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agroseries.functions.constants import SCALES


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str, sep: str = ","
) -> DataFrame:
    """CSV with a header line; a path ending in .bz2 is decompressed, split across tasks."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(paths)


def write_csv(
    df: DataFrame, path: str, sep: str = ",", compression: str | None = None
) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_by(
    df: DataFrame, path: str, keys: Sequence[str] = ("Site",), rows_per_file: int = 20_000_000
) -> None:
    """Parquet with one folder per key value, so that a filter on the key reads that folder only.

    The rows are rebalanced by key: few files per folder, and a site with a third of the rows is
    still split over many tasks, which a plain repartition by key would give to one.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*keys)
        .parquet(path)
    )


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_scales(
    spark: SparkSession, path: str, scales: Sequence[str] = SCALES, organ: str = "organ"
) -> dict[str, DataFrame]:
    """Handles on the scales of an output table stored by organ; each reads its own folder."""
    table = spark.read.parquet(path)
    return {scale: table.where(F.col(organ) == scale).drop(organ) for scale in scales}
