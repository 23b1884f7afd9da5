"""Nested parameter documents as (path, value) rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten(document: object, prefix: str = "") -> dict[str, str]:
    """Nested mappings to dotted paths; values become text."""
    if not isinstance(document, Mapping):
        return {prefix: str(document)}
    flat: dict[str, str] = {}
    for key, value in document.items():
        flat |= flatten(value, f"{prefix}.{key}" if prefix else str(key))
    return flat


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading parameter documents needs PyYAML on the executors") from error

    for batch in batches:
        rows = [
            (file, path, value)
            for file, text in zip(batch["file"], batch["text"], strict=True)
            for path, value in flatten(yaml.safe_load(text) or {}).items()
        ]
        yield pd.DataFrame(rows, columns=["file", "path", "value"])


def scan_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, value) rows of all parameter documents under ``path``.

    A document is one row while it is read, so any number of per-site documents is parsed in
    parallel.
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text")
    )
    return documents.mapInPandas(_parse, "file string, path string, value string")
