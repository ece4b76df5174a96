"""Nested JSON payloads of finished tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_object(*columns: str) -> Column:
    """The columns as one JSON object, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_rows(table: DataFrame, *columns: str) -> DataFrame:
    """One JSON object per row, null fields kept."""
    fields = columns or tuple(table.columns)
    return table.select(json_object(*fields).alias("json"))


def write_json(table: DataFrame, path: str) -> None:
    """JSON lines, written by all tasks; nothing passes through the driver."""
    table.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
