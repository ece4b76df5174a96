"""Order of the rows of a series, and the frames over them.

Every indicator looks at one series (``key``) in time order. Bars are unique per
(key, grain), so the grain bounds a series; the recurrences take it block by block
with the exact state carried over, in memory of one block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """``block_rows`` bounds the rows of a block; by default a block is an Arrow batch. The result is the same for any."""

    block_rows: int | None = None


WHOLE = Layout()


def number_rows(bars: DataFrame, key: Sequence[str], order: str, chunk_seconds: int) -> DataFrame:
    """Add ``pos`` (0-based row number in the series) and ``n_bars`` without one task per series.

    Rows are counted per (key, time chunk); the running sum over those few counts
    gives each chunk its first row number.
    """
    chunk = F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / F.lit(chunk_seconds))
    chunked = bars.withColumn("_chunk", chunk)
    series = Window.partitionBy(*key)
    earlier = series.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunked.groupBy(*key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("n_bars", F.sum("_n").over(series))
        .drop("_n")
    )
    within = Window.partitionBy(*key, "_chunk").orderBy(order)
    return (
        chunked.join(starts, [*key, "_chunk"])
        .withColumn("pos", F.col("_start") + F.row_number().over(within) - 1)
        .drop("_chunk", "_start")
    )


def arrange(bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt") -> DataFrame:
    """Add ``pos`` and ``n_bars``; the rows of a series come out in order."""
    series = Window.partitionBy(*key)
    counted = bars.withColumn("n_bars", F.count(F.lit(1)).over(series))
    return counted.withColumn("pos", F.row_number().over(series.orderBy(order)).cast("long") - 1)


def series_window(key: Sequence[str] = ("symbol",), order: str = "dt") -> WindowSpec:
    return Window.partitionBy(*key).orderBy(order)


def rolling(agg: Column, rows: int, window: WindowSpec, counted: Column) -> Column:
    """Aggregate over the last ``rows`` rows, null until the frame is full."""
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(counted).over(frame) == rows, agg.over(frame))
