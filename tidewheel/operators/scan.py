"""Smoothings within one long series over many tasks, as an associative scan.

A smoothing maps the state ahead of a block to the state after it by a linear function. Each block's function is found by itself, the few functions
of a series are composed in order, and each block is then smoothed from the exact state that the composition gives it. So a
series of any length is spread over tasks; memory is one block's. Values are those of the fold up to the rounding of doubles.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.operators.layout import number_rows
from tidewheel.operators.recurrences import ATR_SPAN, BASE_SPAN, EPSILON, FAST_SPAN, RSI_SPAN, SLOW_SPAN, Smoother, span_alpha

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block.
BLOCK = 65_536
#: Seconds by which rows are counted to number them.
CHUNK_SECONDS = 90 * 86_400
_SUMMARY = ("lead", "first", "own", "weight", "trail")


def blocks(bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", rows: int = BLOCK, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add pos, n_bars and block; no task holds a whole series."""
    return number_rows(bars, key, order, chunk_seconds).withColumn("block", F.floor(F.col("pos") / rows))


def previous(frame: DataFrame, columns: Sequence[str], key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add the value one row before of each column as ``<column>_prev``; that of a block's first row comes from the block before."""
    own = Window.partitionBy(*key, "block").orderBy("pos")
    ends = frame.groupBy(*key, (F.col("block") + 1).alias("block")).agg(*[F.max_by(c, "pos").alias(f"_end_{c}") for c in columns])
    first = F.row_number().over(own) == 1
    return frame.join(ends, [*key, "block"], "left").withColumns({
        f"{c}_prev": F.when(first, F.col(f"_end_{c}")).otherwise(F.lag(c).over(own)) for c in columns}).drop(*[f"_end_{c}" for c in columns])


def summary(values: np.ndarray, alpha: float) -> tuple[float, float, float, float, float]:
    """What a block does to the state ahead of it.

    Rows ahead of the first value; that value; the state after the block if it begins with that value; the weight in it of another state
    there; rows after the last value. Without a value, the block only lengthens the gap.
    """
    there = np.flatnonzero(~np.isnan(values))
    nan = float("nan")
    if not len(there):
        return float(len(values)), nan, nan, nan, float(len(values))
    faded = (1 - alpha) ** np.diff(there).astype("float64")
    end = Smoother(alpha)(values)[-1]
    return float(there[0]), values[there[0]], end, float(np.prod(faded / (faded + alpha))), float(len(values) - 1 - there[-1])


def composed(summaries: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """State and rows since its last value ahead of each block; rows of ``summaries`` are the blocks of a series in order."""
    state, gap = float("nan"), 0.0
    states, gaps = [], []
    for lead, first, own, weight, trail in summaries.tolist():
        states.append(state)
        gaps.append(gap)
        if first != first:
            gap += lead if state == state else 0.0
            continue
        begin = first
        if state == state:
            faded = (1 - alpha) ** (gap + lead + 1)
            begin = (faded * state + alpha * first) / (faded + alpha)
        state, gap = own + weight * (begin - first), trail
    return np.array(states), np.array(gaps)


def seeded(values: np.ndarray, alpha: float, state: float, gap: float) -> np.ndarray:
    """A block's smoothing from the state ahead of it."""
    there = np.flatnonzero(~np.isnan(values))
    if state != state or not len(there):
        return Smoother(alpha)(values) if state != state else np.full(len(values), state)
    lead = int(there[0])
    faded = (1 - alpha) ** (gap + lead + 1)
    begun = values.copy()
    begun[lead] = (faded * state + alpha * values[lead]) / (faded + alpha)
    out = Smoother(alpha)(begun)
    out[:lead] = state
    return out


def smoothed(frame: DataFrame, columns: Mapping[str, tuple[str, float]], key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add exponential smoothings ``{output: (input column, alpha)}`` to rows with pos and block (``blocks``).

    The rows of a block may come in any order. A missing value keeps the smoothing and weakens its weight.
    """
    ordered = {out: (src, alpha) for out, (src, alpha) in columns.items()}
    inputs = sorted({src for src, _ in ordered.values()})
    keys = [frame.schema[k] for k in (*key, "block")]
    fields = [T.StructField(f"{out}_{part}", T.DoubleType()) for out in ordered for part in _SUMMARY]
    ahead = [T.StructField(f"{out}_{part}", T.DoubleType()) for out in ordered for part in ("state", "gap")]

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype("float64")

    def keys_of(table: pa.Table, rows: int | None = None) -> dict:
        return {f.name: table.column(f.name).slice(0, rows) if rows else table.column(f.name) for f in keys}

    def summarize(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        out = keys_of(table, 1)
        for name, (src, alpha) in ordered.items():
            out |= {f"{name}_{part}": [v] for part, v in zip(_SUMMARY, summary(column(table, src), alpha), strict=True)}
        return pa.table(out)

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out = keys_of(table)
        for name, (_, alpha) in ordered.items():
            states, gaps = composed(np.column_stack([column(table, f"{name}_{part}") for part in _SUMMARY]), alpha)
            out |= {f"{name}_state": pa.array(states), f"{name}_gap": pa.array(gaps)}
        return pa.table(out)

    def smooth(rows: pa.Table, seeds: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        for name, (src, alpha) in ordered.items():
            state, gap = (seeds.column(f"{name}_{part}")[0].as_py() for part in ("state", "gap"))
            rows = rows.append_column(name, pa.array(seeded(column(rows, src), alpha, state, gap), from_pandas=True))
        return rows

    parts = frame.select(*key, "block", "pos", *inputs).groupBy(*key, "block").applyInArrow(summarize, T.StructType(keys + fields))
    seeds = parts.groupBy(*key).applyInArrow(compose, T.StructType(keys + ahead))
    whole = T.StructType(frame.schema.fields + [T.StructField(out, T.DoubleType()) for out in ordered])
    return frame.groupBy(*key, "block").cogroup(seeds.groupBy(*key, "block")).applyInArrow(smooth, whole)


def strength_index(frame: DataFrame, key: Sequence[str] = ("symbol",), span: int = RSI_SPAN) -> DataFrame:
    """Add ``rsi``; missing on the first bar."""
    change = F.col("close") - F.col("close_prev")
    moved = previous(frame, ["close"], key).withColumns({
        "_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}).drop("close_prev")
    both = smoothed(moved, {"_up": ("_gain", 1.0 / span), "_down": ("_loss", 1.0 / span)}, key)
    return both.withColumn("rsi", 100 - 100 / (1 + F.col("_up") / (F.col("_down") + EPSILON))).drop("_gain", "_loss", "_up", "_down")


def true_range(frame: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ``atr`` and the base line ``ema55``."""
    before = F.col("close_prev")
    spans = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    ranged = previous(frame, ["close"], key).withColumn("_range", spans).drop("close_prev")
    return smoothed(ranged, {"atr": ("_range", span_alpha(ATR_SPAN)), "ema55": ("close", span_alpha(BASE_SPAN))}, key).drop("_range")


def _around(frame: DataFrame, source: str, out: str, key: Sequence[str]) -> DataFrame:
    """Fast against slow average of a column, around 100; without a value where the slow one is 0."""
    both = smoothed(frame, {"_fast": (source, span_alpha(FAST_SPAN)), "_slow": (source, span_alpha(SLOW_SPAN))}, key)
    return both.withColumn(out, 100 + F.try_divide(F.col("_fast") - F.col("_slow"), F.col("_slow")) * 100).drop("_fast", "_slow")


def rotation(frame: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ratio, momentum and ``ema50`` to rows with bench_close; the momentum is a second scan over the ratio."""
    lined = frame.withColumn("_line", F.try_divide(100 * F.col("close"), F.col("bench_close")))
    ratio = _around(lined, "_line", "ratio", key).drop("_line")
    return smoothed(_around(ratio, "ratio", "mom", key), {"ema50": ("close", span_alpha(50))}, key)
