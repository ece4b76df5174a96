"""Recurrences that no SQL frame can express, as a fold over the blocks of a series.

Smoothing, relative rotation and the ratcheting trend band need the previous
*result*, not the previous row. Spark partitions and orders the rows; a task
takes one series block by block and carries the exact state from one to the next: the last
value of each average, the tails of the frames, the last bands and trend. So
there is one path for every length: time is linear in the rows, memory is one block's.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewheel.operators.layout import WHOLE, Layout

# Executors get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the trend band.
ATR_SPAN = 13
RSI_SPAN = 13
BASE_SPAN = 55
BAND_FRAME = 50
MIN_MULT = 1.0
MAX_MULT = 5.0
EPSILON = 1e-9

# Fixed values of the rotation measure.
FAST_SPAN = 10
SLOW_SPAN = 26

_ARROW = {T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}


def _arrow_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_integer(kind):
        missing = np.isnan(values)
        return pa.array(np.where(missing, 0, values).astype("int32"), kind, mask=missing)
    return pa.array(values, kind, from_pandas=True)


Columns = dict[str, np.ndarray]
Step = Callable[[Columns], Columns]


class Memory:
    """Numbers that a step keeps from one block to the next."""

    def __init__(self, *values: float) -> None:
        self.values = np.array(values, dtype="float64")

    def keep(self) -> list[float]:
        return self.values.tolist()

    def resume(self, values: Sequence[float]) -> None:
        self.values = np.array(values, dtype="float64")


def kept(step: Step) -> list[list[float]]:
    """All that a step remembers, part by part; a new step of the same kind goes on from it to the last bit."""
    return [part.keep() for part in step.parts]


def resume(step: Step, state: Sequence[Sequence[float]]) -> Step:
    """Let a new step go on from what another one of its kind ``kept``."""
    for part, values in zip(step.parts, state, strict=True):
        part.resume(values)
    return step


def per_series(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], outputs: Mapping[str, T.DataType],
               fold: Callable[[], Step], block_rows: int | None = None) -> DataFrame:
    """Append ``outputs``; ``fold`` makes a step for a series, which gets the ``inputs`` of its blocks in ``pos`` order.

    A block is an Arrow batch, or at most ``block_rows`` rows of it. The rows of a series come in the order of the windows that
    numbered them; any other order is refused.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in outputs.items()])
    arrow_types = {n: _ARROW[t] for n, t in outputs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, reached = fold(), -1
        for batch in batches:
            size = block_rows or max(batch.num_rows, 1)
            for begin in range(0, batch.num_rows, size):
                block = batch.slice(begin, size)
                pos = block.column("pos").to_numpy()
                if pos[0] <= reached or (np.diff(pos) < 1).any():
                    raise ValueError("the rows of a series are out of order")
                reached = pos[-1]
                result = step({c: block.column(c).to_numpy(zero_copy_only=False) for c in inputs})
                yield pa.RecordBatch.from_arrays(
                    [*block.columns, *(_arrow_column(result[n], kind) for n, kind in arrow_types.items())],
                    [*block.schema.names, *arrow_types])

    return df.groupBy(*keys).applyInArrow(run, schema)


class Smoother:
    """Exponential smoothing seeded by the first value that is present, continued from block to block."""

    def __init__(self, alpha: float) -> None:
        self.com, self.last, self.weight = (1.0 - alpha) / alpha, float("nan"), 1.0
        self.alpha = 1.0 / (1.0 + self.com)  # rounded as within a block

    def keep(self) -> list[float]:
        return [float(self.last), self.weight]

    def resume(self, values: Sequence[float]) -> None:
        self.last, self.weight = values

    def _faded(self, rows: int) -> float:
        """The weight of the last result after so many more rows, step by step, so that it is the same for any blocks."""
        return float(np.multiply.accumulate(np.r_[self.weight, np.full(rows, 1.0 - self.alpha)])[-1])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        there = np.flatnonzero(~np.isnan(values))
        begun = self.last == self.last
        if not len(there):
            if begun:
                self.weight = self._faded(len(values))
            return np.full(len(values), self.last)
        first, own = int(there[0]), values
        if begun:
            # Rows without a value have weakened the last result: the first value takes it in with the weight that is left.
            weight, own = self._faded(first + 1), values.copy()
            if self.last != values[first]:
                own[first] = (weight * self.last + self.alpha * values[first]) / (weight + self.alpha)
        out = pd.Series(own).ewm(com=self.com, adjust=False).mean().to_numpy()
        if begun:
            out = np.r_[np.full(first, self.last), out[first:]]
        self.last, self.weight = out[-1], 1.0
        self.weight = self._faded(len(values) - 1 - int(there[-1]))
        return out


class Lag(Memory):
    """The values ``rows`` earlier; ``first`` ahead of the series."""

    def __init__(self, rows: int = 1, first: float = float("nan")) -> None:
        super().__init__(*[first] * rows)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        joined = np.r_[self.values, values]
        self.values = joined[len(values):]
        return joined[: len(values)]


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def smoothed_range(span: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Average true range; the first bar has no previous close and counts high - low."""
    previous, smooth = Lag(), Smoother(span_alpha(span))

    def step(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
        before = previous(close)
        return smooth(np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before))))

    step.parts = (previous, smooth)
    return step


def strength_index(span: int) -> Callable[[np.ndarray], np.ndarray]:
    """RSI by 1/span smoothing; missing on the first bar, 0 for a flat series."""
    previous, gains, losses = Lag(), Smoother(1.0 / span), Smoother(1.0 / span)

    def step(close: np.ndarray) -> np.ndarray:
        change = close - previous(close)
        gain = gains(np.where(np.isnan(change), np.nan, np.maximum(change, 0.0)))
        loss = losses(np.where(np.isnan(change), np.nan, np.maximum(-change, 0.0)))
        return 100 - 100 / (1 + gain / (loss + EPSILON))

    step.parts = (previous, gains, losses)
    return step


def spread() -> Callable[[np.ndarray], np.ndarray]:
    """Fast against slow average, around 100."""
    fast, slow = Smoother(span_alpha(FAST_SPAN)), Smoother(span_alpha(SLOW_SPAN))

    def step(x: np.ndarray) -> np.ndarray:
        base = slow(x)
        return 100 + (fast(x) - base) / base * 100

    step.parts = (fast, slow)
    return step


def band_multiplier() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Range relative to the base line, scaled by its own 50-bar extent to [1, 5]."""
    tail = Memory()

    def step(atr: np.ndarray, base: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            rel = pd.Series(np.r_[tail.values, pd.Series(atr / base).fillna(0)])
            low, high = rel.rolling(BAND_FRAME).min(), rel.rolling(BAND_FRAME).max()
            scaled = MIN_MULT + (MAX_MULT - MIN_MULT) * (rel - low) / (high - low + EPSILON)
        begin, tail.values = len(tail.values), rel.to_numpy()[-(BAND_FRAME - 1):]
        return scaled.clip(MIN_MULT, MAX_MULT).to_numpy()[begin:]

    step.parts = (tail,)
    return step


def ratchet(side: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Band that only tightens while the previous close stays on its side of it; 1 for the lower band, -1 for the upper one."""
    last = Memory(float("nan"), float("nan"))

    def step(raw: np.ndarray, close: np.ndarray) -> np.ndarray:
        held, edge = last.values.tolist()
        band = raw.tolist()
        for i, (level, now) in enumerate(zip(band, close.tolist(), strict=True)):
            if side * edge > side * held and not side * level > side * held and level == level:
                band[i] = held
            held, edge = band[i], now
        last.values = np.array([held, edge])
        return np.array(band)

    step.parts = (last,)
    return step


def trend_fold() -> Step:
    """RSI, ATR, base line, bands and trend (1 or -1); ``trend_prev`` is 0 on the first bar of the series."""
    ranges, index, base_of, mult_of = smoothed_range(ATR_SPAN), strength_index(RSI_SPAN), Smoother(span_alpha(BASE_SPAN)), band_multiplier()
    lower, upper, up_before, dn_before = ratchet(1), ratchet(-1), Lag(), Lag()
    trend_before, trend_now = Lag(first=0.0), Memory(0.0)

    def step(cols: Columns) -> Columns:
        high, low, close = (np.asarray(cols[c], dtype="float64") for c in ("high", "low", "close"))
        atr, base = ranges(high, low, close), base_of(close)
        mult = mult_of(atr, base)
        middle = (high + low) / 2
        up, dn = lower(middle - mult * atr, close), upper(middle + mult * atr, close)
        flips = np.where(close > dn_before(dn), 1.0, np.where(close < up_before(up), -1.0, 0.0))
        if trend_now.values[0] == 0:
            flips[0] = 1.0
        last_flip = np.maximum.accumulate(np.where(flips != 0, np.arange(len(close)), -1))
        trend = np.where(last_flip >= 0, flips[np.maximum(last_flip, 0)], trend_now.values[0])
        trend_now.values = trend[-1:]
        return {"rsi": index(close), "atr": atr, "ema55": base, "mult": mult, "band_up": up, "band_dn": dn,
                "trend": trend, "trend_prev": trend_before(trend)}

    step.parts = (*ranges.parts, *index.parts, base_of, *mult_of.parts, *lower.parts, *upper.parts, up_before, dn_before, trend_before, trend_now)
    return step


def rotation_fold() -> Step:
    """Relative-strength ratio and momentum around 100 with earlier values, and EMA50."""
    ratio_of, mom_of, base_of = spread(), spread(), Smoother(span_alpha(50))
    ratio_before, mom_before, mom_earlier = Lag(), Lag(), Lag(4)

    def step(cols: Columns) -> Columns:
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = ratio_of(100 * cols["close"] / cols["bench_close"])
            mom = mom_of(ratio)
        return {"ratio": ratio, "mom": mom, "ratio_prev": ratio_before(ratio), "mom_prev": mom_before(mom),
                "mom_lag4": mom_earlier(mom), "ema50": base_of(cols["close"])}

    step.parts = (*ratio_of.parts, *mom_of.parts, base_of, ratio_before, mom_before, mom_earlier)
    return step


TREND_FIELDS = {"rsi": T.DoubleType(), "atr": T.DoubleType(), "ema55": T.DoubleType(),
                "mult": T.DoubleType(), "band_up": T.DoubleType(), "band_dn": T.DoubleType(),
                "trend": T.IntegerType(), "trend_prev": T.IntegerType()}

TREND_CORE = ("rsi", "trend", "trend_prev")

ROTATION_FIELDS = {"ratio": T.DoubleType(), "mom": T.DoubleType(), "ratio_prev": T.DoubleType(),
                   "mom_prev": T.DoubleType(), "mom_lag4": T.DoubleType(), "ema50": T.DoubleType()}


def with_rotation(frame: DataFrame, layout: Layout = WHOLE, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ratio, momentum, their previous values and EMA50 to arranged, benchmark-aligned rows."""
    return per_series(frame, key, ["close", "bench_close"], ROTATION_FIELDS, rotation_fold, layout.block_rows)


def with_trend(frame: DataFrame, layout: Layout = WHOLE, key: Sequence[str] = ("symbol",),
               detail: bool = True) -> DataFrame:
    """Add RSI and trend to arranged rows, with ``detail`` also ATR, base line and bands."""
    fields = {n: f for n, f in TREND_FIELDS.items() if detail or n in TREND_CORE}
    return per_series(frame, key, ["high", "low", "close"], fields, trend_fold, layout.block_rows)


def with_smoothing(frame: DataFrame, columns: Mapping[str, tuple[str, float]], layout: Layout = WHOLE,
                   key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add exponential smoothings: ``{output: (input column, alpha)}``."""
    def fold() -> Step:
        smoothers = {out: Smoother(alpha) for out, (_, alpha) in columns.items()}
        return lambda cols: {out: smoothers[out](cols[src]) for out, (src, _) in columns.items()}

    inputs = sorted({src for src, _ in columns.values()})
    return per_series(frame, key, inputs, {n: T.DoubleType() for n in columns}, fold, layout.block_rows)
