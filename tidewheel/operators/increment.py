"""Backtests that go on from what they know: one row of state for each series, and a new bar costs one step.

A state holds the exact numbers of the recurrence, the closes and entries whose forward returns are still open, and the sums of those that are
known. Sums are taken bar by bar in order, so states are the same to the last bit however the bars came: one at a time, in any
portions, or all at once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.labels import RSI_THRESHOLD
from tidewheel.functions.numbers import pct_change, round_to
from tidewheel.operators.backtest import MIN_ENTRIES, MIN_TRANSITION_BARS, days_between
from tidewheel.operators.frames import HORIZONS, MIN_BARS
from tidewheel.operators.recurrences import Columns, Step, kept, resume, rotation_fold, trend_fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LONGS, _DOUBLES = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
#: ``n_obs``, ``hits`` and ``sums`` have one number for each horizon; ``digest`` tells whether bars that are in have changed since.
_FIELDS = T.StructType([T.StructField(name, kind) for name, kind in {
    "symbol": T.StringType(), "last_dt": T.TimestampType(), "n_bars": T.LongType(), "digest": T.LongType(), "last_close": T.DoubleType(),
    "active": T.BooleanType(), "n_entries": T.LongType(), "entry_dt": T.TimestampType(), "entry_close": T.DoubleType(),
    "n_obs": _LONGS, "hits": _LONGS, "sums": _DOUBLES, "open_close": _DOUBLES, "open_entry": T.ArrayType(T.BooleanType()),
    "fold": T.ArrayType(_DOUBLES)}.items()])
STATE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _FIELDS.fields)
_OPEN = max(HORIZONS)


@dataclass(frozen=True)
class Backtest:
    """``inputs`` of the recurrence, and of its results where an entry is and where the state that it begins holds on."""

    inputs: tuple[str, ...]
    fold: Callable[[], Step]
    entries: Callable[[Columns], tuple[np.ndarray, np.ndarray]]


def _signals(cols: Columns) -> tuple[np.ndarray, np.ndarray]:
    up = cols["trend"] == 1
    return up & (cols["trend_prev"] != 1) & (cols["rsi"] > RSI_THRESHOLD), up


def _leading(ratio: np.ndarray, mom: np.ndarray) -> np.ndarray:
    return (ratio >= 100) & (mom >= 100) & np.isfinite(ratio) & np.isfinite(mom)


def _transitions(cols: Columns) -> tuple[np.ndarray, np.ndarray]:
    now = _leading(cols["ratio"], cols["mom"])
    return now & ~_leading(cols["ratio_prev"], cols["mom_prev"]), now


#: Trend flips to 1 with RSI above its threshold, over a symbol's own bars.
SIGNALS = Backtest(("high", "low", "close"), trend_fold, _signals)
#: Entries into Leading, over bars that are aligned with a benchmark.
TRANSITIONS = Backtest(("close", "bench_close"), rotation_fold, _transitions)


def _empty_state() -> dict:
    none = len(HORIZONS)
    return {"last_us": None, "n_bars": 0, "digest": 0, "last_close": None, "active": False, "n_entries": 0, "entry_us": None,
            "entry_close": None, "n_obs": [0] * none, "hits": [0] * none, "sums": [0.0] * none,
            "open_close": [], "open_entry": [], "fold": None}


def _number(value: float) -> float | None:
    return None if np.isnan(value) else float(value)


def _count_returns(state: dict, close: np.ndarray, entry: np.ndarray) -> None:
    """Add the forward returns that the closes of a block settle."""
    before = len(state["open_close"])
    close, entry = np.r_[state["open_close"], close], np.r_[np.array(state["open_entry"], dtype=bool), entry]
    for k, h in enumerate(HORIZONS):
        first = max(before - h, 0)
        base, later = close[first: len(close) - h], close[first + h:]
        if not len(later):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(base != 0, (later / base - 1) * 100, np.nan)
        gain = gain[entry[first: len(close) - h] & ~np.isnan(gain)]
        state["n_obs"][k] += len(gain)
        state["hits"][k] += int((gain > 0).sum())
        state["sums"][k] = float(np.add.accumulate(np.r_[state["sums"][k], gain])[-1])
    state["open_close"], state["open_entry"] = close[-_OPEN:].tolist(), entry[-_OPEN:].tolist()


def _take(state: dict, test: Backtest, step: Step, block: pa.RecordBatch) -> None:
    """One step over a block of bars in order."""
    cols = {c: block.column(c).to_numpy(zero_copy_only=False).astype("float64") for c in test.inputs}
    times, close = block.column("us").to_numpy(), cols["close"]
    if (np.diff(times) < 1).any() or (state["last_us"] is not None and times[0] <= state["last_us"]):
        raise ValueError("the bars of a series are out of order, or there are two of one time")
    entry, active = test.entries(step(cols))
    _count_returns(state, close, entry)
    where = np.flatnonzero(entry)
    if len(where):
        state["entry_us"], state["entry_close"] = int(times[where[-1]]), _number(close[where[-1]])
    state["n_entries"] += len(where)
    state["n_bars"] += len(times)
    state["digest"] ^= int(np.bitwise_xor.reduce(block.column("hash").to_numpy()))
    state["last_us"], state["last_close"], state["active"] = int(times[-1]), _number(close[-1]), bool(active[-1])


def _bars(bars: DataFrame, test: Backtest) -> DataFrame:
    """Symbol, time in microseconds, inputs and a hash of each bar that has a time."""
    typed = bars.select("symbol", F.unix_micros(F.col("dt").cast("timestamp")).alias("us"), *[F.col(c).cast("double").alias(c) for c in test.inputs])
    return typed.filter(F.col("us").isNotNull()).withColumn("hash", F.xxhash64("us", *test.inputs))


def no_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _FIELDS)


def advance(states: DataFrame, bars: DataFrame, test: Backtest) -> DataFrame:
    """States after the bars later than each series' last one; bars up to it are passed over, so a portion that comes again changes nothing.

    Bars have ``symbol``, a ``dt`` that is unique in its series, and the inputs of the test; those without a time are left out. A series
    is taken batch by batch, so memory is one batch's. Series without a state begin one, and states without new bars stay.
    """
    return _advance(states, _bars(bars, test), test)


def _advance(states: DataFrame, new: DataFrame, test: Backtest) -> DataFrame:
    micros = {"last_us": "last_dt", "entry_us": "entry_dt"}
    inner = [f.name for f in _FIELDS.fields if f.name not in ("symbol", "last_dt", "entry_dt")]
    known = states.select("symbol", F.struct(*[F.unix_micros(dt).alias(us) for us, dt in micros.items()], *inner).alias("state"))
    rows = known.unionByName(new, allowMissingColumns=True)
    # A series' state comes first, as it has no time, then its bars in order.
    dealt = rows.repartition("symbol").sortWithinPartitions(F.col("symbol").asc(), F.col("us").asc_nulls_first())
    schema = T.StructType([T.StructField("symbol", T.StringType()), *known.schema["state"].dataType.fields])
    arrow = pa.schema([pa.field("symbol", pa.string()), *[pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, step, symbol, resumed = _empty_state(), test.fold(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            symbol = batch.column("symbol")[0].as_py()
            if batch.column("state")[0].is_valid:
                state, batch = batch.column("state")[0].as_py(), batch.slice(1)
                resumed = state["last_us"]
                resume(step, state["fold"])
            if resumed is not None:
                batch = batch.filter(pc.greater(batch.column("us"), resumed))
            if batch.num_rows:
                _take(state, test, step, batch)
        state["fold"] = kept(step)
        yield pa.RecordBatch.from_pylist([{"symbol": symbol, **state}], arrow)

    folded = dealt.groupBy("symbol").applyInArrow(run, schema)
    for us, dt in micros.items():
        folded = folded.withColumn(dt, F.timestamp_micros(us))
    return folded.select(*_FIELDS.names)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}[kind]


def unchanged(states: DataFrame, bars: DataFrame, test: Backtest) -> DataFrame:
    """The states whose bars are all still among ``bars`` as they were, and no other ones up to their last; by one aggregation of hashes."""
    return _unchanged(states, _bars(bars, test))


def _known_to(states: DataFrame) -> DataFrame:
    return states.select(F.col("symbol").alias("_symbol"), F.unix_micros("last_dt").alias("_last"))


def _unchanged(states: DataFrame, bars: DataFrame) -> DataFrame:
    own = F.col("symbol").eqNullSafe(F.col("_symbol"))
    so_far = bars.join(_known_to(states), own & (F.col("us") <= F.col("_last")))
    found = so_far.groupBy("_symbol").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("hash").alias("_digest"))
    return states.join(found, own & (F.col("n_bars") == F.col("_n")) & (F.col("digest") == F.col("_digest")), "left_semi")


def follow(states: DataFrame, histories: DataFrame, test: Backtest) -> DataFrame:
    """States of the series of ``histories``, which has all their bars: a series whose known bars are as they were takes its new ones
    only, and one whose past was rewritten begins anew. Series without bars have no state."""
    bars = _bars(histories, test)
    same = _unchanged(states, bars)
    later = bars.join(_known_to(same), F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
    return _advance(same, later.filter(F.col("_last").isNull() | (F.col("us") > F.col("_last"))).drop("_symbol", "_last"), test)


def _statistics() -> list[Column]:
    out = []
    for k, h in enumerate(HORIZONS):
        seen, hits, total = (F.col(c)[k] for c in ("n_obs", "hits", "sums"))
        out += [round_to(F.try_divide(hits * 100.0, seen), 1).alias(f"hit_{h}d"), round_to(F.try_divide(total, seen), 2).alias(f"avg_{h}d"),
                F.when(seen > 0, seen).alias(f"n_obs_{h}d")]
    return out


def _report(states: DataFrame, enough: Column, **columns: Column) -> DataFrame:
    age = F.when(F.col("active"), days_between(F.col("last_dt"), F.col("entry_dt")))
    made = states.filter(F.col("n_bars") >= MIN_BARS).select(
        "symbol", enough.alias("_enough"), "n_entries", *_statistics(), age.alias("_age"), *[c.alias(n) for n, c in columns.items()])
    return made.select("symbol", *[F.when(F.col("_enough"), F.col(c)).alias(c) for c in made.columns if c not in ("symbol", "_enough")])


def signal_report(states: DataFrame) -> DataFrame:
    """The signal backtest of each series of at least 200 bars, with fewer than three entries without figures."""
    moved = F.when(F.col("active"), round_to(pct_change(F.col("last_close"), F.col("entry_close")), 2))
    return _report(states, F.col("n_entries") >= MIN_ENTRIES, current_ret=moved).withColumnsRenamed({"n_entries": "n_signals", "_age": "days_active"})


def transition_report(states: DataFrame) -> DataFrame:
    """The quadrant-transition backtest of each series of at least 200 aligned bars, with fewer than 300 bars or three entries without figures."""
    enough = (F.col("n_entries") >= MIN_ENTRIES) & (F.col("n_bars") >= MIN_TRANSITION_BARS)
    return _report(states, enough).withColumnsRenamed({"_age": "days_in_leading"})
