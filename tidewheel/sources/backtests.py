"""Stored states of backtests, which follow a table of bars: unchanged series take their new bars only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.frames import align, as_bench
from tidewheel.operators.increment import STATE, Backtest, advance, follow
from tidewheel.sources.versions import Manifest, PartTable

PART = "part"


@dataclass(frozen=True)
class BacktestStore:
    """One state for each symbol under ``path``, dealt by hash over ``parts``; a change rewrites the parts of its symbols, whole or not at all.

    With a ``benchmark``, bars are aligned with those of that symbol.
    """

    spark: SparkSession
    path: str
    test: Backtest
    benchmark: str | None = None
    parts: int = 64

    def table(self) -> PartTable:
        return PartTable(self.spark, self.path, STATE, PART)

    def states(self) -> DataFrame:
        return self.table().read().drop(PART)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("symbol"), F.lit(self.parts)).cast("string")

    def _commit(self, symbols: DataFrame, change: Callable[[DataFrame], DataFrame], source: str, batch: int | None) -> Manifest:
        """Replace the states of ``symbols`` by what ``change`` makes of them."""
        touched = [r[0] for r in symbols.select(self._part()).distinct().collect()]  # at most as many as there are parts
        if not touched:
            return self.table().manifest()
        held = self.table().read().filter(F.col(PART).isin(touched)).drop(PART)
        changed = symbols.select(F.col("symbol").alias("_symbol")).distinct()
        own = F.col("symbol").eqNullSafe(F.col("_symbol"))
        states = change(held.join(changed, own, "left_semi")).unionByName(held.join(changed, own, "left_anti"))
        return self.table().commit(states.withColumn(PART, self._part()).repartition(PART), source, batch)

    def append(self, bars: DataFrame, source: str = "", batch: int | None = None) -> Manifest:
        """Take new bars, with those of the benchmark at their times among them; bars up to a state's last one are passed over."""
        own = self._own(bars, bars)
        return self._commit(own.select("symbol"), lambda states: advance(states, own, self.test), source, batch)

    def refresh(self, bars: DataFrame, symbols: DataFrame, source: str = "", batch: int | None = None) -> Manifest:
        """Follow the whole histories of ``symbols`` in ``bars``; all series where the benchmark is among them."""
        if self.benchmark is not None and not symbols.filter(F.col("symbol") == self.benchmark).isEmpty():
            symbols = bars.select("symbol").unionByName(symbols.select("symbol"))
        named = symbols.select(F.col("symbol").alias("_symbol")).distinct()
        wanted = bars.join(named, F.col("symbol").eqNullSafe(F.col("_symbol")), "left_semi")
        own = self._own(wanted, bars)
        return self._commit(symbols.select("symbol"), lambda states: follow(states, own, self.test), source, batch)

    def _own(self, bars: DataFrame, all_bars: DataFrame) -> DataFrame:
        return bars if self.benchmark is None else align(bars, as_bench(all_bars, self.benchmark))
