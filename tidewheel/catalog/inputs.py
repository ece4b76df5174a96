"""Inputs of the registered queries, built from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.frames import MIN_BARS, as_bench, rotation_frame, trend_frame
from tidewheel.operators.layout import WHOLE
from tidewheel.plans import lookup, rotation
from tidewheel.session import new_path
from tidewheel.sources import tables as t
from tidewheel.sources.store import BarStore

BENCH = t.BENCHMARK

# Dictionary for the invented prose of the driver tables, in place of the default one.
EVENT_WORDS = [
    ("Closure", "UP", "red", ["thtion", "tionen", "enheit", "queque"]),
    ("Strike", "UP", "orange", ["ontion", "ciónas", "erkeit", "oument"]),
    ("Conflict", "?", "purple", ["retion", "ciónado", "enlich", "aiment"]),
    ("New Supply", "DOWN", "lime", ["antion", "onbleea", "asción", "ciónco"]),
]
METAL_WORDS = [
    ("Africa", ["thanea", "ciónue"]),
    ("America", ["eriner", "ciónos"]),
    ("Asia", ["ertion", "einlich"]),
    ("Europe", ["attion", "de la"]),
    ("Middle East", ["estion", "ention"]),
    ("Timber", ["queque"]),
]
LIST_LINK = ["li"]
PAGE_BASE = "https://pages.example"
PAGE_SOURCE = "Pages"
MIN_LINK = 2


def day(column: str = "dt") -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def stamp(column: str = "dt") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm").alias(column)


_STORED: dict[tuple[str, str], BarStore] = {}


def bar_store(spark: SparkSession, folder: str) -> BarStore:
    """Daily bars built and stored by month once for an application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        _STORED[key] = BarStore(spark, new_path(spark, "bars")).write(t.order_bars(spark, folder))
    return _STORED[key]


def stored_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The bars of the store, for queries that read them in several places."""
    return bar_store(spark, folder).bars()


def own(spark: SparkSession, folder: str, min_bars: int = MIN_BARS) -> DataFrame:
    """Daily bars are unique per (symbol, day): one task per series is enough."""
    return trend_frame(t.order_bars(spark, folder), WHOLE, min_bars=min_bars)


def aligned(spark: SparkSession, folder: str, min_bars: int = MIN_BARS) -> DataFrame:
    bars = stored_bars(spark, folder)
    return rotation_frame(bars, as_bench(bars, BENCH), WHOLE, min_bars=min_bars)


def sector_table(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    bars = stored_bars(spark, folder) if bars is None else bars
    return rotation.sector_rotation(bars, t.sector_dim(spark, folder), BENCH, WHOLE)


def drilldown(spark: SparkSession, folder: str, min_score: int = 6) -> tuple[DataFrame, DataFrame]:
    """(sector table, drill-down), each kept when it is first computed; nothing runs while a query is built but the store of bars."""
    bars = stored_bars(spark, folder)
    sectors = sector_table(spark, folder, bars).persist()
    drill = rotation.stock_drilldown(
        bars, t.universe_dim(spark, folder), rotation.rotating(sectors, min_score), t.name_dim(spark, folder),
        BENCH, WHOLE)
    # The finished table is small and read in several places: its folds run once, or again where an executor is lost.
    return sectors, drill.persist()


def lookup_table(spark: SparkSession, folder: str, sectors: DataFrame) -> DataFrame:
    status = lookup.member_status(t.universe_dim(spark, folder), t.sector_dim(spark, folder), sectors,
                                  t.name_dim(spark, folder))
    return lookup.stock_lookup(status)
