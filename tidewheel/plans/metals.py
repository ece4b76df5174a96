"""Price board of metals and company board by metal group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.numbers import pct_from, round_to
from tidewheel.operators.layout import arrange

MIN_PRICES = 5
METAL_HORIZONS = {"ch1d": 1, "ch7d": 7, "ch1m": 21, "ch2m": 42}
COMPANY_HORIZONS = {"ch10d": 10, "ch20d": 20, "ch1m": 21, "ch2m": 42}


def price_changes(recent_bars: DataFrame, horizons: Mapping[str, int], last_name: str = "spot") -> DataFrame:
    """Last close and percent change against the close ``k`` bars back, clamped to the first bar.

    Months of daily bars per symbol; the bases are picked by one aggregation.
    """
    arranged = arrange(recent_bars).filter(F.col("n_bars") >= MIN_PRICES)

    def base(rows: int):
        wanted = F.greatest(F.lit(0), F.col("n_bars") - 1 - rows)
        return F.max(F.when(F.col("pos") == wanted, F.col("close")))

    stats = arranged.groupBy("symbol").agg(
        F.max_by("close", "pos").alias("last"), *[base(k).alias(f"_{name}") for name, k in horizons.items()])
    return stats.select("symbol", round_to(F.col("last"), 2).alias(last_name), *[
        round_to(pct_from(F.col("last"), F.col(f"_{name}")), 1).alias(name) for name in horizons])


def price_board(metals: DataFrame, recent_bars: DataFrame, drop_on_zero_base: bool = False) -> DataFrame:
    """Metals with prices, in declared order.

    A zero base gives a null change; ``drop_on_zero_base`` leaves the metal out
    when one of the two long bases is zero.
    """
    wanted = recent_bars.join(metals.select(F.col("ticker").alias("symbol")), "symbol", "left_semi")
    changes = price_changes(wanted, METAL_HORIZONS).withColumnRenamed("symbol", "ticker")
    if drop_on_zero_base:
        changes = changes.dropna(subset=["ch1m", "ch2m"])
    return metals.join(changes, "ticker").orderBy("ord")


def company_board(companies: DataFrame, recent_bars: DataFrame) -> DataFrame:
    """Companies with prices by group and declared order; a ticker may be in several groups."""
    tickers = companies.select(F.col("ticker").alias("symbol")).distinct()
    wanted = recent_bars.join(tickers, "symbol", "left_semi")
    changes = price_changes(wanted, COMPANY_HORIZONS, "price").withColumnRenamed("symbol", "ticker")
    return companies.join(changes, "ticker").orderBy("group_ord", "ord")


def group_counts(board: DataFrame) -> DataFrame:
    """Companies per group and, with a null group, in total."""
    return board.rollup("group").agg(F.count(F.lit(1)).alias("n"))
