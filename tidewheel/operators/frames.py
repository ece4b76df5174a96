"""Window columns over arranged bars, and the two indicator frames built on them.

A frame needs one shuffle: windows, gate and recurrence share the clustering by
series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.labels import quadrant
from tidewheel.functions.numbers import pct_change
from tidewheel.operators.layout import WHOLE, Layout, arrange, rolling, series_window
from tidewheel.operators.recurrences import with_rotation, with_trend

HORIZONS = (5, 10, 20, 30)
MIN_BARS = 200
YEAR_BARS = 252
VOLUME_FRAME = 20


def align(bars: DataFrame, bench: DataFrame, on: Sequence[str] = ("dt",)) -> DataFrame:
    """Keep the dates both sides have; ``bench`` brings ``bench_close``."""
    return bars.join(bench, list(on), "inner")


def as_bench(bars: DataFrame, symbol: str) -> DataFrame:
    return bars.filter(F.col("symbol") == symbol).select("dt", F.col("close").alias("bench_close"))


def forward_returns(window, horizons: Sequence[int] = HORIZONS) -> dict[str, Column]:
    """Percent return ``h`` bars ahead, null past the end of the series."""
    return {f"fwd_{h}": pct_change(F.lead("close", h).over(window), F.col("close")) for h in horizons}


def own_columns(window) -> dict[str, Column]:
    """Columns a series needs of its own bars besides the trend."""
    before = F.lag("close", 1).over(window)
    return {
        "ret": F.try_divide(F.col("close"), before) - 1,
        "vol_mean20": rolling(F.avg("volume"), VOLUME_FRAME, window, F.col("volume")),
        "close_year_ago": F.lag("close", YEAR_BARS - 1).over(window),
        **forward_returns(window),
    }


def aligned_columns(window, horizons: Sequence[int] = HORIZONS) -> dict[str, Column]:
    """Columns a benchmark-aligned series needs besides the rotation."""
    def close_ago(rows: int) -> Column:
        return F.lag("close", rows).over(window)

    return {
        "vol_mean20": rolling(F.avg("volume"), VOLUME_FRAME, window, F.col("volume")),
        "roc10": pct_change(F.col("close"), close_ago(10)),
        "roc10_ago2": pct_change(close_ago(2), close_ago(12)),
        **forward_returns(window, horizons),
    }


def trend_frame(bars: DataFrame, layout: Layout = WHOLE, key: Sequence[str] = ("symbol",),
                min_bars: int = MIN_BARS, detail: bool = True) -> DataFrame:
    """Own-bar frame: returns, forward returns, RSI, trend; with ``detail`` also bands and inputs.

    The gate stands between the windows and the recurrence, and only needed columns
    go through Arrow.
    """
    needed = bars.drop("open")
    framed = arrange(needed, key).withColumns(own_columns(series_window(key)))
    return with_trend(framed.filter(F.col("n_bars") >= min_bars), layout, key, detail)


def rotation_frame(bars: DataFrame, bench: DataFrame, layout: Layout = WHOLE,
                   key: Sequence[str] = ("symbol",), on: Sequence[str] = ("dt",),
                   min_bars: int = MIN_BARS, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Benchmark-aligned frame: forward returns, factors' inputs, ratio, momentum, quadrant."""
    arranged = arrange(align(bars.drop("open", "high", "low"), bench, on), key)
    framed = arranged.withColumns(aligned_columns(series_window(key), horizons))
    rotated = with_rotation(framed.filter(F.col("n_bars") >= min_bars), layout, key)
    return rotated.withColumns({
        "quad": quadrant(F.col("ratio"), F.col("mom")),
        "quad_prev": F.when(F.col("pos") > 0, quadrant(F.col("ratio_prev"), F.col("mom_prev"))),
    })
