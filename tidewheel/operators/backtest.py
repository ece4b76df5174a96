"""Entries, forward-return statistics and last-bar snapshots: one aggregation per series.

Every function returns aggregate columns, so a caller asks for all of them in a
single ``groupBy(...).agg(...)``, which combines on the map side. All buffers are
numbers, dates or booleans: Spark then aggregates by hash and need not sort the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.labels import RSI_THRESHOLD
from tidewheel.functions.numbers import finite, pct_change, round_to
from tidewheel.operators.frames import HORIZONS

MIN_ENTRIES = 3
MIN_TRANSITION_BARS = 300
TRAIL_OFFSETS = (40, 35, 30, 25, 20, 15, 10, 5)


def is_last() -> Column:
    return F.col("pos") == F.col("n_bars") - 1


def at_last(value: Column) -> Column:
    """Value on the last bar of the series."""
    return F.max(F.when(is_last(), value))


def leading_entry(skip_seed: bool = False) -> Column:
    """Into Leading now; the first bar has no quadrant before it and counts as an entry."""
    entered = (F.col("quad") == "Leading") & (F.coalesce(F.col("quad_prev"), F.lit("")) != "Leading")
    return entered & (F.col("pos") > 0) if skip_seed else entered


def signal_entry() -> Column:
    """Trend flips to 1 with RSI above its threshold."""
    return ((F.col("trend") == 1) & (F.col("trend_prev") != 1)
            & F.coalesce(F.col("rsi") > RSI_THRESHOLD, F.lit(False)))


def is_buy() -> Column:
    return (F.col("trend") == 1) & F.coalesce(F.col("rsi") > RSI_THRESHOLD, F.lit(False))


def forward_stats(entry: Column, horizons: Sequence[int] = HORIZONS) -> list[Column]:
    """Hit rate, mean and number of forward returns per horizon over the entries."""
    out = []
    for h in horizons:
        gain = F.when(entry, F.col(f"fwd_{h}"))
        seen = F.count(gain)
        hits = F.count(F.when(gain > 0, 1))
        out += [
            round_to(F.try_divide(hits * 100.0, seen), 1).alias(f"hit_{h}d"),
            round_to(F.avg(gain), 2).alias(f"avg_{h}d"),
            F.when(seen > 0, seen).alias(f"n_obs_{h}d"),
        ]
    return out


def stat_names(horizons: Sequence[int] = HORIZONS) -> list[str]:
    return [f"{kind}_{h}d" for h in horizons for kind in ("hit", "avg", "n_obs")]


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def run_age(entry: Column, active: Column) -> Column:
    """Calendar days from the last entry to the last bar, if the state is still active."""
    started = F.max(F.when(entry, F.col("dt")))
    return F.when(at_last(active), days_between(F.max("dt"), started))


def move_since(entry: Column, active: Column) -> Column:
    """Percent change from the close of the last entry to the last close, if still active."""
    base = F.max_by(F.col("close"), F.when(entry, F.col("pos")))
    return F.when(at_last(active), round_to(pct_change(at_last(F.col("close")), base), 2))


def annual_volatility() -> Column:
    return F.stddev_samp("ret") * F.sqrt(F.lit(252.0)) * 100


def year_return() -> Column:
    return round_to(pct_change(at_last(F.col("close")), at_last(F.col("close_year_ago"))), 1)


def volume_over_mean(times: float) -> Column:
    return F.coalesce(F.col("volume") > F.col("vol_mean20") * times, F.lit(False))


def factor_flags() -> dict[str, Column]:
    """The four confirmations on the last bar; a missing operand is False."""
    mom, mom_ago = finite(F.col("mom")), finite(F.col("mom_lag4"))
    tests = {
        "f_price": F.col("close") > F.col("ema50"),
        "f_volume": volume_over_mean(1.3),
        "f_roc": F.col("roc10") > F.col("roc10_ago2"),
        "f_mom": (mom > 100) & (mom > mom_ago),
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}


def trail_values() -> list[Column]:
    """Ratio and momentum of every 5th bar of the last 40, then of the last bar."""
    back = F.col("n_bars") - F.col("pos")
    return [F.max(F.when(back == k, finite(F.col(c)))).alias(f"_{c}_{k}")
            for k in (*TRAIL_OFFSETS, 1) for c in ("ratio", "mom")]


def trail() -> Column:
    """The points of ``trail_values`` the series is long enough for, oldest first."""
    points = [
        F.when(F.col("n_bars") >= k, F.struct(round_to(F.col(f"_ratio_{k}"), 3).alias("ratio"),
                                              round_to(F.col(f"_mom_{k}"), 3).alias("mom")))
        for k in (*TRAIL_OFFSETS, 1)
    ]
    return F.array_compact(F.array(*points))
