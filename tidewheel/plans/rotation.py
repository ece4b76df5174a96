"""Sector rotation and member drill-down tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import labels
from tidewheel.functions.numbers import finite, round_to
from tidewheel.operators import backtest as bt
from tidewheel.operators.frames import as_bench, rotation_frame, trend_frame
from tidewheel.operators.layout import WHOLE, Layout

MIN_SECTOR_PAIR_BARS = 201
TREND_NAME = labels.TREND_NAME


def trend_summary(bars: DataFrame, layout: Layout = WHOLE) -> DataFrame:
    """One row per symbol from its own bars: signal, surge, volatility, 1Y return, signal backtest."""
    entry, active = bt.signal_entry(), F.col("trend") == 1
    stats = trend_frame(bars, layout, detail=False).groupBy("symbol").agg(
        bt.at_last(bt.is_buy()).alias("buy"),
        bt.at_last(bt.volume_over_mean(1.5)).alias("vol_surge"),
        bt.annual_volatility().alias("ann_vol_raw"),
        bt.year_return().alias("ret_1y"),
        F.count(F.when(entry, 1)).alias("n_entries"),
        *bt.forward_stats(entry),
        bt.run_age(entry, active).alias("days_active"),
        bt.move_since(entry, active).alias("current_ret"),
    )
    enough = F.col("n_entries") >= bt.MIN_ENTRIES
    return stats.select(
        "symbol",
        F.when(F.col("buy"), "BUY").otherwise("FLAT").alias("signal"),
        "vol_surge",
        "ret_1y",
        labels.volatility_bucket(F.col("ann_vol_raw")).alias("vol_bucket"),
        round_to(F.col("ann_vol_raw"), 1).alias("ann_vol"),
        F.when(enough, F.col("n_entries")).alias("n_signals"),
        *[F.when(enough, F.col(c)).alias(c) for c in [*bt.stat_names(), "days_active", "current_ret"]],
    )


def last_rotation() -> list[Column]:
    """Last-bar ratio, momentum and factor flags as aggregates."""
    return [
        bt.at_last(finite(F.col("ratio"))).alias("last_ratio"),
        bt.at_last(finite(F.col("mom"))).alias("last_mom"),
        *[bt.at_last(test).alias(name) for name, test in bt.factor_flags().items()],
    ]


def rotation_columns() -> list[Column]:
    """Labels and counts over the aggregates of ``last_rotation``."""
    flags = [F.col(name) for name in bt.factor_flags()]
    n_sigs = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    ratio, mom = F.col("last_ratio"), F.col("last_mom")
    return [
        labels.quadrant(ratio, mom).alias("quad"), round_to(ratio, 3).alias("rs_ratio"),
        round_to(mom, 3).alias("rs_mom"), *flags, n_sigs.alias("n_sigs"),
        labels.confirm_level(n_sigs).alias("level"),
    ]


def rotation_summary(bars: DataFrame, bench: DataFrame, layout: Layout = WHOLE) -> DataFrame:
    """One row per symbol from benchmark-aligned bars: quadrant, factors, transition backtest, trail."""
    entry, active = bt.leading_entry(), F.col("quad") == "Leading"
    stats = rotation_frame(bars, bench, layout).groupBy("symbol").agg(
        *last_rotation(),
        F.max("n_bars").alias("n_bars"),
        F.count(F.when(entry, 1)).alias("n_entries"),
        *bt.forward_stats(entry),
        bt.run_age(entry, active).alias("days_in_leading"),
        *bt.trail_values(),
    )
    enough = (F.col("n_entries") >= bt.MIN_ENTRIES) & (F.col("n_bars") >= bt.MIN_TRANSITION_BARS)
    gated = ["n_entries", *bt.stat_names(), "days_in_leading"]
    return stats.select("symbol", *rotation_columns(), *[F.when(enough, F.col(c)).alias(c) for c in gated],
                        bt.trail().alias("trail"))


def factor_summary(bars: DataFrame, bench: DataFrame, layout: Layout = WHOLE) -> DataFrame:
    """Quadrant and factors only, for members that need no transition backtest."""
    stats = rotation_frame(bars, bench, layout, horizons=()).groupBy("symbol").agg(*last_rotation())
    return stats.select("symbol", *rotation_columns())


def sector_rotation(bars: DataFrame, sectors: DataFrame, benchmark: str, layout: Layout = WHOLE,
                    trend_name: str = TREND_NAME) -> DataFrame:
    """Scored sector table: ``sectors(etf, name, ord)`` against the benchmark, one row per sector."""
    members = bars.join(sectors.select(F.col("etf").alias("symbol")), "symbol", "left_semi")
    rotation = rotation_summary(members, as_bench(bars, benchmark), layout)
    trend = trend_summary(members, layout).select("symbol", "signal", "vol_surge", "ret_1y", "vol_bucket", "ann_vol")
    score = labels.sector_score(F.col("quad"), F.col("signal"), F.col("level"), F.col("n_sigs"))
    return (
        sectors.join(rotation.withColumnRenamed("symbol", "etf"), "etf")
        .join(trend.withColumnRenamed("symbol", "etf"), "etf")
        .withColumn("score", score)
        .withColumn("alert", labels.sector_alert(F.col("score")))
        .withColumn("reason", labels.reason(F.col("quad"), None, F.col("signal"), F.col("level"),
                                            F.col("n_sigs"), F.col("ret_1y"), benchmark, trend_name))
    )


def ranked_sectors(rotation: DataFrame) -> DataFrame:
    """Sectors by score, ties in dimension order."""
    return rotation.orderBy(F.desc("score"), "ord")


def rotating(rotation: DataFrame, min_score: int = labels.DRILL_SCORE) -> DataFrame:
    return rotation.filter(F.col("score") >= min_score)


def unique_members(universe: DataFrame) -> DataFrame:
    """One row per (etf, ticker), first position kept."""
    return universe.groupBy("etf", "ticker").agg(F.min("etf_ord").alias("etf_ord"), F.min("ord").alias("ord"))


def sector_pair_quadrant(bars: DataFrame, members: DataFrame, layout: Layout = WHOLE) -> DataFrame:
    """Last quadrant of every (etf, ticker) against its own sector, if they share > 200 dates."""
    stock = members.select("etf", "ticker").join(bars.withColumnRenamed("symbol", "ticker"), "ticker")
    # Only bars of the sectors can match: what is left of the table decides how it is joined.
    sector = bars.select(F.col("symbol").alias("etf"), "dt", F.col("close").alias("bench_close")).join(
        members.select("etf").distinct(), "etf", "left_semi")
    frame = rotation_frame(stock, sector, layout, key=("etf", "ticker"), on=("etf", "dt"),
                           min_bars=MIN_SECTOR_PAIR_BARS, horizons=())
    last = frame.groupBy("etf", "ticker").agg(
        bt.at_last(finite(F.col("ratio"))).alias("ratio"), bt.at_last(finite(F.col("mom"))).alias("mom"))
    return last.select("etf", "ticker", labels.quadrant(F.col("ratio"), F.col("mom")).alias("quad_sec"))


def stock_drilldown(bars: DataFrame, universe: DataFrame, rotating_sectors: DataFrame, names: DataFrame,
                    benchmark: str, layout: Layout = WHOLE, keep_duplicates: bool = False,
                    trend_name: str = TREND_NAME) -> DataFrame:
    """Scored members of the rotating sectors, one row per membership.

    Indicators run once per distinct ticker; the semi join on the rotating sectors
    comes before any recurrence.
    """
    chosen = universe.join(rotating_sectors.select("etf"), "etf", "left_semi")
    members = chosen if keep_duplicates else unique_members(chosen)
    wanted = members.select(F.col("ticker").alias("symbol")).distinct()
    stocks = bars.join(wanted, "symbol", "left_semi")
    factors = factor_summary(stocks, as_bench(bars, benchmark), layout)
    own = trend_summary(stocks, layout)
    pairs = sector_pair_quadrant(bars, unique_members(chosen), layout)
    per_ticker = factors.join(own, "symbol").withColumnsRenamed({"symbol": "ticker", "quad": "quad_spy"})
    score = labels.stock_score(F.col("quad_spy"), F.col("quad_sec"), F.col("signal"), F.col("level"), F.col("n_sigs"))
    return (
        members.join(per_ticker, "ticker")
        .join(pairs, ["etf", "ticker"], "left")
        .join(names, "ticker", "left")
        .withColumn("name", F.coalesce("name", F.lit("")))
        .withColumn("quad_sec", F.coalesce("quad_sec", F.lit("N/A")))
        .withColumn("score", score)
        .withColumn("rec", labels.stock_rec(F.col("score")))
        .withColumn("reason", labels.reason(F.col("quad_spy"), F.col("quad_sec"), F.col("signal"), F.col("level"),
                                            F.col("n_sigs"), F.col("ret_1y"), benchmark, trend_name))
    )


def ranked_stocks(drilldown: DataFrame) -> DataFrame:
    """Members list by list, by score inside a list, ties in list order; a range sort, no task per list."""
    return drilldown.orderBy("etf_ord", F.desc("score"), "ord")


def top_stocks(drilldown: DataFrame, sectors: DataFrame, count: int = 25) -> DataFrame:
    """Best members across sectors: score, then sector rank (score, order), then list order."""
    placed = drilldown.join(
        sectors.select("etf", F.col("score").alias("sector_score"), F.col("ord").alias("sector_ord")), "etf")
    return placed.orderBy(F.desc("score"), F.desc("sector_score"), "sector_ord", "ord").limit(count)
