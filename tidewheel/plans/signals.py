"""Signal buckets, sector cards, counters and chart data over finished rotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.numbers import round_to

SHOWN = 8
TOP_BUYS = 4
PAD = 0.6


def actionable(drilldown: DataFrame) -> DataFrame:
    return drilldown.filter(~F.col("rec").contains("AVOID"))


def bucket_tests() -> dict[str, Column]:
    """Membership of the four buckets; a missing operand keeps a stock out."""
    days, cur, avg, hit = (F.col(c) for c in ("days_active", "current_ret", "avg_20d", "hit_20d"))
    return {
        "new": days <= 10,
        "room": (days <= 30) & (avg > 0.3) & (cur < avg * 0.4),
        "extended": (avg > 0) & (F.try_divide(cur, avg) > 1.2) & (cur > 5),
        "quality": (hit >= 65) & (avg >= 2.0),
    }


def bucket_order(day_zero_last: bool) -> Column:
    """Sort key inside a bucket, ascending."""
    days, cur, avg, hit = (F.col(c) for c in ("days_active", "current_ret", "avg_20d", "hit_20d"))
    age = F.when(days == 0, 999).otherwise(days) if day_zero_last else days
    return (
        F.when(F.col("bucket") == "new", age.cast("double"))
        .when(F.col("bucket") == "room", cur - avg)
        .when(F.col("bucket") == "extended", -cur)
        .otherwise(-hit * 10 - avg)
    )


def signal_buckets(drilldown: DataFrame, sectors: DataFrame, shown: int = SHOWN,
                   day_zero_last: bool = False) -> DataFrame:
    """First ``shown`` stocks of each bucket and the bucket's full size; a stock may be in several.

    Ties keep sector rank and stock rank. Sizes come from an aggregation and the top
    from a ranked window, which Spark limits in the map tasks.
    """
    labels = F.array_compact(F.array(*[F.when(test, name) for name, test in bucket_tests().items()]))
    places = sectors.select("etf", F.col("score").alias("_sector_score"), F.col("ord").alias("_sector_ord"))
    listed = actionable(drilldown).join(places, "etf").withColumn("bucket", F.explode(labels))
    listed = listed.withColumn("_key", bucket_order(day_zero_last))
    place = Window.partitionBy("bucket").orderBy("_key", F.desc("_sector_score"), "_sector_ord", F.desc("score"), "ord")
    sizes = listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("bucket_size"))
    top = listed.withColumn("bucket_rank", F.row_number().over(place)).filter(F.col("bucket_rank") <= shown)
    return top.join(sizes, "bucket").select(
        "bucket", "bucket_rank", "bucket_size", "ticker", "name", "etf", F.trim("rec").alias("rec"), "score",
        F.col("days_active").alias("days"), F.col("current_ret").alias("cur"), F.col("avg_20d").alias("avg"),
        F.col("hit_20d").alias("hit"))


def sector_cards(drilldown: DataFrame) -> DataFrame:
    """Buy and avoid counts, first buys, and mean 20-day statistics per sector.

    The first buys are picked by rank before they are collected, so a card holds
    at most four.
    """
    buy = F.col("rec").contains("BUY")
    place = Window.partitionBy("etf", buy).orderBy(F.desc("score"), "ord")
    first = (
        drilldown.filter(buy).withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= TOP_BUYS)
        .groupBy("etf").agg(F.array_sort(F.collect_list(F.struct("_n", "ticker"))).alias("_top"))
        .select("etf", F.transform("_top", lambda t: t["ticker"]).alias("top"))
    )
    counts = drilldown.groupBy("etf").agg(
        F.count(F.when(buy, 1)).alias("buys"),
        F.count(F.when(F.col("rec").contains("AVOID"), 1)).alias("avoids"),
        round_to(F.avg("hit_20d"), 1).alias("avg_hit"),
        round_to(F.avg("avg_20d"), 2).alias("avg_ret"),
    )
    return counts.join(first, "etf", "left")


def report_counters(rotation: DataFrame) -> DataFrame:
    moving = F.col("alert").contains("ROTATING")
    return rotation.agg(
        F.count(F.when(moving, 1)).alias("n_rotating"),
        F.count(F.when((F.col("quad") == "Improving") & ~moving, 1)).alias("n_improving"),
        F.count(F.when(F.col("quad") == "Weakening", 1)).alias("n_weakening"),
        F.count(F.when(F.col("quad") == "Lagging", 1)).alias("n_lagging"),
    )


def quadrant_groups(rotation: DataFrame) -> DataFrame:
    """Sectors' points per quadrant in score order; empty quadrants have no row."""
    point = F.struct((-F.col("score")).alias("_a"), F.col("ord").alias("_b"), F.col("rs_ratio").alias("x"),
                     F.col("rs_mom").alias("y"), F.col("etf").alias("label"))
    grouped = rotation.groupBy("quad").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return grouped.withColumn("points", F.transform("points", lambda p: F.struct(p["x"], p["y"], p["label"])))


def trail_extents(rotation: DataFrame) -> DataFrame:
    """Padded range of all trail points, at least 99 to 101."""
    points = rotation.select(F.explode("trail").alias("p"))
    x, y = F.col("p.ratio"), F.col("p.mom")
    return points.agg(
        F.least(F.min(x) - PAD, F.lit(99.0)).alias("x_min"), F.greatest(F.max(x) + PAD, F.lit(101.0)).alias("x_max"),
        F.least(F.min(y) - PAD, F.lit(99.0)).alias("y_min"), F.greatest(F.max(y) + PAD, F.lit(101.0)).alias("y_max"))
