"""Classified event feed and supply briefs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions import text

LATEST = 70
ALIASES = {"Steel (HRC)": "Steel"}
BRIEF_EVENTS = 4
BRIEF_CAUSES = 2


def latest_events(items: DataFrame, types: Sequence, metals: Sequence, places: Sequence[str],
                  count: int = LATEST) -> DataFrame:
    """Newest classified items; typed before General at equal time, then ingest order."""
    return newest(text.classify(items, types, metals, places), count)


def newest(events: DataFrame, count: int = LATEST) -> DataFrame:
    return events.orderBy(
        F.desc("pub_sort"), F.desc(F.col("etype") != text.NO_EVENT), "ingest_ord").limit(count)


def attach_attributes(events: DataFrame, types: DataFrame) -> DataFrame:
    """Pressure and colour by event type, with defaults for unknown types."""
    return events.join(types.select("etype", "pressure", "color"), "etype", "left").withColumns({
        "pressure": F.coalesce("pressure", F.lit(text.NO_PRESSURE)),
        "color": F.coalesce("color", F.lit(text.NO_COLOR)),
    })


def metal_events(metals: DataFrame, events: DataFrame) -> DataFrame:
    """One row per (metal, event) whose tags hold the metal's name or alias."""
    alias = F.col("name")
    for name, other in ALIASES.items():
        alias = F.when(F.col("name") == name, other).otherwise(alias)
    wanted = metals.select("name", F.explode(F.array_distinct(F.array("name", alias))).alias("tag"))
    tagged = events.withColumn("tag", F.explode(F.array_distinct("metals")))
    return tagged.join(wanted, "tag").drop("tag").dropDuplicates(["name", "ingest_ord"])


def supply_briefs(metals: DataFrame, events: DataFrame) -> DataFrame:
    """Event counts, sentiment and up to two causes from the first four events per metal.

    Counts combine on the map side and the first four are limited there, so a metal
    with most of the events is no hot spot. Both read the matched events, which are kept without
    their texts when they are first computed: events are classified once.
    """
    order = Window.partitionBy("name").orderBy(
        F.desc("pub_sort"), F.desc(F.col("etype") != text.NO_EVENT), "ingest_ord")
    matched = metal_events(metals, events).select("name", "pub_sort", "etype", "ingest_ord", "pressure", "cause").persist()
    counts = matched.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("pressure") == "UP", 1)).alias("up"),
        F.count(F.when(F.col("pressure") == "DOWN", 1)).alias("down"),
    )
    first = matched.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= BRIEF_EVENTS)
    known = F.when(F.length("cause") > 0, F.struct("_n", "cause"))
    causes = first.groupBy("name").agg(
        F.slice(F.array_sort(F.collect_list(known)), 1, BRIEF_CAUSES).alias("_causes"))
    grouped = counts.join(causes, "name")
    sentiment = (F.when(F.col("up") > F.col("down"), "Supply pressure ↑")
                 .when(F.col("down") > F.col("up"), "Supply easing ↓").otherwise("Mixed"))
    return grouped.select("name", sentiment.alias("sentiment"), "up", "down", "n",
                          F.transform("_causes", lambda c: c["cause"]).alias("causes"))


def pressure_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.when(F.col("pressure") == "UP", 1)).alias("up_count"),
                      F.count(F.lit(1)).alias("total"))


def type_histogram(events: DataFrame) -> DataFrame:
    """Events per type, most first, General last."""
    counts = events.groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.min("ingest_ord").alias("first_seen"))
    return counts.orderBy(F.col("etype") == text.NO_EVENT, F.desc("n"), "first_seen").drop("first_seen")


def matches_metal(value: Column, wanted: str) -> Column:
    """Either text contains the other, ignoring case; ``ALL`` matches everything."""
    if wanted == "ALL":
        return F.lit(True)
    lowered = F.lower(value)
    return lowered.contains(wanted.lower()) | F.lit(wanted.lower()).contains(lowered)


def filter_events(events: DataFrame, metal: str = "ALL", etype: str = "ALL") -> DataFrame:
    """Events with a matching tag and the given type."""
    kept = events
    if metal != "ALL":
        kept = kept.filter(F.exists("metals", lambda m: matches_metal(m, metal)))
    return kept if etype == "ALL" else kept.filter(F.col("etype") == etype)


def filter_by_metal(table: DataFrame, column: str, metal: str) -> DataFrame:
    return table.filter(matches_metal(F.col(column), metal))
