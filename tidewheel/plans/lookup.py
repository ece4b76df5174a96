"""Full-universe lookup and stock search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.labels import DRILL_SCORE


def member_status(universe: DataFrame, sectors: DataFrame, rotation: DataFrame, names: DataFrame) -> DataFrame:
    """Every membership with its list's sector state; lists that are no scored sector get defaults."""
    state = rotation.select("etf", "quad", "score", "alert")
    return (
        universe.join(sectors.select("etf", F.col("name").alias("sector_name")), "etf", "left")
        .join(state, "etf", "left").join(names, "ticker", "left")
        .select(
            "etf", "etf_ord", "ord", "ticker",
            F.coalesce("name", "ticker").alias("name"),
            F.coalesce("sector_name", "etf").alias("sector_name"),
            F.coalesce(F.col("score") >= DRILL_SCORE, F.lit(False)).alias("rotating"),
            F.coalesce("quad", F.lit("Unknown")).alias("quad"),
            F.coalesce("score", F.lit(0)).alias("score"),
            F.coalesce("alert", F.lit("N/A")).alias("alert"),
        )
    )


def stock_lookup(status: DataFrame) -> DataFrame:
    """One row per upper-cased ticker: the last list's state at the first list's position."""
    place = F.struct("etf_ord", "ord")
    info = F.struct("name", F.col("etf").alias("sector_etf"), "sector_name", "rotating", "quad", "score", "alert")
    grouped = status.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.max_by(info, place).alias("info"), F.min(place).alias("first_place"))
    return grouped.select("ticker", "info.*", F.col("first_place.etf_ord").alias("first_etf_ord"),
                          F.col("first_place.ord").alias("first_ord"))


def matches(ticker: Column, name: Column, query: str) -> Column:
    """Ticker equals or starts with the query, or the name contains it, ignoring case."""
    wanted = query.strip().lower()
    return F.lower(ticker).startswith(wanted) | F.lower(name).contains(wanted)


def search_drilldown(drilldown: DataFrame, query: str) -> DataFrame:
    return drilldown.filter(matches(F.col("ticker"), F.col("name"), query))


def search_lookup(lookup: DataFrame, query: str) -> DataFrame:
    """First match in lookup order."""
    return lookup.filter(matches(F.col("ticker"), F.col("name"), query)).orderBy("first_etf_ord", "first_ord").limit(1)


def search(drilldown: DataFrame, lookup: DataFrame, query: str) -> DataFrame:
    """Drill-down matches, or without any the first lookup match."""
    found = search_drilldown(drilldown, query).select(
        "ticker", "name", F.col("etf").alias("sector_etf"), "score", F.lit("drilldown").alias("found_in"))
    any_found = found.agg(F.count(F.lit(1))).scalar()
    other = search_lookup(lookup, query).filter(any_found == 0).select(
        "ticker", "name", "sector_etf", "score", F.lit("lookup").alias("found_in"))
    return found.unionByName(other)
