"""The star-schema tables shaped into the engine's inputs: bars, dimensions, headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK = "ALL"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores; only an input of fewer files' parts is moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _roll_up(cells: DataFrame, symbol) -> DataFrame:
    """Combine already aggregated cells into wider bars; first and last keys order them."""
    return cells.groupBy(symbol.alias("symbol"), "dt").agg(
        F.min_by("open", "first_key").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_key").alias("close"),
        F.sum("volume").alias("volume"),
    )


def _placed_customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey")


def last_order_day(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the day of the last order that has a bar, which is the last day of the benchmark."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = _placed_customers(spark, folder).join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    # The last day of each customer first: orders of a customer are counted before they are moved.
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return last.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.to_date(F.max("last")).alias("as_of"))


def recent_order_bars(spark: SparkSession, folder: str, months: int = 3) -> DataFrame:
    """Daily bars of the last months only: older orders are not aggregated, and row groups of older ones not read."""
    first = F.add_months(last_order_day(spark, folder).scalar(), -months)
    return order_bars(spark, folder, first)


def order_bars(spark: SparkSession, folder: str, first: Column | None = None) -> DataFrame:
    """Daily bars of order prices per nation, per region and overall, from the day ``first`` on.

    Orders are aggregated once to (nation, day); regions and the benchmark roll up
    those cells, so the wide symbols never see single orders. Grouping by day makes
    bars unique per (symbol, day).
    """
    price = F.col("o_totalprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if first is not None:
        orders = orders.filter(F.col("o_orderdate") >= first.cast(orders.schema["o_orderdate"].dataType))
    customers = _placed_customers(spark, folder)
    cells = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("dt"))
        .agg(
            F.min_by(price, F.col("o_orderkey")).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, F.col("o_orderkey")).alias("close"),
            F.sum(F.round(price * 100).cast("bigint")).alias("volume"),
            F.min("o_orderkey").alias("first_key"),
            F.max("o_orderkey").alias("last_key"),
        )
    )
    placed = (
        cells.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("symbol", F.explode(F.array(F.lit(BENCHMARK), F.col("r_name"), F.col("n_name"))))
    )
    return _roll_up(placed, F.col("symbol"))


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of event values per event type; unique per (symbol, hour)."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return (
        table(spark, folder, "events").groupBy(F.col("event_type").alias("symbol"), hour.alias("dt"))
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def sector_dim(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_name").alias("etf"), F.initcap("r_name").alias("name"), F.col("r_regionkey").alias("ord"))


def universe_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Nations listed under their region, and all of them under a thematic list that comes first."""
    placed = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by_region = placed.select(F.col("r_name").alias("etf"), F.col("n_name").alias("ticker"),
                              (F.col("r_regionkey") + 1).alias("etf_ord"), F.col("n_nationkey").alias("ord"))
    thematic = placed.select(F.lit("THEME").alias("etf"), F.col("n_name").alias("ticker"),
                             F.lit(0).alias("etf_ord"), F.col("n_nationkey").alias("ord"))
    return thematic.unionByName(by_region)


def name_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Display names of the nations that have a supplier; the others have none."""
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, folder, "nation").join(suppliers, "n_nationkey", "left_semi").select(
        F.col("n_name").alias("ticker"), F.initcap(F.translate("n_name", "_", " ")).alias("name"))


def metal_dim(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.initcap("r_name").alias("name"), F.col("r_name").alias("ticker"), F.lit("$").alias("unit"),
        F.substring("r_name", 1, 2).alias("symbol"), F.lit(False).alias("proxy"), F.col("r_regionkey").alias("ord"))


def company_dim(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "nation").join(
            table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.initcap("r_name").alias("group"), F.initcap(F.translate("n_name", "_", " ")).alias("name"),
            F.col("n_name").alias("ticker"), F.col("r_name").alias("country"), F.lit("X").alias("exchange"),
            F.col("r_regionkey").alias("group_ord"), F.col("n_nationkey").alias("ord"))
    )


def feed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct document sources, numbered by their name; those with a one-digit number have a fixed publisher."""
    names = table(spark, folder, "documents").select("source").distinct()
    return names.select(
        F.col("source").alias("source_id"),
        F.when(F.length("source") == 4, F.concat(F.lit("Desk "), F.col("source"))).alias("publisher"),
        F.substring("source", 4, 9).try_cast("int").alias("source_ord"))


def feed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a feed entry: its whole text and source as the raw title."""
    hours = F.make_interval(hours=F.col("doc_id").cast("int"))
    published = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + hours
    return table(spark, folder, "documents").select(
        F.col("source").alias("source_id"),
        F.col("doc_id").alias("pos"),
        F.concat("text", F.lit(" - "), "source").alias("title_raw"),
        F.concat(F.lit("https://feed.example/"), F.col("doc_id").cast("string")).alias("link"),
        F.date_format(published, "yyyy-MM-dd HH:mm:ss").alias("published"),
    )
