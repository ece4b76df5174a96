"""Reading, checking and refreshing the bar table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
BAR_COLUMNS = ["symbol", "dt", *PRICES, "volume"]
BAR_SCHEMA = "symbol string, dt timestamp, open double, high double, low double, close double, volume bigint"


def drop_incomplete(bars: DataFrame) -> DataFrame:
    """Rows without any of open, high, low, close, volume; NaN counts as missing."""
    return bars.dropna(subset=[*PRICES, "volume"])


#: Day, time of day to the minute or second, and a zone, which is dropped; the later parts may be missing.
TIME_TEXT = (r"^\s*(\d{4}-\d{2}-\d{2})(?:[T\x20](\d{2}:\d{2})(:\d{2})?(?:\.\d+)?)?"
             r"\s*(?:Z|UTC|[+-]\d{2}:?\d{2}(?::\d{2})?)?\s*$")


def wall_time(text: Column) -> Column:
    """Wall time of a time text, null where it has another form."""
    day, minute, second = (F.regexp_extract(text, TIME_TEXT, k) for k in (1, 2, 3))
    filled = F.concat(day, F.lit(" "), F.when(minute == "", "00:00").otherwise(minute), F.when(second == "", ":00").otherwise(second))
    return F.when(day != "", F.try_to_timestamp(filled, F.lit("yyyy-MM-dd HH:mm:ss")))


def whole_number(text: Column) -> Column:
    """A whole number, null for NaN or unreadable text; a fraction ends the job, as it has no place in a bigint."""
    number = F.nanvl(text.try_cast("double"), F.lit(None))
    whole = number.try_cast("bigint")
    return F.when(number.isNull() | (whole == number), whole).otherwise(
        F.raise_error(F.concat(F.lit("volume is no whole number: "), text.cast("string"))).cast("bigint"))


def conform_bars(raw: DataFrame, fractions: bool = False) -> DataFrame:
    """Text or numeric columns in any letter case to the bar schema.

    The zone of a time text is dropped and its wall time kept; cells that do not
    parse count as missing. With ``fractions`` the volume is a double, as of shares sold in parts; without, a fraction ends the job.
    """
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    typed = lower.select(
        "symbol", wall_time(F.col("dt").cast("string")).alias("dt"),
        *[F.nanvl(F.col(c).try_cast("double"), F.lit(None)).alias(c) for c in PRICES],
        (F.nanvl(F.col("volume").try_cast("double"), F.lit(None)) if fractions else whole_number(F.col("volume"))).alias("volume"))
    return drop_incomplete(typed).dropna(subset=["dt"])


def read_bar_files(spark: SparkSession, path: str, fractions: bool = False) -> DataFrame:
    """CSV files named ``<symbol>_1d.csv``, first column the date, header in any letter case."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnRenamed(raw.columns[0], "dt")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_1d\.csv$", 1)
    return conform_bars(raw.select("*", F.url_decode(name).alias("symbol")), fractions)


def read_bar_csv(spark: SparkSession, path: str, fractions: bool = False) -> DataFrame:
    """CSV folder partitioned as ``symbol=<symbol>``; a filter on symbol prunes folders."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return conform_bars(raw.withColumnRenamed(raw.columns[0], "dt"), fractions)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bar table in parquet; filters on symbol and dt reach the scan."""
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def recent(bars: DataFrame, as_of: Column, months: int = 3) -> DataFrame:
    """Bars of the last months; ``as_of`` is a literal or a scalar subquery."""
    return bars.filter(F.col("dt") >= F.add_months(as_of, -months))


def data_as_of(bars: DataFrame, benchmark: str) -> DataFrame:
    """One row: the day of the last benchmark bar."""
    return bars.filter(F.col("symbol") == benchmark).agg(F.to_date(F.max("dt")).alias("as_of"))


def days_between(last: Column, as_of: Column, business_days: bool = False) -> Column:
    """Calendar days from ``last`` to ``as_of``; with ``business_days`` only those from Monday to Friday."""
    if not business_days:
        return F.datediff(as_of, last)
    whole, rest = F.floor(F.datediff(as_of, last) / 7), F.datediff(as_of, last) % 7
    tail = F.when(rest > 0, F.sequence(F.date_add(last, 1), F.date_add(last, rest.cast("int")))).otherwise(F.array().cast("array<date>"))
    return F.when(F.datediff(as_of, last) > 0, 5 * whole + F.size(F.filter(tail, lambda d: F.weekday(d) < 5))).otherwise(0).cast("int")


def freshness(bars: DataFrame, symbols: DataFrame, as_of: Column, max_age_days: int = 1, business_days: bool = False) -> DataFrame:
    """Every wanted symbol with its last bar day and whether it is stale; no bars is stale."""
    last = bars.groupBy("symbol").agg(F.to_date(F.max("dt")).alias("last_day"))
    age = days_between(F.col("last_day"), as_of, business_days)
    return symbols.join(last, "symbol", "left").select(
        "symbol", "last_day", F.coalesce(age > max_age_days, F.lit(True)).alias("stale"))


def fresh_history(landing: DataFrame, stale: DataFrame, since: str) -> DataFrame:
    """Full landed history of the stale symbols, complete rows only."""
    wanted = landing.filter(F.col("dt") >= F.lit(since).cast("timestamp"))
    return drop_incomplete(wanted.join(stale.select("symbol"), "symbol", "left_semi"))


def refreshed(bars: DataFrame, landing: DataFrame, status: DataFrame, since: str) -> DataFrame:
    """Bars after the refresh: stale symbols that landed are replaced whole, all others kept."""
    new = fresh_history(landing, status.filter("stale"), since).select(*BAR_COLUMNS)
    replaced = new.select("symbol").distinct()
    return bars.select(*BAR_COLUMNS).join(replaced, "symbol", "left_anti").unionByName(new)


def refresh_audit(landing: DataFrame, status: DataFrame, since: str) -> DataFrame:
    """Counts of updated, up-to-date and failed symbols."""
    landed = fresh_history(landing, status.filter("stale"), since).select("symbol").distinct()
    outcome = F.when(~F.col("stale"), "up-to-date").when(F.col("landed"), "updated").otherwise("failed")
    return (
        status.join(landed.withColumn("landed", F.lit(True)), "symbol", "left")
        .groupBy(outcome.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    )


def write_symbols(bars: DataFrame, path: str) -> None:
    """Replace the partitions of the symbols in ``bars``; other symbols stay.

    Range partitioning by symbol and time splits a large symbol over several
    writers; a repeated write gives the same files' content, so retries are safe.
    """
    (
        bars.select(*BAR_COLUMNS).repartitionByRange("symbol", "dt")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol").parquet(path)
    )
