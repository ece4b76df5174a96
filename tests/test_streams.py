"""Streams give what one batch gives."""

import time
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewheel.sources import bars, dimensions, feeds
from tidewheel.streaming.headlines import classified_stream
from tidewheel.streaming.refresh import refresh_stream

SCHEMA = "title_raw string, published string"


def test_headlines_in_two_batches(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [("Strike at mine - P", "2024-01-01 00:00:00"), ("No date here - P", None)]
    later = [("Strike at mine - P", "2024-01-01 05:00:00"), ("Strike at mine - P", "2024-03-01 00:00:00"), ("No date here - P", None)]
    for rows in (first, later):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = classified_stream(spark.readStream.schema(SCHEMA).parquet(inbox), dimensions.event_types(), dimensions.metal_keywords(),
                                   dimensions.countries(), delay="7 days")
        stream.select("title_raw", "published", "etype").writeStream.format("parquet").option("checkpointLocation", state).trigger(
            availableNow=True).start(out).awaitTermination()
    got = sorted((r.title_raw, r.published or "") for r in spark.read.parquet(out).collect())
    # Entries without a time pass as they come; a dated title is dropped while the watermark remembers it.
    assert [r for r in got if not r[1]] == [("No date here - P", "")] * 2
    assert ("Strike at mine - P", "2024-01-01 05:00:00") not in got


def _bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, day string, price double").select(
        "symbol", F.to_timestamp("day").alias("dt"), *[F.col("price").alias(c) for c in bars.PRICES], F.lit(1).cast("bigint").alias("volume"))


def test_refresh_in_two_batches_and_a_retry(spark, tmp_path):
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "bars")
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    bars.write_symbols(_bars(spark, [("A", "2024-01-01", 1.0), ("C", "2024-01-09", 3.0)]), target)
    _bars(spark, [("A", "2024-01-10", 9.0), ("C", "2024-01-10", 9.0)]).write.mode("append").parquet(inbox)
    refresh_stream(spark, inbox, target, wanted, date(2024, 1, 10), "2010-01-01", str(tmp_path / "state"))
    _bars(spark, [("B", "2024-01-10", 5.0)]).write.mode("append").parquet(inbox)
    for state in ("state", "again"):  # the second checkpoint repeats both landings
        refresh_stream(spark, inbox, target, wanted, date(2024, 1, 10), "2010-01-01", str(tmp_path / state))
        got = sorted((r.symbol, r.close) for r in bars.read_bars(spark, target).collect())
        assert got == [("A", 9.0), ("B", 5.0), ("C", 3.0)]


ORDERED = "ingest_ord bigint, title_raw string, published string, weight double, small int, at timestamp, day date, tags array<string>"


def _entry(place, title, published=None):
    at = datetime(2024, 5, 1, 12, 0, 0, 123456) if place % 2 else None
    return (place, title, published, 0.1 * place, None if place % 3 else place, at, at.date() if at else None, ["é", None, '"'] if at else None)


def _landings():
    big = 1 << 62
    return [
        [_entry(4, "No date here - P"), _entry(2, " No date here - P "), _entry(3, "Strike at mine - P", "2024-01-01 05:00:00"),
         _entry(1, "Strike at mine - P"), _entry(0, "   "), _entry(5, None)],
        [_entry(6, "No date here - P"), _entry(7, "Strike at mine - P", "2025-01-01 00:00:00"), _entry(9, "New - P"), _entry(8, "New - P"),
         _entry(big + 1, "Late - P"), _entry(big, "Late - P")],
        [_entry(10, "New - P"), _entry(11, "Last - P")],
    ]


def _land(spark, tmp_path, rows, delay):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows, ORDERED).repartition(3).write.mode("append").parquet(inbox)
    stream = classified_stream(spark.readStream.schema(ORDERED).parquet(inbox), dimensions.event_types(), dimensions.metal_keywords(),
                               dimensions.countries(), delay, order="ingest_ord")
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_first_titles_of_batches_in_source_order_are_those_of_all(spark, tmp_path):
    columns = [c.split()[0] for c in ORDERED.split(", ")]
    for rows in _landings():
        got = _land(spark, tmp_path, rows, "7 days")
    entries = spark.createDataFrame([r for rows in _landings() for r in rows], ORDERED)
    stripped = entries.withColumn("title_raw", F.trim("title_raw")).filter(F.length("title_raw") > 0)
    want = feeds.first_by_title(stripped).select(*columns)
    assert sorted(got.select(*columns).collect(), key=repr) == sorted(want.collect(), key=repr)
    assert sorted(r.ingest_ord for r in got.collect()) == [1, 2, 8, 11, 1 << 62]
    assert {r.title_raw: r.etype for r in got.collect()}["Strike at mine - P"] == "Labor Strike"


def test_titles_pass_again_after_their_time(spark, tmp_path):
    first = [_entry(1, "Same - P"), _entry(2, "Same - P")]
    _land(spark, tmp_path, first, "10 seconds")
    assert sorted(r.ingest_ord for r in _land(spark, tmp_path, [_entry(3, "Same - P")], "10 seconds").collect()) in ([1], [1, 3])  # the clock decides
    time.sleep(11)
    got = _land(spark, tmp_path, [_entry(5, "Same - P"), _entry(4, "Same - P")], "10 seconds")
    assert {1, 4} <= {r.ingest_ord for r in got.collect()} and 5 not in {r.ingest_ord for r in got.collect()}


def test_state_of_first_titles_row_by_row():
    """No frame is made for a key; an old timer leaves the state of a later pass alone."""
    from pyspark.sql import Row

    from tidewheel.streaming.first import _First

    class State:
        value = None
        get = lambda self: self.value
        clear = lambda self: setattr(self, "value", None)
        update = lambda self, value: setattr(self, "value", value)

    class Handle:
        timers = []
        state = State()
        getValueState = lambda self, *_: self.state
        registerTimer = lambda self, at: self.timers.append(at)

    class Expired:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    first, handle = _First(100), Handle()
    first.init(handle)

    def batch(now, *places):
        return [r["_row"] for r in first.handleInputRows(("k",), iter([Row(_key="k", _place=p, _row=f"r{p}", _came_ms=now) for p in places]), None)]

    assert (batch(1000, 3, 1, 2), batch(1050, 0), batch(1100, 9, 8)) == (["r1"], [], ["r8"])
    assert handle.timers == [1100, 1200]
    assert list(first.handleExpiredTimer(("k",), None, Expired(1100))) == [] and handle.state.value == (1200,)
    assert list(first.handleExpiredTimer(("k",), None, Expired(1200))) == [] and handle.state.value is None
