"""Limits that bite, aliases and times that the driver's tables don't have."""

from pyspark.sql import functions as F

from tidewheel.functions import text
from tidewheel.plans import events, rotation, signals
from tidewheel.sources import bars, dimensions
from tidewheel.streaming.headlines import classified_stream


def test_top_stocks_are_25_of_more(spark):
    members = spark.createDataFrame([(f"E{i % 3}", f"T{i:02d}", i % 7, i) for i in range(60)], "etf string, ticker string, score int, ord int")
    sectors = spark.createDataFrame([("E0", 5, 2), ("E1", 9, 1), ("E2", 5, 0)], "etf string, score int, ord int")
    rank = {"E0": (-5, 2), "E1": (-9, 1), "E2": (-5, 0)}
    want = sorted(range(60), key=lambda i: (-(i % 7), *rank[f"E{i % 3}"], i))[:25]
    assert [r.ticker for r in rotation.top_stocks(members.repartition(4), sectors).collect()] == [f"T{i:02d}" for i in want]


def test_buckets_show_8_of_more(spark):
    rows = [(f"T{i:02d}", f"n{i}", "E", "STRONG BUY", "BUY", 7, i, i, 3.0, 1.0 + i / 10, 70.0) for i in range(30)]
    drill = spark.createDataFrame(
        rows, "ticker string, name string, etf string, rec string, signal string, score int, ord int, days_active int, current_ret double, avg_20d double, hit_20d double")
    sectors = spark.createDataFrame([("E", 9, 0)], "etf string, score int, ord int")
    got = signals.signal_buckets(drill.repartition(3), sectors).collect()
    sizes = {r.bucket: r.bucket_size for r in got}
    assert max(sizes.values()) > signals.SHOWN
    for bucket, size in sizes.items():
        places = sorted(r.bucket_rank for r in got if r.bucket == bucket)
        assert places == list(range(1, min(size, signals.SHOWN) + 1))


def test_steel_goes_by_its_short_name(spark):
    metals = dimensions.metals(spark).filter(F.col("name").isin("Steel (HRC)", "Gold"))
    feed = spark.createDataFrame(
        [(1, ["Steel", "Gold"], "UP", "a cause of it", 5.0, "Labor Strike"), (2, ["Steel"], "DOWN", None, 4.0, "New Supply"), (3, ["Metals"], "UP", None, 3.0, "General"),
         (4, ["Steel"], "UP", "later cause", 9.0, "General")],
        "ingest_ord long, metals array<string>, pressure string, cause string, pub_sort double, etype string")
    pairs = {(r.name, r.ingest_ord) for r in events.metal_events(metals, feed).collect()}
    assert pairs == {("Steel (HRC)", 1), ("Steel (HRC)", 2), ("Steel (HRC)", 4), ("Gold", 1)}
    briefs = {r.name: r for r in events.supply_briefs(metals, feed).collect()}
    steel = briefs["Steel (HRC)"]
    assert (steel.n, steel.up, steel.down, steel.sentiment, steel.causes) == (3, 2, 1, "Supply pressure ↑", ["later cause", "a cause of it"])


def test_briefs_classify_events_once(spark):
    items = spark.createDataFrame([(1, "gold mine strike", 1.0)], "ingest_ord long, title string, pub_sort double")
    feed = text.classify(items, dimensions.event_types(), dimensions.metal_keywords(), dimensions.countries())
    briefs = events.supply_briefs(dimensions.metals(spark), feed)
    assert briefs.count() == 1
    plan = briefs._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan


def test_times_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(0, "2024-03-05 10:00:00"), (1, "soon, or later"), (2, None), (3, "")], "i int, published string")
    got = {r.i: (r.label, r.key) for r in rows.select("i", text.date_label(F.col("published")).alias("label"), text.sort_key(F.col("published")).alias("key")).collect()}
    assert got == {0: ("Mar 05", 1709632800.0), 1: ("soon, or l", 0.0), 2: ("", 0.0), 3: ("", 0.0)}


def test_fractions_of_a_volume(spark):
    raw = spark.createDataFrame([("A", "2024-01-02", "1", "1", "1", "1", "5.7"), ("B", "2024-01-02", "1", "1", "1", "1", "NaN")],
                                "symbol string, dt string, open string, high string, low string, close string, volume string")
    assert [(r.symbol, r.volume) for r in bars.conform_bars(raw, fractions=True).collect()] == [("A", 5.7)]


def test_undated_titles_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "title_raw string, published string"
    for rows in ([("No date - P", None), ("No date - P", "soon"), ("Dated - P", "2024-01-01 00:00:00")],
                 [("No date - P", None), ("Other - P", None), ("Dated - P", "2024-01-01 05:00:00")], [("No date - P", "later"), ("Dated - P", "2024-01-02 00:00:00")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = classified_stream(spark.readStream.schema(schema).parquet(inbox), dimensions.event_types(), dimensions.metal_keywords(),
                                   dimensions.countries(), undated_once=True)
        stream.select("title_raw", "etype").writeStream.format("parquet").option("checkpointLocation", state).trigger(
            availableNow=True).start(out).awaitTermination()
    assert sorted(r.title_raw for r in spark.read.parquet(out).collect()) == ["Dated - P", "No date - P", "Other - P"]
