"""Bar files, page links, feeds and payloads on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import labels, text
from tidewheel.operators.frames import trend_frame
from tidewheel.sources import bars, dimensions, feeds, sinks


def test_bar_files(spark, tmp_path):
    (tmp_path / "AB=1_1d.csv").write_text(
        "Date,Open,High,Low,Close,Volume\n2024-01-02 05:30,1,2,0.5,1.5,10\n2024-01-02 05:31:07-05:00,1,2,0.5,1.6,11.0\n"
        "2024-01-03T00:00:00Z,1,2,0.5,1.7,12\n2024-01-04,1,2,0.5,1.8,NaN\n2024-01-05,NaN,2,0.5,1.9,14\nsoon,1,2,0.5,2,15\n")
    rows = bars.read_bar_files(spark, str(tmp_path)).orderBy("dt").collect()
    assert [(r.symbol, str(r.dt), r.close, r.volume) for r in rows] == [
        ("AB=1", "2024-01-02 05:30:00", 1.5, 10), ("AB=1", "2024-01-02 05:31:07", 1.6, 11), ("AB=1", "2024-01-03 00:00:00", 1.7, 12)]


def test_fraction_of_a_volume_is_refused(spark):
    raw = spark.createDataFrame([("A", "2024-01-02", "1", "1", "1", "1", "5.7")], "symbol string, dt string, open string, high string, low string, close string, volume string")
    with pytest.raises(Exception, match="no whole number"):
        bars.conform_bars(raw).collect()


def test_page_links(spark):
    html = ("<h2><a href='/one'>First heading link with a long enough text</a> <a class=x href=https://x.example/2>"
            "Second &#8217;link&#x21; of one heading, &quot;quoted&quot; &amp; long</a></h2><p><a href='/no'>Not in a heading but long enough text</a></p>"
            "<h3>no link</h3><h4><a href=\"\">Third heading link has no target at all</a><a href='/s'>short</a></h4>")
    rows = feeds.page_links(spark.createDataFrame([(1, html)], "page_id long, html string"), "https://b.example").orderBy("link_no").collect()
    assert [(r.link_no, r.title, r.link) for r in rows] == [
        (0, "First heading link with a long enough text", "https://b.example/one"),
        (1, "Second ’link! of one heading, \"quoted\" & long", "https://x.example/2")]


def test_link_order_has_room_for_any_cap(spark):
    links = spark.createDataFrame([(1, 40, "a", "u"), (2, 8, "b", "u")], "page_id long, link_no int, title string, link string")
    assert feeds.link_items(links, "s", cap=64).select("ingest_ord").distinct().count() == 2


def test_quirks_of_titles(spark):
    titles = ["A - B - Paper", "Award for a thousand", "DR Congo strike", "EPA rules", "Gas shortage bites", "Output falls due to heavy flooding, again"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, raw string")
    head = {r.i: (r.h, r.p) for r in df.select("i", text.headline(F.col("raw")).alias("h"), text.publisher(F.col("raw")).alias("p")).collect()}
    assert head[0] == ("A - B", "Paper") and head[1] == ("Award for a thousand", "")
    got = {r.i: r for r in text.classify(df.withColumnRenamed("raw", "title"), dimensions.event_types(), dimensions.metal_keywords(), dimensions.countries()).collect()}
    assert got[5].cause == "heavy flooding" and got[2].etype == "Labor Strike"


def test_short_series_keep_their_values_without_a_gate(spark):
    rows = [("S", f"2024-01-{d:02d}", 1.0 + d, 2.0 + d, 0.5 + d, 1.5 + d, 10) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "symbol string, dt string, open double, high double, low double, close double, volume long").withColumn("dt", F.to_timestamp("dt"))
    assert trend_frame(df, min_bars=1).count() == 28 and trend_frame(df).count() == 0


def test_payload_keeps_nulls_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([("x", None, [1.5, 2.0])], "name string, cause string, p array<double>")
    assert json.loads(sinks.json_rows(df).first()["json"]) == {"name": "x", "cause": None, "p": [1.5, 2.0]}
    sinks.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_default_sentence(spark):
    row = spark.createDataFrame([("Leading", "BUY", "ALERT", 3, 25.0)], "q string, s string, l string, n int, r double")
    out = row.select(labels.reason(F.col("q"), None, F.col("s"), F.col("l"), F.col("n"), F.col("r")).alias("t")).first()["t"]
    assert out == "Outperforming SPY (Leading); StealthTrail active; 3/4 confirmation signals; +25.0% 1Y momentum"


def test_dimensions_are_reached(spark):
    assert len(dimensions.countries()) == 44
    assert sum(len(k[3]) for k in dimensions.event_types()) == 95


def test_options_of_keyword_matching(spark):
    df = spark.createDataFrame([(0, "Award for a thousand"), (1, "DR Congo strike"), (2, "EPA rules")], "i int, title string")
    args = (dimensions.event_types(), dimensions.metal_keywords(), dimensions.countries())
    plain = {r.i: r for r in text.classify(df, *args).collect()}
    strict = {r.i: r for r in text.classify(df, *args, match=text.Match(word_boundary=True, fold_case=True, longest_match=True)).collect()}
    assert plain[0].country == "USA" and strict[0].country is None
    assert plain[1].country == "Congo" and strict[1].country == "DR Congo"
    assert plain[2].etype == "General" and strict[2].etype != "General"


def test_business_days(spark):
    row = spark.sql("select date'2024-01-05' as friday, date'2024-01-08' as monday, date'2024-01-19' as later").select(
        bars.days_between(F.col("friday"), F.col("monday")).alias("a"), bars.days_between(F.col("friday"), F.col("monday"), True).alias("b"),
        bars.days_between(F.col("friday"), F.col("later"), True).alias("c")).first()
    assert tuple(row) == (3, 1, 10)
