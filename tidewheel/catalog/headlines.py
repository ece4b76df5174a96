"""Queries over headlines: feeds, links, text functions, event feed, briefs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.catalog.inputs import EVENT_WORDS, LIST_LINK, METAL_WORDS, MIN_LINK, PAGE_BASE, PAGE_SOURCE
from tidewheel.catalog.registry import query
from tidewheel.catalog.sql import CTES, json_of, quote, strip
from tidewheel.functions import text
from tidewheel.functions.keywords import keyword_matches
from tidewheel.plans import events as ev
from tidewheel.session import new_path
from tidewheel.sources import dimensions as dims
from tidewheel.sources import feeds, sinks
from tidewheel.sources import tables as t
from tidewheel.streaming.first import first_in_order
from tidewheel.streaming.headlines import classified_stream

# Oracle parts -----------------------------------------------------------------

CTES["entries"] = """SELECT source AS source_id, doc_id AS pos, text || ' - ' || source AS title_raw,
  'https://feed.example/' || doc_id AS link, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published FROM documents"""
CTES["feed_dim"] = """SELECT DISTINCT source AS source_id, CASE WHEN length(source) = 4 THEN 'Desk ' || source END AS publisher,
  CAST(source[4:] AS INTEGER) AS source_ord FROM documents"""


def _head(raw: str) -> str:
    return strip(f"CASE WHEN contains({raw}, ' - ') THEN regexp_extract({raw}, '(?s)^(.*) - (.*)$', 1) ELSE {raw} END")


def _tail(raw: str) -> str:
    return strip(f"regexp_extract({raw}, '(?s)^(.*) - (.*)$', 2)")


CTES["first_entries"] = f"""SELECT * FROM (
  SELECT source_id, pos, {strip('title_raw')} AS title_raw, link, published,
         row_number() OVER (PARTITION BY source_id ORDER BY pos) AS n FROM entries) WHERE n <= 6 AND title_raw <> ''"""
CTES["feed_rows"] = f"""SELECT f.source_ord::BIGINT * 1099511627776 + e.pos AS ingest_ord, e.title_raw, {_head('e.title_raw')} AS title,
  coalesce(f.publisher, {_tail('e.title_raw')}) AS source, e.link, strftime(published, '%b %d') AS pub_str,
  epoch(published)::DOUBLE AS pub_sort FROM first_entries e JOIN feed_dim f USING (source_id)"""
CTES["anchors"] = r"""SELECT page_id, unnest(a) AS anchor, generate_subscripts(a, 1) - 1 AS link_no FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<li>\s*(<a\b[^>]*>.*?</a>)', 1)[1:20] AS a FROM pages)"""
CTES["links"] = rf"""SELECT page_id, link_no, title, href,
  CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://pages.example' || href END AS link FROM (
  SELECT page_id, link_no, {strip("replace(regexp_replace(anchor, '(?s)<[^>]*>', '', 'g'), '&amp;', '&')")} AS title,
         regexp_extract(anchor, '(?is)^<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1) AS href FROM anchors)
WHERE length(title) > 2 AND length(href) > 0"""
CTES["link_rows"] = """SELECT 4611686018427387904 + page_id * 32 + link_no AS ingest_ord, title AS title_raw, title,
  'Pages' AS source, link, '' AS pub_str, 0e0 AS pub_sort FROM links"""
CTES["items"] = """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY title_raw ORDER BY ingest_ord) AS nth
  FROM (SELECT * FROM feed_rows UNION ALL SELECT * FROM link_rows)) WHERE nth = 1"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words) + ")"


def _classified(source: str, types, metals, places) -> str:
    scores = ", ".join("(" + " + ".join(f"contains(low, {quote(k)})::INT" for k in kind[3]) + f") AS s{i}"
                       for i, kind in enumerate(types))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(types))) + ")"

    def pick(position: int, otherwise: str) -> str:
        cases = " ".join(f"WHEN s{i} = {best} THEN {quote(kind[position])}" for i, kind in enumerate(types))
        return f"CASE WHEN {best} = 0 THEN {quote(otherwise)} {cases} END"

    tags = "[x FOR x IN [" + ", ".join(
        f"CASE WHEN {_any('low', keys)} THEN {quote(m)} END" for m, keys in metals) + "] IF x IS NOT NULL]"
    captures = [strip(f"regexp_extract(title, {quote('(?i)' + p)}, 1)") for p in text.CAUSE_PATTERNS]
    cause = "coalesce(" + ", ".join(f"CASE WHEN length({c}) > 5 THEN {c} END" for c in captures) + ")"
    country = "CASE " + " ".join(f"WHEN contains(low, {quote(p.lower())}) THEN {quote(p)}" for p in places) + " END"
    return f"""SELECT * EXCLUDE (tags), CASE WHEN len(tags) = 0 THEN ['Metals'] ELSE tags END AS metals FROM (
  SELECT *, {pick(0, 'General')} AS etype, {pick(1, '?')} AS pressure, {pick(2, 'gray')} AS color, {tags} AS tags,
         left({cause}, 70) AS cause, {country} AS country
  FROM (SELECT *, {scores} FROM (SELECT *, lower(title) AS low FROM {source})))"""


CTES["titled"] = f"SELECT pos, {_head('title_raw')} AS title FROM entries"
CTES["doc_classes"] = _classified("titled", EVENT_WORDS, METAL_WORDS, dims.countries())
CTES["doc_default_classes"] = _classified("titled", dims.event_types(), dims.metal_keywords(), dims.countries())
CTES["feed_classes"] = _classified("items", EVENT_WORDS, METAL_WORDS, dims.countries())
CTES["placed"] = """SELECT *, row_number() OVER (ORDER BY pub_sort DESC, etype <> 'General' DESC, ingest_ord) AS place
FROM feed_classes"""
CTES["latest"] = "SELECT * FROM placed WHERE place <= 70"

# Inputs -----------------------------------------------------------------------


def _links(spark: SparkSession, d: str) -> DataFrame:
    return feeds.page_links(t.spread(t.table(spark, d, "pages")), PAGE_BASE, LIST_LINK, direct=True, min_chars=MIN_LINK)


def _items(spark: SparkSession, d: str) -> DataFrame:
    found = feeds.feed_items(t.feed_entries(spark, d), t.feed_sources(spark, d))
    return feeds.headline_items(found, feeds.link_items(_links(spark, d), PAGE_SOURCE))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return ev.latest_events(_items(spark, d), EVENT_WORDS, METAL_WORDS, dims.countries())


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """The whole classified feed, without the cap of the shown one."""
    return text.classify(_items(spark, d), EVENT_WORDS, METAL_WORDS, dims.countries())


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return t.spread(t.feed_entries(spark, d)).select("pos", text.headline(F.col("title_raw")).alias("title"))


def _classified_docs(spark: SparkSession, d: str) -> DataFrame:
    return text.classify(_titled(spark, d), EVENT_WORDS, METAL_WORDS, dims.countries())


# Sources ----------------------------------------------------------------------


@query("feed_first_entries", "SELECT source_id, pos, title_raw, link FROM first_entries")
def feed_first_entries(spark: SparkSession, d: str) -> DataFrame:
    return feeds.first_entries(t.feed_entries(spark, d)).select("source_id", "pos", "title_raw", "link")


@query("feed_items", "SELECT * FROM feed_rows")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    return feeds.feed_items(t.feed_entries(spark, d), t.feed_sources(spark, d))


@query("page_links", "SELECT page_id, link_no::INTEGER AS link_no, title, href, link FROM links")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


@query("headline_items", "SELECT ingest_ord, title, source, link, pub_str, pub_sort FROM items")
def headline_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("ingest_ord", "title", "source", "link", "pub_str", "pub_sort")


@query("first_titles", "SELECT min(doc_id) AS first_pos FROM documents GROUP BY text || ' - ' || source")
def first_titles(spark: SparkSession, d: str) -> DataFrame:
    """First entry of every whole raw title over all documents."""
    entries = t.feed_entries(spark, d).withColumn("ingest_ord", F.col("pos"))
    return feeds.first_by_title(entries).select(F.col("pos").alias("first_pos"))


# Text -------------------------------------------------------------------------


@query("title_split", f"SELECT pos, {_head('title_raw')} AS title, {_tail('title_raw')} AS publisher FROM entries")
def title_split(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("title_raw")
    return t.feed_entries(spark, d).select("pos", text.headline(raw).alias("title"),
                                           text.publisher(raw).alias("publisher"))


@query("entry_publishers", f"""SELECT e.pos, coalesce(f.publisher, {_tail('e.title_raw')}) AS publisher
FROM entries e JOIN feed_dim f USING (source_id)""")
def entry_publishers(spark: SparkSession, d: str) -> DataFrame:
    joined = t.feed_entries(spark, d).join(t.feed_sources(spark, d), "source_id")
    return joined.select("pos", F.coalesce("publisher", text.publisher(F.col("title_raw"))).alias("publisher"))


@query("publication_labels", """SELECT pos, strftime(published, '%b %d') AS pub_str, epoch(published)::DOUBLE AS pub_sort
FROM entries""")
def publication_labels(spark: SparkSession, d: str) -> DataFrame:
    published = F.col("published")
    return t.feed_entries(spark, d).select("pos", text.date_label(published).alias("pub_str"),
                                           text.sort_key(published).alias("pub_sort"))


@query("document_events", "SELECT pos, etype, pressure, color FROM doc_classes")
def document_events(spark: SparkSession, d: str) -> DataFrame:
    return _classified_docs(spark, d).select("pos", "etype", "pressure", "color")


@query("document_metals", "SELECT pos, array_to_string(metals, ', ') AS metals FROM doc_classes")
def document_metals(spark: SparkSession, d: str) -> DataFrame:
    return _classified_docs(spark, d).select("pos", F.array_join("metals", ", ").alias("metals"))


@query("document_classes_default", """SELECT pos, etype, pressure, color, array_to_string(metals, ', ') AS metals, cause,
country FROM doc_default_classes""")
def document_classes_default(spark: SparkSession, d: str) -> DataFrame:
    """All text functions with the built-in dictionaries over whole documents."""
    out = text.classify(_titled(spark, d), dims.event_types(), dims.metal_keywords(), dims.countries())
    return out.select("pos", "etype", "pressure", "color", F.array_join("metals", ", ").alias("metals"), "cause", "country")


@query("root_causes", "SELECT pos, cause FROM doc_classes WHERE cause IS NOT NULL")
def root_causes(spark: SparkSession, d: str) -> DataFrame:
    return _titled(spark, d).select("pos", text.cause(F.col("title")).alias("cause")).dropna(subset=["cause"])


@query("countries", "SELECT pos, country FROM doc_classes WHERE country IS NOT NULL")
def countries(spark: SparkSession, d: str) -> DataFrame:
    found = text.country(F.lower("title"), dims.countries())
    return _titled(spark, d).select("pos", found.alias("country")).dropna(subset=["country"])


@query("keyword_hits", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE contains(lower(title), {quote(w)})) AS n{i}_{j}"
    for i, kind in enumerate(EVENT_WORDS) for j, w in enumerate(kind[3])) + " FROM titled")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    low = _titled(spark, d).select(F.lower("title").alias("low"))
    return low.agg(*[F.count(F.when(F.col("low").contains(w), 1)).alias(f"n{i}_{j}")
                     for i, kind in enumerate(EVENT_WORDS) for j, w in enumerate(kind[3])])


CTES["phrases"] = """SELECT DISTINCT w[i] || ' ' || w[i + 1] AS keyword FROM (SELECT w, unnest(range(1, len(w))) AS i
  FROM (SELECT regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark))"""
_PHRASE_HITS = """SELECT keyword, count(*) AS n_documents, min(doc_id) AS first_doc FROM documents JOIN phrases ON contains(text, keyword)
GROUP BY keyword"""


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary as a table: all two neighbouring words of the benchmark's texts."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\t-\r]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("words", i, 2)))
    return t.table(spark, d, "benchmark").select(words.alias("words")).filter(F.size("words") > 1).select(F.explode(pairs).alias("keyword"))


def _phrase_hits(spark: SparkSession, d: str, **sent: int) -> DataFrame:
    docs = t.spread(t.table(spark, d, "documents").select("doc_id", "text"))
    found = keyword_matches(docs, _phrases(spark, d), "doc_id", "text", **sent)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc"))


@query("dictionary_hits", _PHRASE_HITS)
def dictionary_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each phrase of a dictionary that is a table, by an automaton while it is small."""
    return _phrase_hits(spark, d)


@query("dictionary_hits_joined", _PHRASE_HITS)
def dictionary_hits_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same by rarest grams, as for a dictionary too large to be sent."""
    return _phrase_hits(spark, d, sent_bytes=0)


# Events -----------------------------------------------------------------------

_EVENT = "title, source, link, pub_str, pub_sort, etype, color, pressure"


@query("event_feed", f"SELECT {_EVENT}, array_to_string(metals, ', ') AS metals, cause, country FROM latest")
def event_feed(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select(*_EVENT.split(", "), F.array_join("metals", ", ").alias("metals"), "cause", "country")


@query("latest_events", "SELECT ingest_ord, etype FROM latest")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("ingest_ord", "etype")


@query("event_attributes", "SELECT etype, pressure, color, count(*) AS n FROM doc_classes GROUP BY ALL")
def event_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Pressure and colour looked up by type after counting, one row per type."""
    counts = _classified_docs(spark, d).groupBy("etype").agg(F.count(F.lit(1)).alias("n"))
    types = spark.createDataFrame([kind[:3] for kind in EVENT_WORDS], "etype string, pressure string, color string")
    return ev.attach_attributes(counts, types).select("etype", "pressure", "color", "n")


@query("event_type_histogram", "SELECT etype, count(*) AS n FROM feed_classes GROUP BY etype")
def event_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ev.type_histogram(_feed(spark, d))


@query("pressure_counts", "SELECT count(*) FILTER (WHERE pressure = 'UP') AS up_count, count(*) AS total FROM feed_classes")
def pressure_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.pressure_counts(_feed(spark, d))


@query("event_filter", """SELECT title, etype FROM feed_classes WHERE etype = 'Closure'
AND len([m FOR m IN metals IF contains(lower(m), 'asia') OR contains('asia', lower(m))]) > 0""")
def event_filter(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_events(_feed(spark, d), "Asia", "Closure").select("title", "etype")


@query("document_event_filter", """SELECT pos FROM doc_classes WHERE etype = 'Strike'
AND len([m FOR m IN metals IF contains(lower(m), 'asia/europe') OR contains('asia/europe', lower(m))]) > 0""")
def document_event_filter(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_events(_classified_docs(spark, d), "Asia/Europe", "Strike").select("pos")


CTES["metal_event_rows"] = """SELECT s.name, e.* FROM placed e JOIN sectors s ON list_contains(e.metals, s.name)"""


@query("metal_event_pairs", "SELECT name, ingest_ord, pressure FROM metal_event_rows")
def metal_event_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ev.metal_events(t.metal_dim(spark, d), _feed(spark, d)).select("name", "ingest_ord", "pressure")


CTES["briefs"] = """SELECT name, CASE WHEN up > down THEN 'Supply pressure ↑' WHEN down > up THEN 'Supply easing ↓'
  ELSE 'Mixed' END AS sentiment, up, down, n, causes FROM (
  SELECT name, count(*) AS n, count(*) FILTER (WHERE pressure = 'UP') AS up, count(*) FILTER (WHERE pressure = 'DOWN') AS down,
         (list(cause ORDER BY place) FILTER (WHERE nth_event <= 4 AND cause IS NOT NULL))[1:2] AS causes
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place) AS nth_event FROM metal_event_rows) GROUP BY name)"""


@query("supply_briefs", """SELECT name, sentiment, up, down, n, coalesce(array_to_string(causes, '; '), '') AS causes
FROM briefs""")
def supply_briefs(spark: SparkSession, d: str) -> DataFrame:
    briefs = ev.supply_briefs(t.metal_dim(spark, d), _feed(spark, d))
    return briefs.withColumn("causes", F.array_join("causes", "; "))


_BRIEF = ("name", "sentiment", "up", "down", "n", "causes")
_EVENT_ROW = ("title", "source", "link", "pub_str", "pub_sort", "etype", "color", "pressure", "metals", "cause", "country")


@query("brief_payload", f"SELECT {json_of(*_BRIEF)} FROM (SELECT * REPLACE (coalesce(causes, []) AS causes) FROM briefs)")
def brief_payload(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_rows(ev.supply_briefs(t.metal_dim(spark, d), _feed(spark, d)), *_BRIEF)


@query("event_payload", f"SELECT ingest_ord, {json_of(*_EVENT_ROW)} FROM latest".replace("'pub_sort': \"pub_sort\"", "'pub_sort': pub_sort::BIGINT"))
def event_payload(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of the shown feed, with arrays and nulls; whole seconds, as SQL writes large doubles in another form."""
    rows = _latest(spark, d).withColumn("pub_sort", F.col("pub_sort").cast("bigint"))
    return rows.select("ingest_ord", sinks.json_object(*_EVENT_ROW).alias("json"))


CTES["streamed"] = _classified("streamed_titles", EVENT_WORDS, METAL_WORDS, dims.countries())
CTES["streamed_titles"] = f"""SELECT DISTINCT {_head('title_raw')} AS title, title_raw FROM entries"""


@query("streamed_first_titles", "SELECT min(doc_id) AS first_pos FROM documents GROUP BY text || ' - ' || source")
def streamed_first_titles(spark: SparkSession, d: str) -> DataFrame:
    """First entry of every whole raw title, of a stream in which the first half lands by itself and then all entries."""
    inbox, out, state = (new_path(spark, n) for n in ("entries", "titles", "title-state"))
    entries = t.feed_entries(spark, d).select("pos", F.sha2("title_raw", 256).alias("title_digest"))
    middle = entries.agg(F.max("pos")).scalar() / 2
    for landed in (entries.filter(F.col("pos") <= middle), entries):
        landed.write.mode("append").parquet(inbox)
        once = first_in_order(spark.readStream.schema(entries.schema).parquet(inbox), "title_digest", "pos", "7 days")
        once.select(F.col("pos").alias("first_pos")).writeStream.format("parquet").option("checkpointLocation", state).trigger(
            availableNow=True).start(out).awaitTermination()
    return spark.read.schema("first_pos bigint").parquet(out)


@query("streamed_headlines", """SELECT etype, pressure, array_to_string(metals, ', ') AS metals, cause, country, count(*) AS n
FROM streamed GROUP BY ALL""")
def streamed_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream of entries, each whole title classified once."""
    inbox, out = new_path(spark, "entries"), new_path(spark, "classified")
    t.feed_entries(spark, d).write.parquet(inbox)
    schema = t.feed_entries(spark, d).schema
    stream = classified_stream(spark.readStream.schema(schema).parquet(inbox), EVENT_WORDS, METAL_WORDS,
                               dims.countries())
    written = (
        stream.select("etype", "pressure", F.array_join("metals", ", ").alias("metals"), "cause", "country")
        .writeStream.format("parquet").option("checkpointLocation", new_path(spark, "headline-state"))
        .trigger(availableNow=True).start(out)
    )
    written.awaitTermination()
    return spark.read.schema(
        "etype string, pressure string, metals string, cause string, country string").parquet(out).groupBy(
        "etype", "pressure", "metals", "cause", "country").agg(F.count(F.lit(1)).alias("n"))
