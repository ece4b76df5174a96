"""Feed entries and page links as one stream of headline items in ingest order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions import text
from tidewheel.sources.markup import anchors

FEED_CAP = 6
LINK_CAP = 20
MIN_LINK_CHARS = 30
HEADINGS = ("h2", "h3", "h4")
ITEM_COLUMNS = ["ingest_ord", "title_raw", "title", "source", "link", "pub_str", "pub_sort"]


def first_entries(entries: DataFrame, cap: int = FEED_CAP) -> DataFrame:
    """First ``cap`` entries of each source, then those with a title.

    Spark keeps only ``cap`` rows per source in every map task before the shuffle
    (window group limit), so a source with most of the rows is no hot spot.
    """
    place = Window.partitionBy("source_id").orderBy("pos")
    capped = entries.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= cap)
    return capped.drop("_n").withColumn("title_raw", text.strip(F.col("title_raw"))).filter(F.length("title_raw") > 0)


def feed_items(entries: DataFrame, sources: DataFrame, cap: int = FEED_CAP) -> DataFrame:
    """Capped entries as items; the configured publisher wins over the one in the title."""
    first = first_entries(entries, cap).join(sources, "source_id")
    raw, published = F.col("title_raw"), F.col("published")
    configured = F.when(F.length("publisher") > 0, F.col("publisher"))
    return first.select(
        (F.shiftleft(F.col("source_ord").cast("bigint"), 40) + F.col("pos")).alias("ingest_ord"),
        "title_raw",
        text.headline(raw).alias("title"),
        F.coalesce(configured, text.publisher(raw)).alias("source"),
        F.coalesce("link", F.lit("#")).alias("link"),
        text.date_label(published).alias("pub_str"),
        text.sort_key(published).alias("pub_sort"),
    )


def page_links(pages: DataFrame, base: str, within: Sequence[str] = HEADINGS, direct: bool = False, cap: int = LINK_CAP,
               min_chars: int = MIN_LINK_CHARS) -> DataFrame:
    """First ``cap`` links of each page that lie within the given elements (``direct``: right in one), with long enough text and a target.

    The cap counts anchors before the filters; a title joins the anchor's trimmed text nodes without blanks.
    """
    return (
        pages.select("page_id", F.posexplode(anchors(F.col("html"), within, direct, cap)).alias("link_no", "anchor"))
        .select("page_id", "link_no", "anchor.title", "anchor.href")
        .filter((F.length("title") > min_chars) & (F.length("href") > 0))
        .withColumn("link", text.absolute_link(F.col("href"), base))
    )


def link_items(links: DataFrame, source: str, cap: int = LINK_CAP) -> DataFrame:
    """Page links as undated items that come after all feed items; ``cap`` is that of the links."""
    after_feeds = F.shiftleft(F.lit(1).cast("bigint"), 62)
    place = F.shiftleft(F.col("page_id"), max(5, (cap - 1).bit_length()))
    return links.select(
        (after_feeds + place + F.col("link_no")).alias("ingest_ord"),
        F.col("title").alias("title_raw"), "title", F.lit(source).alias("source"), "link",
        F.lit("").alias("pub_str"), F.lit(0.0).alias("pub_sort"),
    )


def first_by_title(items: DataFrame) -> DataFrame:
    """Keep the earliest item of every raw title.

    Only a digest and the unique ingest order are grouped, combined on the map
    side, so many copies of one title collapse before the shuffle and whole texts
    are not sorted.
    """
    digest = F.sha2("title_raw", 256)
    first = items.groupBy(digest.alias("_digest")).agg(F.min("ingest_ord").alias("ingest_ord"))
    return items.join(first.select("ingest_ord"), "ingest_ord", "left_semi")


def headline_items(feeds: DataFrame, links: DataFrame) -> DataFrame:
    """Feed items and link items, feeds first, first of each title."""
    return first_by_title(feeds.select(*ITEM_COLUMNS).unionByName(links.select(*ITEM_COLUMNS)))
