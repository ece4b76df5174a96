"""Headline classification as a stream: titles once, then stateless projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import text
from tidewheel.streaming.first import first_in_order


def classified_stream(entries: DataFrame, types: Sequence, metals: Sequence, places: Sequence[str],
                      delay: str = "7 days", undated_once: bool = False, order: str | None = None) -> DataFrame:
    """Classify streamed entries ``(title_raw, published, ...)``, each raw title once per watermark.

    Arrival order decides which copy is first. State holds a digest per title, not
    the text, and is dropped once the watermark has passed. Entries without a readable
    time have no place in that order: they pass as they come, repeats included; with ``undated_once`` each of their titles
    passes once for ``delay`` after it came, by the clock. With ``order``, a column of whole numbers, all entries, dated or not, go by
    ``first_in_order`` instead: of those that come together the first in the source passes.
    """
    timed = (
        entries.withColumn("title_raw", text.strip(F.col("title_raw")))
        .filter(F.length("title_raw") > 0)
        .withColumn("seen_at", text.published_at(F.col("published")))
        .withColumn("title_digest", F.sha2("title_raw", 256))
    )
    if order is not None:
        once = first_in_order(timed, "title_digest", order, delay)
        return _classified(once, types, metals, places)
    dated = timed.filter(F.col("seen_at").isNotNull()).withWatermark("seen_at", delay)
    undated = timed.filter(F.col("seen_at").isNull())
    if undated_once:
        arrived = undated.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
        undated = arrived.dropDuplicatesWithinWatermark(["title_digest"]).drop("arrived")
    once = dated.dropDuplicatesWithinWatermark(["title_digest"]).unionByName(undated)
    return _classified(once, types, metals, places)


def _classified(once: DataFrame, types: Sequence, metals: Sequence, places: Sequence[str]) -> DataFrame:
    titled = once.select("*", text.headline(F.col("title_raw")).alias("title"))
    return text.classify(titled, types, metals, places).drop("title_digest")
