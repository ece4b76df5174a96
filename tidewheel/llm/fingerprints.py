"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's shingles.
Sketches of parts merge to the sketch of the whole. The smallest values of two
sketches together estimate their resemblance; with the distinct counts that a sketch
implies, also containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 64
SHINGLE = 5
#: Consecutive document numbers that are put in order together.
RANGE = 1 << 9


def with_sketch(rows: DataFrame, text: str, out: str, size: int = SHINGLE, k: int = K) -> DataFrame:
    """``rows`` with the sketch of column ``text``, in steps, so that each is computed once.

    Words are runs of other signs than white space (0x20, 0x09-0x0D), in lower case. A text of fewer words than
    a shingle has one shingle, the whole sequence; without words (or null) its sketch is empty.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\t-\r]+"), lambda w: w != "")
    rows = rows.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    of = F.col("_words")
    whole = F.when(F.size(of) > 0, F.array(F.xxhash64(of))).otherwise(F.array().cast("array<bigint>"))
    hashes = F.when(F.size(of) < size, whole).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(of) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(of, i + j) for j in range(size)))))
    return rows.withColumn("_hashes", hashes).withColumn(out, sketch(F.col("_hashes"), k)).drop("_words", "_hashes")


def sketch(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together; equals that of their union."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_shingles(own: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else by the place of the k-th smallest hash."""
    share = (F.element_at(own, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(own) < k, F.size(own).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the smallest ``k`` of both that both hold. Two empty sketches are alike."""
    both = merged(a, b, k)
    held = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(held.cast("double") / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    union = distinct_shingles(merged(a, b, k), k)
    common = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def fingerprint(own: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(own, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def in_turn(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, sketch, next_sketch: each row with what follows it in descending doc_id; the first follows the last.

    Rows of one doc_id are in the order of their texts; a null doc_id comes last. The ids are cut in
    ranges, which are put in order one by one; only the first row of a range is carried to the one ahead of it.
    """
    none = -(1 << 62)
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "range", F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(none)))
    inside = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), F.asc("text"))
    rows = with_sketch(ranged.withColumn("_row", F.row_number().over(inside)), "text", "sketch")
    led = rows.withColumns({"_text": F.lead("text").over(inside), "_sketch": F.lead("sketch").over(inside)})

    spans = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("_n")).withColumn("far", F.floor(F.col("range") / RANGE))
    near = Window.partitionBy("far").orderBy(F.desc("range"))
    # One row per RANGE * RANGE numbers is few enough to be put in order by one task.
    over = Window.orderBy(F.desc("far"))
    far = spans.groupBy("far").agg(F.max("range").alias("top"))
    far = far.withColumn("below", F.coalesce(F.lead("top").over(over), F.first("top").over(over)))
    follow = spans.withColumn("after", F.lead("range").over(near)).join(far, "far").select(
        F.col("range"), F.coalesce("after", "below").alias("after"))
    heads = ranged.withColumn("_row", F.row_number().over(inside)).filter(F.col("_row") == 1).select(
        F.col("range").alias("after"), F.col("text").alias("head"))
    joined = led.join(follow.join(heads, "after").drop("after"), "range", "left")
    last = F.when(F.col("_text").isNull(), F.col("head"))
    done = with_sketch(joined.withColumn("head", last), "head", "_head")
    return done.select("doc_id", "text", F.coalesce("_text", "head").alias("next_text"), "sketch",
                       F.coalesce("_sketch", "_head").alias("next_sketch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct of every row of ``docs``.

    The edited text has its last third of code points (rounded down) replaced by
    as many, or all, of the first of the next document in descending doc_id. A null text counts
    as empty; two texts without words are alike (1), a text without words and another are not (0).
    """
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = in_turn(docs).withColumn("n_chars", F.char_length("text"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_distinct"))
