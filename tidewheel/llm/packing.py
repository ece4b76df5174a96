"""Best-fit packing of documents into sequences of a fixed number of tokens, by exact complements.

Only the number of pieces of each length matters for the plan, so it is made from a histogram with as many entries as a
sequence has tokens, whatever the corpus size. The longest piece left opens a sequence; its gap is looked up among the lengths,
pair sums and triple sums that are available, and the combination that fills it exactly is used as often as the
counts allow. Where none does, the longest piece that fits goes in and the new gap
is looked up (best fit). Pieces then learn their place by their number among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.encoder import Encoder, texts_of
from tidewheel.session import materialize

CAPACITY = 2048
#: Id that ends a document.
END = 0
#: Parts that the pieces of one length are numbered in.
PARTS = 64
_CHUNK = 4096


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; longer documents are cut so that the first piece is the short one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows, owner = [], []
            for k, ids in enumerate(encoder.encode(texts_of(batch.column("text")))):
                ids = np.append(ids, END).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for n, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((n, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                    owner.append(k)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), *columns],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Available pieces by length, and what combination fills a gap exactly."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype("int64")

    def _pair(self, gap: int, free: np.ndarray) -> tuple[int, int] | None:
        """Two lengths with this sum, the longest first."""
        low, high = np.arange(1, gap // 2 + 1), gap - np.arange(1, gap // 2 + 1)
        both = np.flatnonzero((free[low] > 0) & (free[high] > 0) & ((low != high) | (free[low] > 1)))
        return (int(high[both[0]]), int(low[both[0]])) if len(both) else None

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        free = self.left.copy()
        for length, n in used.items():
            free[length] -= n
        if free[gap] > 0:
            return (gap,)
        if pair := self._pair(gap, free):
            return pair
        for first in np.flatnonzero(free[: gap - 1] > 0)[::-1].tolist():
            free[first] -= 1
            pair = self._pair(gap - first, free)
            free[first] += 1
            if pair:
                return first, *pair
        return None

    def longest(self, gap: int, used: Counter) -> int:
        fits = np.flatnonzero(self.left[: gap + 1] > 0)[::-1]
        return next((int(n) for n in fits.tolist() if self.left[n] > used[n]), 0)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); ``counts[n]`` pieces of length n, 0 < n <= capacity."""
    stock, out = _Stock(counts), []
    top = capacity
    while True:
        while top and not stock.left[top]:
            top -= 1
        if not top:
            return out
        used, gap = Counter([top]), capacity - top
        while gap:
            if fill := stock.exact(gap, used):
                used.update(fill)
                break
            if not (more := stock.longest(gap, used)):
                break
            used[more] += 1
            gap -= more
        times = min(int(stock.left[n]) // k for n, k in used.items())
        for n, k in used.items():
            stock.left[n] -= k * times
        out.append((tuple(sorted(used.elements(), reverse=True)), times))


def _slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, sequence, offset): pieces numbered from..to-1 of a length go to sequence + number - from."""
    seen: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in found:
        offset = 0
        for n in lengths:
            rows.append((n, seen[n], seen[n] + times, sequence, offset))
            seen[n] += times
            offset += n
        sequence += times
    return rows


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``number``, from 0 within their length; each length is numbered in parts, so none is one task's."""
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return parted.withColumn("row", F.row_number().over(own)).join(F.broadcast(begins), ["length", "part"]).withColumn(
        "number", F.col("begin") + F.col("row") - 1).drop("part", "begin", "row")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs`` (doc_id, text).

    A null or empty text is one piece of the end id. Rows with one doc_id are packed
    as separate documents. No rows give no pieces.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, tokenizer, capacity), "pieces")
    counts = np.zeros(capacity + 1, "int64")
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    # At most a row for each use of a length, and each use empties a length or leaves fewer than a sequence takes of it.
    slots = spark.createDataFrame(_slots(plan(counts, capacity)), "length long, first long, last long, sequence long, offset long")
    # One row per piece and use, made in the tasks: chunks first, so that no task makes all rows of a long run.
    chunks = slots.withColumn("at", F.explode(F.sequence("first", F.col("last") - 1, F.lit(_CHUNK)))).repartition(F.col("length"), F.col("at"))
    places = chunks.withColumn("number", F.explode(F.sequence("at", F.least(F.col("at") + _CHUNK, F.col("last")) - 1)))
    return numbered(pieces).join(places, ["length", "number"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset")
