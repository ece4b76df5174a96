"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors are the pivots. Each vector is represented by its
``PREFIX`` nearest pivots in order, and posted with its place in the inverted
file of each. The index is cut into segments of bounded size by vec_id. A query is answered
in every segment: the inverted files of its own pivots add up, for each vector, how near the two orders are by
Spearman's footrule; the best ``SHARE`` of the segment is ranked again by exact inner products, and the best ``k`` of
all segments are the answer. All rows are indexed. Equal vectors of a segment are ranked
once and answer with their smallest ids, so copies can't crowd out others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import materialize

#: Pivots, drawn from the distinct vectors by hash; they are what is collected and sent to all tasks.
PIVOTS = 512
PREFIX = 64
#: Vectors of a segment, and queries that one task answers in it.
SEGMENT = 8192
QUERIES = 1024
#: Share of a segment that is ranked again, and the fewest vectors.
SHARE = 1 / 7
LEAST = 320


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) with one row for each vec_id: those without null, NaN or infinite components and not all zero.

    Of several vectors of one vec_id the smallest counts; vectors of another
    dimension than most have take no part, nor do rows without vec_id.
    """
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    sizes = own.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return own.filter(F.size("vector") == (sizes[0]["dim"] if sizes else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def pivots_of(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    distinct = vectors.select("vector").distinct().withColumn("place", F.xxhash64("vector"))
    rows = distinct.orderBy("place", "vector").limit(count).select("vector").toArrow()["vector"].to_pylist()
    return np.array(rows, "float64").reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def indexed(vectors: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """(vec_id, vector, near): ``near`` has the places of the nearest pivots in order, ties to the earlier pivot."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = _matrix(pa.chunked_array([batch.column("vector")]))
                near = np.argsort(-(own @ pivots.T), axis=1, kind="stable")[:, :prefix].astype("int16")
                flat = pa.array(np.ascontiguousarray(near).ravel())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.FixedSizeListArray.from_arrays(flat, near.shape[1]).cast(pa.list_(pa.int16()))],
                    ["vec_id", "vector", "near"])

    return vectors.mapInArrow(run, "vec_id long, vector array<double>, near array<smallint>")


class InvertedFiles:
    """Postings of a segment: by pivot, the vectors that have it among their nearest, with its place there."""

    def __init__(self, near: np.ndarray, pivots: int) -> None:
        self.prefix = near.shape[1]
        order = np.argsort(near.ravel(), kind="stable")
        self.vector = order // self.prefix
        self.place = order % self.prefix
        self.begin = np.r_[0, np.cumsum(np.bincount(near.ravel(), minlength=pivots))]
        self.count = len(near)

    def nearness(self, query: np.ndarray) -> np.ndarray:
        """By vector, how much smaller its footrule distance to the query is than that of orders without a common pivot.

        A pivot missing from an order counts as at its end, so the distance falls by twice the places that are left after the later of the two.
        """
        lo, hi = self.begin[query], self.begin[query + 1]
        size = hi - lo
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        later = np.maximum(np.repeat(np.arange(len(query)), size), self.place[at])
        return np.bincount(self.vector[at], 2.0 * (self.prefix - later), minlength=self.count)


def _answers(queries: pa.Table, segment: pa.Table, pivots: int, k: int) -> pa.Table:
    """Best ``k`` of a segment for each query of a task."""
    out_query, out_vec, out_score = [], [], []
    if queries.num_rows and segment.num_rows:
        segment = segment.sort_by("vec_id")
        ids, vectors = segment["vec_id"].to_numpy(), _matrix(segment["vector"])
        rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, kind = np.unique(rows, return_index=True, return_inverse=True)
        members = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
        distinct = vectors[first]
        files = InvertedFiles(_matrix(segment["near"])[first], pivots)
        wanted = min(len(first), max(LEAST, int(np.ceil(SHARE * len(first)))))
        for query, vector, near in zip(queries["vec_id"].to_pylist(), _matrix(queries["vector"]), _matrix(queries["near"]), strict=True):
            found = np.argpartition(-files.nearness(near), wanted - 1)[:wanted]
            score = distinct[found] @ vector
            best = []
            for at in np.lexsort((ids[first[found]], -score)).tolist():
                # The smallest k + 1 ids of equal vectors are enough, one of which may be the query's own.
                best += [(-score[at], i) for i in ids[members[found[at]][: k + 1]].tolist() if i != query]
                if len(best) >= k and score[at] < -sorted(best)[k - 1][0]:
                    break
            for minus, i in sorted(best)[:k]:
                out_query.append(query)
                out_vec.append(i)
                out_score.append(-minus)
    return pa.table({"query_id": pa.array(out_query, pa.int64()), "vec_id": pa.array(out_vec, pa.int64()), "score": pa.array(out_score, pa.float64())})


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by inner product of each query, a vec_id divisible by ``every``.

    ``vectors`` has vec_id and embedding; for what takes no part see ``usable``.
    A query without any other vector has no rows, and an empty table or one without usable vectors gives none. Ties are ranked by vec_id.
    """
    own = usable(vectors)
    pivots = pivots_of(own)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = materialize(indexed(own, pivots), "permutations")
    segments = max(1, -(-index.count() // SEGMENT))
    asked = index.filter(F.col("vec_id") % every == 0)
    parts = max(1, -(-asked.count() // QUERIES))
    place = F.xxhash64("vec_id")
    left = asked.withColumn("part", F.pmod(place, F.lit(parts))).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    right = index.withColumn("segment", F.pmod(place, F.lit(segments)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    count = len(pivots)

    def answer(queries: pa.Table, segment: pa.Table) -> pa.Table:
        return _answers(queries, segment, count, k)

    found = left.groupBy("segment", "part").cogroup(right.groupBy("segment", "part")).applyInArrow(
        answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
