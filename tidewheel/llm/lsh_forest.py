"""Near duplicates on word shingles, by an LSH forest over MinHash signatures.

Each of ``TREES`` trees orders all distinct sets by the minima of its own hash functions, one after the other. Sets that share a long
prefix of such an order are neighbours. How long it must be is settled region by region: a region is all sets with one prefix, and
while it holds over ``REGION`` sets it is parted by one more minimum, down to a depth at which two sets at the similarity still
share a region in some tree but for a chance of ``MISS``. The sets of a region of bounded size are compared by their signatures, and only those
whose agreement leaves the similarity open are candidates; larger regions at the last depth are candidates as a whole. So no region is cut
short, and no pair is listed: candidates are the components of a graph with an edge for each set of a region.

Candidates are confirmed on whole sets by counting common shingles, with large components cut by set size and into parts that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.components import connected_components
from tidewheel.llm.hashing import mix, shingle_hashes, word_hashes
from tidewheel.llm.ngram_join import _tasks, node_of, small, verified
from tidewheel.session import materialize

#: Trees, and the chance that two sets at the similarity share no region of any tree at the last depth.
TREES, MISS = 32, 1e-5
#: Levels above the last one at which a region of few sets ends already.
REACH = 2
#: Sets of a region that are compared by their signatures; a larger region is parted.
REGION = 64
#: Bytes of a signature, one for each minimum, and how many deviations a pair's agreement may be under the similarity.
MARKS, DEVIATIONS = 128, 6.3
#: Bytes of a minimum in an order.
LANE = 2


def depths(least: Fraction) -> tuple[int, int]:
    """First and last depth of regions."""
    last = 1
    while (1 - float(least) ** (last + 1)) ** TREES <= MISS:
        last += 1
    return max(1, last - REACH), last


def least_agreement(least: Fraction) -> int:
    """Equal bytes of two signatures under which their sets are not similar."""
    share = float(least) + (1 - float(least)) / 256
    return int(MARKS * share - DEVIATIONS * (MARKS * share * (1 - share)) ** 0.5)


def can_link(size: int, least: Fraction) -> bool:
    """Whether a set of this size can be similar to any other one."""
    return size * least.denominator >= (size + 1) * least.numerator


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The least values of ``count`` hash functions over each of the sets, none of them empty, as a row for each set."""
    sizes = np.array([len(s) for s in sets])
    values = (np.concatenate(sets) >> np.uint64(32)).astype("uint32")
    begin = np.cumsum(sizes) - sizes
    seeds = mix(np.arange(1, count + 1, dtype="uint64"))
    out = np.empty((len(sets), count), "uint32")
    for j, seed in enumerate(seeds.tolist()):
        out[:, j] = np.minimum.reduceat(values * np.uint32(seed >> 32 | 1) + np.uint32(seed & 0xFFFFFFFF), begin)
    return out ^ out >> np.uint32(16)


def signatures(docs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """doc_id, n_shingles, node, orders and marks of every row; a set that can't be similar to another one has no orders."""
    lanes = TREES * depths(least)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            words, bounds = word_hashes(batch.column("text"))
            sets = [s for s, _ in shingle_hashes(words, bounds, size)]
            rows = [k for k, s in enumerate(sets) if can_link(len(s), least)]
            orders: list[bytes | None] = [None] * len(sets)
            marks: list[bytes | None] = [None] * len(sets)
            if rows:
                found = minima([sets[k] for k in rows], max(lanes, MARKS))
                wide, narrow = found[:, :lanes].astype(">u2"), found[:, :MARKS].astype("uint8")
                for at, k in enumerate(rows):
                    orders[k], marks[k] = wide[at].tobytes(), narrow[at].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()),
                 pa.array(orders, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "node", "orders", "marks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, orders binary, marks binary")


def regions(nodes: DataFrame, least: Fraction) -> tuple[DataFrame, DataFrame]:
    """(region, node) of the regions that end with few sets, and (node, root) edges of those that stay large at the last depth."""
    first, last = depths(least)
    width = LANE * last
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.cast("byte").alias("tree"), F.substring("orders", t * width + 1, F.lit(width)).alias("order")))
    rows = nodes.select("node", F.inline(trees))
    ended = None
    for depth in range(first, last + 1):
        named = rows.withColumn("region", F.xxhash64("tree", F.lit(depth), F.substring("order", 1, LANE * depth)))
        sizes = named.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("root")).filter("size > 1")
        met = materialize(named.join(sizes, "region"), f"depth-{depth}")
        few = met.filter(F.col("size") <= REGION).select("region", "node")
        ended = few if ended is None else ended.union(few)
        rows = met.filter(F.col("size") > REGION).select("node", "tree", "order", "root")
        if depth < last:
            rows = rows.drop("root")
    return ended, rows.filter(F.col("node") != F.col("root")).select("node", "root")


def _linked(nodes: np.ndarray, marks: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of regions of one size: ``nodes`` has a row for each region, ``marks`` one more axis.

    The root is the first set of the region that agrees with the node directly or over others.
    """
    size = nodes.shape[1]
    near = np.stack([(marks == marks[:, j: j + 1]).sum(axis=2, dtype="int32") >= enough for j in range(size)], axis=2)
    label = np.broadcast_to(np.arange(size), nodes.shape)
    while True:
        lower = np.where(near, label[:, None, :], size).min(axis=2)
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(size)
    return nodes[moved], np.take_along_axis(nodes, label, 1)[moved]


def agreeing(members: DataFrame, least: Fraction) -> DataFrame:
    """(node, root) edges between the sets of each region (region, node, marks) whose signatures leave the similarity open."""
    enough = least_agreement(least)
    rows = members.groupBy("region").agg(F.collect_list("node").alias("nodes"), F.collect_list("marks").alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, held = batch.column("nodes"), batch.column("marks").flatten().cast(pa.binary(MARKS))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            nodes = lists.flatten().to_numpy()
            marks = np.frombuffer(held.buffers()[1], "uint8").reshape(-1, MARKS)[held.offset: held.offset + len(held)]
            sizes = np.diff(at)
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for size in np.unique(sizes[sizes > 1]).tolist():
                firsts = at[:-1][sizes == size]
                step = max(1, (1 << 22) // (size * MARKS))
                for lo in range(0, len(firsts), step):
                    place = firsts[lo: lo + step, None] + np.arange(size)
                    ends.append(_linked(nodes[place], marks[place], enough))
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in ends])) for k in (0, 1)], ["node", "root"])

    return rows.mapInArrow(run, "node long, root long")


def near_duplicates(docs: DataFrame, size: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links, component_id and kept of every row of ``docs`` (doc_id, text; more columns are ignored).

    Documents link when the Jaccard similarity of their distinct ``size``-word shingles is at least ``least``. ``class_id`` is the
    smallest doc_id with the same set, ``n_links`` the number of other sets that it links to, ``component_id`` the smallest
    doc_id reachable by links; a document is ``kept`` if it is that one. A null or wordless text has no shingles, links with
    nothing and is kept. Rows with one doc_id are taken as separate texts of that id; a row without doc_id gets its counts, takes no part in links,
    has no component and is kept. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, size, least), "signatures")
    known = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(known.groupBy("node", "n_shingles").agg(
        F.min("doc_id").alias("class_id"), F.first("orders").alias("orders"), F.first("marks").alias("marks")), "classes")
    open_sets = classes.filter(F.col("orders").isNotNull())
    ended, dense = regions(open_sets.select("node", "orders"), least)
    near = agreeing(ended.join(open_sets.select("node", "marks"), "node"), least)
    blocks = connected_components(near.union(dense).distinct(), "blocks")
    placed = classes.select("node", F.col("class_id").alias("doc_id"), F.col("n_shingles").alias("n")).join(
        blocks.withColumnRenamed("component", "block"), "node")
    tasks = materialize(_tasks(placed, least), "tasks")
    checked = materialize(verified(docs, tasks, size, least), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = connected_components(checked.filter(F.col("node") != F.col("root")).select("node", "root"), "components")
    names = classes.select("node", "class_id")
    reached = joined.join(names, "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    found = names.join(links, "node", "left").join(joined, "node", "left").join(reached, "component", "left").select(
        "node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    with_words = known.join(found, "node").select("doc_id", "n_shingles", "class_id", "n_links", "component_id")
    rest = signed.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return with_words.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
