"""Similarity self-join of documents on word shingles, by token-combination prefixes.

Shingles (64-bit hashes) have one global order: rarest words first, and those last that turned out to recur in
a first round of such prefixes. Two sets that reach the similarity differ in at most
``m`` shingles of either one, so a prefix of ``m + 1`` shingles would do to meet.
A frequent shingle makes a bucket of its own too large to say much; frequent ones
are therefore indexed by pairs: the frequent shingles of a prefix fall into
``groups`` classes by hash, and each pair within a class is a key. ``c``
shingles of one class still hold a common pair unless ``c - 1`` of them are
lost, so the prefix is extended by one shingle a class. Rare shingles are keys
by themselves, and shingles that only one document has are none.

Documents that share a key are put in one block (connected components over
keys, so no pair is listed). Blocks over a weight are cut along a second set of
keys: the shingles of a whole set fall into more classes by hash than two similar sets
can differ in, and all shingles of a class together are a key. Each block is then verified exactly by
counting common shingles, over whole sets. What is still over the weight is cut by
set size, and again into parts of which each two meet in one task. A task
returns, for each set, the root it is linked to and its number of links.

Keys that many rows have to meet on are taken in parts, by their lowest bits, one after the other: what a part shuffles is gone
before the next one begins, and tables that were read for the last time are removed. So the disk holds a share of the keys at a time, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bitmaps import maybe_in
from tidewheel.llm.components import connected_components
from tidewheel.llm.hashing import mix, shingle_hashes, signed, word_hashes
from tidewheel.session import forget, materialize, settle, together

#: Recurring shingles that can be moved to the end of the order: those of the most documents.
MAX_LATE = 1 << 21
#: Prefixes of the first round that hold such a shingle, and how many times longer these prefixes are.
LATE_FROM, LATE_REACH = 2, 2
#: Words with this share of all words have a known frequency, so 2**16 of them at most; the others count as rarer.
WORD_SHARE = Fraction(1, 2**16)
#: Documents whose prefixes hold a shingle, from which on it is indexed by pairs.
FREQUENT = 8
#: Shingles of all sets of one verification task.
TASK_WEIGHT = 1 << 21
#: Keys of one part, but for tables of more than ``PARTS`` such parts. A power of two.
PART_KEYS, PARTS = 1 << 21, 8
#: Parts of the shingles that the order counts at most, each of which takes a pass over the texts. A power of two.
ORDER_PARTS = 2
#: Shingles of the texts that one part of the verification reads at least.
PART_WEIGHT = 1 << 23
_PAIR = np.uint64(0xA0761D6478BD642F)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, as hashes and their sums take several times the memory of a text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        words, bounds = word_hashes(batch.column("text"))
        yield batch, [s for s, _ in shingle_hashes(words, bounds, size)]


def node_of(shingles: np.ndarray) -> int:
    """64-bit name of a set, so equal sets are one node from the start."""
    return int(np.add.reduce(mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))).view("int64")) if len(shingles) else 0


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(small(batches), size):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_of(s) for s in sets], pa.int64())], ["doc_id", "n_shingles", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long")


@dataclass(frozen=True)
class Order:
    """What the global order of shingles is made from; both parts have a bounded size."""

    words: np.ndarray  # hash of a known word by slot
    rarity: np.ndarray  # its rarity, in bits
    heavy: np.ndarray  # recurring shingles, which come last, ascending

    def points(self, words: np.ndarray) -> np.ndarray:
        slot = (words >> np.uint64(64 - SLOT_BITS)).astype("int64")
        return np.where(self.words[slot] == words, self.rarity[slot], UNKNOWN)

    def keys(self, shingles: np.ndarray, points: np.ndarray) -> np.ndarray:
        """A number for each shingle that sorts like the order."""
        first = np.minimum(np.uint64(1) << np.uint64(8), points.astype("uint64"))
        keys = (np.uint64(511) - first) << np.uint64(54) | shingles >> np.uint64(10)
        if len(self.heavy):
            late = self.heavy[np.minimum(np.searchsorted(self.heavy, shingles), len(self.heavy) - 1)] == shingles
            keys[late] |= np.uint64(1) << np.uint64(63)
        return keys


SLOT_BITS = 18
UNKNOWN = 20


def word_order(docs: DataFrame) -> Order:
    """An order by the rarity of words, from lossy counts of all words of the corpus.

    Each block of rows names what reaches the share within it, and these counts are
    added up; what reaches the share in the corpus does so in some block. The order only steers the work, never the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(4.0, float(WORD_SHARE) * counts.sum())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([signed(keys[keep]), pa.array([None], pa.int64())]),
                                               pa.array(np.r_[counts[keep], counts.sum()], pa.int64())], ["word", "n"])

        weight = 0
        for batch in small(batches):
            held.append(word_hashes(batch.column("text"))[0])
            weight += len(held[-1])
            if weight >= 1 << 22:
                yield flush()
                weight = 0
        if weight:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # The row without word holds the total, and at most 1 / WORD_SHARE others reach a share of it.
    rows = counts.orderBy(F.desc("n"), "word").limit(WORD_SHARE.denominator + 1).toArrow()
    n, total_row = rows["n"].to_numpy(), rows["word"].is_null().to_numpy()
    keep = ~total_row & (n >= float(WORD_SHARE) * n[total_row].sum())
    words = rows["word"].fill_null(0).to_numpy().view("uint64")[keep][::-1]
    slot = (words >> np.uint64(64 - SLOT_BITS)).astype("int64")
    order = Order(np.zeros(1 << SLOT_BITS, "uint64"), np.zeros(1 << SLOT_BITS, "int64"), np.zeros(0, "uint64"))
    order.words[slot], order.rarity[slot] = words, np.round(-np.log2(n[keep][::-1] / max(n[total_row].sum(), 1)))
    return order


def part_count(keys: int, each: int, most: int) -> int:
    """Parts of ``each`` keys, as a power of two."""
    return min(most, 1 << max(-(-keys // each) - 1, 0).bit_length())


def in_parts(parts: int, make: Callable[[int], DataFrame], label: str) -> DataFrame:
    """``make`` of each part, stored one after the other, as one table. What a part shuffled goes before the next one."""
    found = []
    for part in range(parts):
        found.append(materialize(make(part), label))
        if parts > 1:
            settle(found[-1].sparkSession)
    return together(found)


def of_part(values: np.ndarray, part: int, parts: int) -> np.ndarray:
    """By the lowest bits, as the order prefers shingles with high bits of zero."""
    return values if parts == 1 else values[values & np.uint64(parts - 1) == np.uint64(part)]


def shingle_order(docs: DataFrame, size: int, least: Fraction, weight: int) -> Order:
    """The word order with the shingles at its end that recur in prefixes under it, those of most documents first.

    So a passage that documents share is no part of their prefixes, as long as they have enough shingles of their own.
    ``weight`` is the number of shingles of all sets.
    """
    order = word_order(docs)
    parts = part_count(LATE_REACH * prefix_length(weight, least), PART_KEYS, ORDER_PARTS)
    late = in_parts(parts, lambda part: prefixes(docs, size, least, order, LATE_REACH, part, parts).groupBy("token").agg(
        F.count(F.lit(1)).alias("df")).filter(F.col("df") >= LATE_FROM), "late")
    heavy = late.orderBy(F.desc("df"), "token").limit(MAX_LATE).select("token").toArrow()
    forget(late)
    return replace(order, heavy=np.sort(heavy["token"].to_numpy().view("uint64")))


def most_missing(size: int, least: Fraction) -> int:
    """Shingles of a set of this size that a similar set may lack."""
    return size - -(-size * least.numerator // least.denominator)


def group_levels(size: int, least: Fraction) -> list[int]:
    """Powers of two: the class counts under which a set of this size can meet a similar one.

    The smaller of two sets sets the count, and is at least ``least`` of this one.
    """
    smallest = -(-size * least.numerator // least.denominator)
    low, high = (max(most_missing(n, least), 4).bit_length() - 3 for n in (smallest, size))
    return list(range(low, high + 1))


def prefix_length(size: int, least: Fraction) -> int:
    return min(size, most_missing(size, least) + 1 + 2 ** group_levels(size, least)[-1])


def prefixes(docs: DataFrame, size: int, least: Fraction, order: Order, times: int = 1, part: int = 0, parts: int = 1) -> DataFrame:
    """(token, node, n) of each document's prefix, or of one ``times`` as long; a node that recurs within a batch comes once.

    Of several ``parts``, only the tokens of one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            words, bounds = word_hashes(batch.column("text"))
            found: dict[int, tuple[int, np.ndarray]] = {}
            for shingles, points in shingle_hashes(words, bounds, size, order.points(words)):
                if len(shingles) and (node := node_of(shingles)) not in found:
                    reach = min(len(shingles), times * prefix_length(len(shingles), least))
                    first = np.argpartition(order.keys(shingles, points), reach - 1)[:reach]
                    found[node] = len(shingles), of_part(shingles[first], part, parts)
            if found:
                reach = [len(t) for _, t in found.values()]
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate([t for _, t in found.values()])), pa.array(np.repeat(np.array(list(found)), reach)),
                     pa.array(np.repeat([n for n, _ in found.values()], reach), pa.int32())], ["token", "node", "n"])

    return docs.select("text").mapInArrow(run, "token long, node long, n int")


def pair_keys(frequent: DataFrame, least: Fraction) -> DataFrame:
    """(key, node) for each pair of a node's frequent prefix shingles that fall into one class."""
    per_node = frequent.groupBy("node", "n").agg(F.collect_set("token").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for node, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
                own = np.sort(np.array(tokens, "int64").view("uint64"))
                spread = mix(own)
                for level in group_levels(n, least):
                    group = spread >> np.uint64(64 - level) if level else np.zeros(len(own), "uint64")
                    for g in np.unique(group):
                        members = own[group == g]
                        i, j = np.triu_indices(len(members), 1)
                        keys.append(mix(members[i] * _PAIR + members[j] + np.uint64(level)))
                        nodes += [node] * len(i)
            if keys:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(nodes, pa.int64())], ["key", "node"])

    return per_node.mapInArrow(run, "key long, node long")


def _first_of_key(postings: DataFrame, key: str) -> DataFrame:
    """Keys that two nodes share, with their number of postings and smallest node (aggregated before the shuffle)."""
    return postings.groupBy(key).agg(
        F.count(F.lit(1)).alias("df"), F.min("node").alias("root"), F.max("node").alias("_last")
    ).filter(F.col("root") != F.col("_last")).drop("_last")


def _shared(postings: DataFrame, key: str) -> DataFrame:
    """Stored: the postings whose key is in several ones. Most keys are in one only: they go before nodes are looked at."""
    again = materialize(postings.groupBy(key).agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1).select(key), "again")
    shared = materialize(postings.join(again, key, "left_semi"), "shared")
    forget(again)
    return shared


def _edges(shared: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """(node, root) edges, each once, that join all nodes sharing one of the keys of ``firsts``."""
    met = shared.join(firsts.select(key, "root"), key).filter(F.col("node") != F.col("root"))
    return met.select("node", "root").distinct()


def edges_in_parts(postings: DataFrame, key: str, frequent: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Stored: (node, root) edges that join all nodes sharing a key of the stored postings, and the postings of the frequent keys instead.

    Keys of ``frequent`` postings or more, of two nodes at least, are frequent ones; without that number none is.
    """
    parts = part_count(postings.count(), PART_KEYS, PARTS)
    edges, often = [], []
    for part in range(parts):
        shared = _shared(postings if parts == 1 else postings.filter(F.col(key).bitwiseAND(F.lit(parts - 1)) == part), key)
        firsts = _first_of_key(shared, key)
        edges.append(materialize(_edges(shared, firsts if frequent is None else firsts.filter(F.col("df") < frequent), key), "edges"))
        if frequent is not None:
            often.append(materialize(shared.join(firsts.filter(F.col("df") >= frequent).select(key), key, "left_semi"), "frequent"))
        forget(shared)
        if parts > 1:
            settle(postings.sparkSession)
    return together(edges), together(often) if often else None


def candidate_blocks(docs: DataFrame, size: int, least: Fraction, weight: int) -> DataFrame:
    """(node, component) of all nodes that share a key with another one. ``weight`` is the number of shingles of all sets."""
    postings = materialize(prefixes(docs, size, least, shingle_order(docs, size, least, weight)), "prefixes")
    single, often = edges_in_parts(postings, "token", FREQUENT)
    forget(postings)
    pairs = materialize(pair_keys(often, least), "pairs")
    forget(often)
    paired, _ = edges_in_parts(pairs, "key")
    forget(pairs)
    blocks = connected_components(single.union(paired), "blocks")
    forget(single, paired)
    return blocks


def most_different(smaller: int, least: Fraction) -> int:
    """Shingles that two similar sets can differ in, the smaller one having this many."""
    return smaller * (least.denominator - least.numerator) // least.numerator


def class_counts(size: int, least: Fraction) -> list[int]:
    """Class counts under which a set meets similar ones: in steps of a quarter, each above what a pair can differ in."""
    def step(smaller: int) -> int:
        classes = 2
        while classes <= most_different(smaller, least):
            classes = -(-classes * 5 // 4)
        return classes

    lowest = -(-size * least.numerator // least.denominator)
    counts, top = [step(lowest)], step(size)
    while counts[-1] < top:
        counts.append(-(-counts[-1] * 5 // 4))
    return counts


def whole_classes(docs: DataFrame, wanted: DataFrame, size: int, least: Fraction, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, node) of the ``wanted`` nodes: all shingles of a class together, for each class of the whole set.

    With more classes than two similar sets can differ in, one class is the same in both. Classes that a set has nothing
    in are keys only for sets with too few others. Of several ``parts``, only the keys of one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(small(batches), size):
            found: dict[int, np.ndarray] = {}
            for s in sets:
                if not len(s) or (node := node_of(s)) in found:
                    continue
                spread, keys = mix(s ^ _PAIR), []
                for classes in class_counts(len(s), least):
                    of = spread % np.uint64(classes)
                    own, begin = np.unique(np.sort(of), return_index=True)
                    sums = np.add.reduceat(spread[np.argsort(of, kind="stable")], begin)
                    if len(own) <= most_different(len(s), least):
                        own = np.arange(classes, dtype="uint64")
                        full = np.zeros(classes, "uint64")
                        full[np.unique(of)] = sums
                        sums = full
                    keys.append(mix(sums + own * _PAIR + np.uint64(classes)))
                found[node] = of_part(np.concatenate(keys), part, parts)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(list(found.values()))),
                     pa.array(np.repeat(np.array(list(found)), [len(k) for k in found.values()]))], ["key", "node"])

    rows = docs.filter(maybe_in(wanted, "doc_id")).select("text").mapInArrow(run, "key long, node long")
    return rows.join(wanted.select("node"), "node", "left_semi")


def refined(placed: DataFrame, docs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """``placed`` (node, doc_id, n, block) with blocks over ``TASK_WEIGHT`` cut along the components of a second set of keys.

    Prefixes let a block grow by chance along many texts; two sets must meet in both sets of keys to be similar.
    """
    weights = placed.groupBy("block").agg(F.sum("n").alias("weight"))
    sized = materialize(placed.join(weights, "block"), "sized")
    large = sized.filter(F.col("weight") > TASK_WEIGHT).drop("weight")
    parts = part_count(large.agg(F.sum("n")).first()[0] or 0, PART_KEYS, PARTS)
    found = []
    for part in range(parts):
        keys = materialize(whole_classes(docs, large, size, least, part, parts), "classes")
        shared = _shared(keys, "key")
        forget(keys)
        found.append(materialize(_edges(shared, _first_of_key(shared, "key"), "key"), "edges"))
        forget(shared)
        if parts > 1:
            settle(docs.sparkSession)
    edges = together(found)
    components = connected_components(edges, "finer")
    forget(edges)
    finer = large.join(components, "node").withColumn("block", F.xxhash64("block", "component"))
    return sized.filter(F.col("weight") <= TASK_WEIGHT).select("node", "doc_id", "n", "block").union(
        finer.select("node", "doc_id", "n", "block"))


def _links(sets: list[np.ndarray], barred: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Exact links of a task's sets: root (place) and number of links of each.

    ``barred`` has a row for each reason why two sets don't meet here: they don't if they have one positive number in it.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    by_token = np.argsort(token, kind="stable")
    begin = np.r_[0, np.cumsum(np.bincount(token))]
    posting = owner[by_token]
    rank = np.empty(len(token), "int64")
    rank[by_token] = np.arange(len(token))
    root, degree = np.arange(len(sets)), np.zeros(len(sets), "int64")

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    at = np.r_[0, np.cumsum(sizes)]
    for x in range(1, len(sets)):
        lo, hi = begin[token[at[x]: at[x + 1]]], rank[at[x]: at[x + 1]]  # postings of the sets ahead of x
        reach = hi - lo
        if not reach.any():
            continue
        steps = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        common = np.bincount(posting[np.repeat(lo, reach) + steps], minlength=x)
        near = np.flatnonzero(least.denominator * common >= least.numerator * (sizes[x] + sizes[:x] - common))
        near = near[~((barred[:, near] == barred[:, x: x + 1]) & (barred[:, near] > 0)).any(axis=0)]
        degree[x] += len(near)
        degree[near] += 1
        for y in near.tolist():
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    return np.array([find(x) for x in range(len(sets))], "int64"), degree


def _size_class(least: Fraction) -> Column:
    """Sets of one class or of neighbouring ones are the only ones whose sizes allow a link."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(float(least)) * (1 + 1e-9))))


def _tasks(blocks: DataFrame, least: Fraction) -> DataFrame:
    """Assign nodes to verification tasks (block, cls, i, j): any two that may link meet once with one of them ``new``.

    A block within ``TASK_WEIGHT`` is one task. A larger one is cut by set size;
    a class meets itself and, as ``old``, comes along to the next class. Too large
    ones are cut into parts of which each two meet in a task.
    """
    weights = blocks.groupBy("block").agg(F.sum("n").alias("weight"))
    sized = blocks.join(weights, "block")
    small = sized.filter(F.col("weight") <= TASK_WEIGHT).select(
        "doc_id", "node", "block", F.lit(0).cast("long").alias("cls"), F.lit(0).alias("i"), F.lit(0).alias("j"),
        F.lit(0).alias("part"), F.lit(False).alias("old"))
    own = sized.filter(F.col("weight") > TASK_WEIGHT).withColumn("cls", _size_class(least)).drop("weight")
    roles = own.withColumn("old", F.lit(False)).union(own.withColumns({"cls": F.col("cls") + 1, "old": F.lit(True)}))
    load = roles.groupBy("block", "cls").agg(
        F.ceil(F.sum("n") / (TASK_WEIGHT // 2)).cast("int").alias("parts"),
        F.min("old").alias("all_old")).filter(~F.col("all_old")).drop("all_old")
    cut = roles.join(load, ["block", "cls"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    large = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "doc_id", "node", "block", "cls", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "old")
    return small.union(large)


def verified(docs: DataFrame, tasks: DataFrame, size: int, least: Fraction) -> DataFrame:
    """(node, root, links) by task, from whole texts. Two nodes of one part are compared where their part meets itself."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        batch = table.to_batches()[0]
        _, sets = next(_sets(iter([batch]), size))
        nodes = batch.column("node").to_pylist()
        # A doc_id may have rows with other texts: the row whose set is the node counts.
        rows = list({node: k for k, (node, s) in enumerate(zip(nodes, sets, strict=True)) if node_of(s) == node}.values())
        old = np.array([batch.column("old")[k].as_py() for k in rows], "int64")
        part = np.array([batch.column("part")[k].as_py() for k in rows], "int64")
        across = table["i"][0].as_py() != table["j"][0].as_py()
        root, degree = _links([sets[k] for k in rows], np.array([old, (part + 1) * across]), least)
        names = np.array([nodes[k] for k in rows], "int64")
        return pa.table({"node": names, "root": names[root], "links": degree})

    placed = docs.filter(maybe_in(tasks, "doc_id")).join(tasks, "doc_id").select("text", "node", "block", "cls", "i", "j", "part", "old")
    return placed.groupBy("block", "cls", "i", "j").applyInArrow(run, "node long, root long, links long")


def similarity_join(docs: DataFrame, size: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links, component_id of every row of ``docs`` (doc_id, text; more columns are ignored).

    Documents link when the Jaccard similarity of their distinct ``size``-word
    shingles is at least ``least``. ``class_id`` is the smallest doc_id with the
    same set, ``n_links`` the number of other classes it links to, and ``component_id``
    the smallest doc_id reachable by links. A null or wordless text has no
    shingles and links with nothing. Rows with one doc_id are taken as separate texts of that
    id; a row without doc_id gets its counts, takes no part in links and has no component.
    """
    return _joined(docs, size, least).drop("node", "component")


def _joined(docs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """The columns of ``similarity_join``, node, and component (a node that all texts linked to this one share)."""
    docs = docs.select("doc_id", "text")
    sets = materialize(shingle_sets(docs, size), "sets")
    known = sets.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = known.groupBy("node", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    rows, weight = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    blocks = candidate_blocks(docs.filter(F.col("doc_id").isNotNull()), size, least, weight)
    placed = classes.withColumnsRenamed({"class_id": "doc_id", "n_shingles": "n"}).join(
        blocks.withColumnRenamed("component", "block"), "node")
    tasks = materialize(_tasks(refined(placed, docs, size, least), least), "tasks")
    # A task is whole in its part, and a part reads its own texts only.
    parts = part_count(tasks.count() * weight // max(rows, 1), PART_WEIGHT, PARTS)
    checked = in_parts(parts, lambda part: verified(
        docs, tasks if parts == 1 else tasks.filter(F.pmod(F.xxhash64("block", "cls", "i", "j"), F.lit(parts)) == part), size, least), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = connected_components(checked.filter(F.col("node") != F.col("root")).select("node", "root"), "components")
    reached = joined.join(classes, "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    found = classes.join(links, "node", "left").join(joined, "node", "left").join(reached, "component", "left").select(
        "node", "n_shingles", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("component", "node").alias("component"))
    with_words = known.join(found, ["node", "n_shingles"]).select(
        "doc_id", "n_shingles", "class_id", "n_links", "component_id", "node", "component")
    rest = sets.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("component_id"), "node", F.col("node").alias("component"))
    return with_words.union(rest)


def near_duplicate_free(docs: DataFrame, size: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each component one row of the smallest doc_id stays.

    Rows of a repeated doc_id go or stay each for its own text, by its set of shingles. Rows without
    doc_id or without words all stay.
    """
    joined = materialize(_joined(docs, size, least), "near")
    again = materialize(joined.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > 1).select("doc_id"), "repeated")
    dropped = joined.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    # Texts are shuffled only where the id may be one of those that go or recur.
    gone = again.union(dropped)
    suspect = maybe_in(gone, "doc_id")
    once = docs.filter(~suspect).union(docs.filter(suspect).join(gone, "doc_id", "left_anti").select(*docs.columns))
    # The rows of a repeated doc_id are numbered, as their texts alone don't tell them apart.
    rows = materialize(docs.join(again, "doc_id", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "rows")
    nodes = shingle_sets(rows.select(F.col("_row").alias("doc_id"), "text"), size).withColumnsRenamed({"doc_id": "_row", "n_shingles": "_n", "node": "_node"})
    first = joined.filter((F.col("component_id") == F.col("doc_id")) & (F.col("n_shingles") > 0)).join(again, "doc_id", "left_semi").groupBy(
        "doc_id", "component").agg(F.min("node").alias("_node")).select(F.col("doc_id").alias("_doc"), "_node")
    named = materialize(rows.select("_row", F.col("doc_id").alias("_doc")).join(nodes, "_row"), "nodes")
    stay = named.join(first, ["_doc", "_node"]).groupBy("_doc", "_node").agg(F.min("_row").alias("_row")).select("_row").union(
        named.filter(F.col("_n") == 0).select("_row"))
    return once.select(*docs.columns).union(rows.join(stay, "_row", "left_semi").select(*docs.columns))
