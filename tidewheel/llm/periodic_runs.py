"""Runs of periodic words in documents, by a suffix automaton with link-cut access.

A run is a longest stretch of words with smallest period q that is at least ``times`` periods and ``least`` words long.
The suffix links of a text's automaton form a tree whose nodes are the strings that end at each place. Appending
word i is an access of the node of prefix i: the path to the root falls into segments by the place e where each string ended last,
and all of it is recoloured to i. The lowest node of a segment is the longest string, of L words, that ended at e before; so the
words up to i have the period i - e over L + i - e words, and no smaller one, and cannot be extended to the left. With L at least
``times - 1`` periods that is a run, unless the next word extends it.

Only stretches that can hold a run are given to the automaton: in a run every two neighbouring words stand together ``times - 1`` times within
``(times - 2) / times`` of the run's length, which is looked up for lengths from each power of two to the next.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.ngram_join import small

#: Periods that a run holds at least, and its words.
TIMES, LEAST = 4, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)
WORD = r"[^\x20\t-\r]+"


def stretches(words: list[bytes], times: int, least: int) -> list[tuple[int, int]]:
    """Disjoint (from, to) such that each run of ``words`` lies in one of them; most words of prose are in none."""
    n, again = len(words), times - 1
    if n < least:
        return []
    if again < 2:
        return [(0, n)]
    hashes = np.fromiter(map(hash, words), "int64", n).view("uint64")
    pairs = hashes[:-1] * _ODD + hashes[1:]
    order = np.argsort(pairs, kind="stable")
    same = pairs[order]
    first = np.flatnonzero(same[again - 1:] == same[: n - again])
    if not len(first):
        return []
    spans = order[first + again - 1] - order[first]
    reach = np.full(n - 1, n)  # within so many words the pair here stands ``again`` times
    for j in range(again):
        np.minimum.at(reach, order[first + j], spans)
    found, size = [], least
    while size <= n:
        fine = np.zeros(n + 1, "int8")
        fine[1:-1] = reach * times < 2 * size * (again - 1)
        edges = np.flatnonzero(np.diff(fine))
        long = edges[1::2] - edges[::2] >= size - 1
        found += zip(edges[::2][long].tolist(), (edges[1::2][long] + 1).tolist(), strict=True)
        size *= 2
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def automaton(letters: list[int]) -> tuple[array, array, array]:
    """Suffix links and lengths of the states of the automaton of ``letters``, and the state of each prefix.

    The first transition of a state is held in arrays, further ones in a dictionary, as most states have one.
    """
    size = 2 * len(letters) + 2
    link, length = array("i", [-1]) * size, array("i", [0]) * size
    letter, target, more = array("i", [-1]) * size, array("i", [0]) * size, {}
    states, last, prefixes = 1, 0, array("i", [0]) * len(letters)
    for i, c in enumerate(letters):
        new = states
        states += 1
        length[new] = i + 1
        p = last
        while p >= 0 and letter[p] != c and not (p in more and c in more[p]):
            if letter[p] < 0:
                letter[p], target[p] = c, new
            else:
                more.setdefault(p, {})[c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = target[p] if letter[p] == c else more[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = states
                states += 1
                length[copy], link[copy], letter[copy], target[copy] = length[p] + 1, link[q], letter[q], target[q]
                if q in more:
                    more[copy] = dict(more[q])
                while p >= 0:
                    if letter[p] == c:
                        if target[p] != q:
                            break
                        target[p] = copy
                    else:
                        if more.get(p, {}).get(c) != q:
                            break
                        more[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        prefixes[i] = last = new
    return link, length, prefixes


class Access:
    """Preferred paths of a rooted forest as splay trees (link-cut trees without changes of the forest).

    All nodes of a preferred path were last touched by one access; its number stands at the root of the splay tree.
    """

    def __init__(self, parents: array) -> None:
        self.parent = array("i", parents)  # within a splay tree, or from its root to the path above
        self.left, self.right = (array("i", [-1]) * len(parents) for _ in range(2))
        self.seen = array("i", [-1]) * len(parents)

    def _splay(self, x: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        top = x
        while True:
            y = parent[x]
            if y < 0 or (left[y] != x and right[y] != x):
                break
            z = parent[y]
            inner = z >= 0 and (left[z] == y or right[z] == y)
            top = z if inner else y
            # One step is x over y; with z above, first y over z where both lean the same way, else x again.
            turns = ((y, x),) if not inner else ((z, y), (y, x)) if (left[z] == y) == (left[y] == x) else ((y, x), (z, x))
            for a, b in turns:  # b is a child of a and goes above it
                over = parent[a]
                if left[a] == b:
                    mid = right[b]
                    left[a], right[b] = mid, a
                else:
                    mid = left[b]
                    right[a], left[b] = mid, a
                if mid >= 0:
                    parent[mid] = a
                parent[a], parent[b] = b, over
                if over >= 0:
                    if left[over] == a:
                        left[over] = b
                    elif right[over] == a:
                        right[over] = b
        if top != x:
            self.seen[x] = self.seen[top]

    def access(self, node: int, number: int) -> Iterator[tuple[int, int]]:
        """(lowest node, number of the access before) of each segment of the path to the root; all of it gets ``number``."""
        below, x = -1, node
        while x >= 0:
            self._splay(x)
            before = self.seen[x]
            if before >= 0:
                yield x, before
            rest = self.right[x]  # deeper nodes of the old path, a path of their own from now on
            if rest >= 0:
                self.seen[rest] = before
            self.right[x] = below
            below, x = x, self.parent[x]
            self.seen[below] = number


def runs_of(letters: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    link, length, prefixes = automaton(letters)
    paths, n, found = Access(link), len(letters), []
    for i, node in enumerate(prefixes):
        for low, end in paths.access(node, i):
            period = i - end
            whole = length[low] + period
            if length[low] >= (times - 1) * period and whole >= least and (i + 1 == n or letters[i + 1] != letters[i + 1 - period]):
                found.append((i + 1 - whole, whole, period))
    return sorted((s, w, q) for s, w, q in found)


def text_runs(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, by start and then period."""
    out = []
    for lo, hi in stretches(words, times, least):
        names: dict[bytes, int] = {}
        out += [(lo + s, w, q) for s, w, q in runs_of([names.setdefault(w, len(names)) for w in words[lo:hi]], times, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those of any run after its first period, joined by blanks."""
    kept, at = [], 0
    for lo, hi in sorted((s + q, s + w) for s, w, q in runs):
        kept += words[at:lo]
        at = max(at, hi)
    return b" ".join([*kept, *words[at:]])


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the text without repetition (``collapsed``) of every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than white space, numbered from 0; they are equal if their bytes are. A null or wordless text has no runs
    and an empty ``collapsed``. Each row is taken by itself, so repeated doc_ids are no matter; more columns are ignored, and
    an empty table gives no rows. Memory of a task is that of its longest text's automaton.
    """
    cell = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, runs, texts = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                own = text_runs(words, times, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": w, "period": q} for s, w, q in own])
                texts.append(collapsed(words, own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(cell)), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repetition(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text made periodic from some word on, as told by the CRC-32 of its doc_id; rows without one stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_words"))
    g, n = F.floor(F.col("_h") / 10), F.nullif(F.size("_words"), F.lit(0))
    placed = words.withColumn("_a", g % n).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    period = F.slice("_words", F.col("_a").cast("int") + 1, F.col("_p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - F.col("_a")) / F.col("_p")).cast("int"))), F.lit(1), (n - F.col("_a")).cast("int"))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (most periods; ties: smallest start, then period) and digests of ``periodic_runs``."""
    def stronger(a: Column, b: Column) -> Column:
        """Runs are sorted by start and period, so the earlier one stays on ties."""
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), stronger)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
