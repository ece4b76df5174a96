"""Many keywords looked up in texts in one pass.

Keywords are substrings by default. A dictionary that is small enough to be sent to every task becomes an automaton, which
goes over each text once however many keywords there are. A larger one is a keyed join: each keyword meets the texts that
hold its rarest gram, and only these are searched for the whole keyword. Other grams never leave the task that reads a text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.session import materialize

#: UTF-8 bytes of a dictionary that is sent to every task; its automaton takes some fifty times as much.
SENT_BYTES = 4 << 20
#: Code points of a gram, and parts that the texts of one gram are dealt to.
GRAMS, PARTS = (1, 2, 3, 4, 8), 16
#: Bits of the bitmap of grams that goes to every task are two to this power; code points that are hashed at a time.
GRAM_BITS, SLICE = 26, 1 << 18
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Match:
    """How keywords are found: by default as substrings, and only the text is lower-cased."""

    word_boundary: bool = False
    fold_case: bool = False
    longest_match: bool = False

    def spelled(self, keyword: str) -> str:
        return keyword.lower() if self.fold_case else keyword


SUBSTRINGS = Match()


def _in_word(sign: str) -> bool:
    return unicodedata.category(sign)[0] in "LN"


@lru_cache(maxsize=8)
def _automaton(keywords: tuple[str, ...]) -> ahocorasick.Automaton:
    """Automaton of distinct keywords that are not empty; an occurrence tells the keyword's number. Built once for a worker."""
    out = ahocorasick.Automaton()
    for k, keyword in enumerate(keywords):
        if keyword:
            out.add_word(keyword, (k, len(keyword)))
    out.make_automaton()
    return out


def found_in(text: str, automaton: ahocorasick.Automaton, whole_words: bool = False) -> set[int]:
    """Numbers of the automaton's keywords that occur in ``text``."""
    if not len(automaton):
        return set()
    if not whole_words:
        return {k for _, (k, _) in automaton.iter(text)}
    return {k for end, (k, size) in automaton.iter(text)
            if not (end + 1 < len(text) and _in_word(text[end + 1])) and not (end >= size and _in_word(text[end - size]))}


def _over_texts(words: Callable[[], tuple[str, ...]], whole_words: bool, of_hits: Callable[[set[int]], list[int]]) -> Callable[[pa.Array], pa.Array]:
    """A function over a batch of texts: what ``of_hits`` makes of the numbers of the words found in each, null for a null text."""
    def run(texts: pa.Array) -> pa.Array:
        automaton = _automaton(words())
        return pa.array([None if t is None else of_hits(found_in(t, automaton, whole_words)) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run


def _sent(words: Sequence[str]) -> None:
    size = sum(len(w.encode()) for w in words)
    if size > SENT_BYTES:
        raise ValueError(f"a dictionary of {size} bytes is over {SENT_BYTES}: join it with keyword_matches")


def group_hits(lowered: Column, groups: Sequence[Sequence[str]], match: Match = SUBSTRINGS) -> Column:
    """How many keywords of each group occur in a text: one count for each group, all from one pass; null for a null text."""
    words = tuple(dict.fromkeys(match.spelled(k) for keys in groups for k in keys))
    _sent(words)
    number = {w: k for k, w in enumerate(words)}
    # Rows are keywords, columns groups; a keyword that a group lists twice counts twice there.
    table = np.zeros((len(words), len(groups)), "int32")
    for g, keys in enumerate(groups):
        for k in keys:
            table[number[match.spelled(k)], g] += 1
    always = table[number[""]] if "" in number else np.zeros(len(groups), "int32")

    def counts(hits: set[int]) -> list[int]:
        return (table[list(hits)].sum(axis=0) + always).tolist()

    return F.arrow_udf(_over_texts(lambda: words, match.word_boundary, counts), "array<int>")(lowered)


def _by_automaton(texts: DataFrame, id_column: str, text_column: str, keywords: DataFrame) -> DataFrame:
    """The collected dictionary has a checked size, so it fits the driver and every task."""
    words = tuple(sorted(r[0] for r in keywords.collect()))
    held = keywords.sparkSession.sparkContext.broadcast(words)
    hits = F.arrow_udf(_over_texts(lambda: held.value, False, sorted), "array<int>")(F.col(text_column))
    names = keywords.sparkSession.createDataFrame(list(enumerate(words)), "_k int, keyword string")
    return texts.select(id_column, F.explode(hits).alias("_k")).join(names, "_k").select(id_column, "keyword")


def _gram_hashes(signs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of the grams of that size at each place) of an array of code points, for each of ``GRAMS`` that fits."""
    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = (left[: len(right)] ^ (left[: len(right)] >> np.uint64(29))) * _LEFT + right
        return (mixed ^ (mixed >> np.uint64(32))) * _RIGHT

    of = {1: (signs.astype("uint64") + np.uint64(1)) * _RIGHT}
    for size, left in ((2, 1), (3, 2), (4, 2), (8, 4)):
        of[size] = joined(of[left], of[size - left][left:]) if len(signs) >= size else np.zeros(0, "uint64")
    yield from of.items()


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - GRAM_BITS)).astype("int64")


def _bits(grams: DataFrame) -> np.ndarray:
    """A bitmap of the buckets of ``grams`` (gram), of a fixed size."""
    bucket = F.shiftrightunsigned("gram", 64 - GRAM_BITS)
    own = 32_768  # bits in one bitmap of Spark
    rows = grams.groupBy((bucket / own).cast("int").alias("part")).agg(F.bitmap_construct_agg(bucket % own).alias("bits")).collect()
    out = np.zeros((1 << GRAM_BITS) // own * own // 8, "uint8")
    for r in rows:
        out[r["part"] * own // 8: (r["part"] + 1) * own // 8] = np.frombuffer(r["bits"], "uint8")
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, number of the text of each) of runs of texts up to a slice; longer texts are cut, and the parts overlap by a gram.

    Texts of a run have U+0000 between them. A gram that spans two texts is one more candidate at most.
    """
    held, size = [], 0

    def array() -> tuple[np.ndarray, np.ndarray]:
        signs = np.frombuffer("\0".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), "uint32")
        return signs, np.repeat([i for i, _ in held], [len(t) + 1 for _, t in held])[: len(signs)]

    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), SLICE):
            held.append((i, text[at: at + SLICE + max(GRAMS) - 1]))
            size += len(held[-1][1])
            if size >= SLICE:
                yield array()
                held, size = [], 0
    if held:
        yield array()


def _grams_in(texts: list[str | None], bits: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, hash of the gram) of each place whose gram is in the bitmap, slice by slice."""
    for signs, of_text in _slices(texts):
        for size, hashes in _gram_hashes(signs):
            if size in sizes:
                at = _buckets(hashes)
                found = np.flatnonzero((bits[at >> 3] >> (at & 7).astype("uint8")) & 1)
                yield of_text[found], hashes[found]


def _keyword_grams(keywords: DataFrame) -> DataFrame:
    """keyword, gram (hash) for each gram of each keyword, of the largest size that it holds."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams = [], []
            for word in batch.column(0).to_pylist():
                signs = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "uint32")
                own = np.unique([h for size, h in _gram_hashes(signs) if size <= len(signs)][-1])
                words += [word] * len(own)
                grams.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), _signed(np.concatenate(grams or [np.zeros(0, "uint64")]))], ["keyword", "gram"])

    return keywords.select("keyword").mapInArrow(rows, "keyword string, gram bigint")


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.astype("uint64", copy=False).view("int64"))


def _by_grams(texts: DataFrame, id_column: str, text_column: str, keywords: DataFrame) -> DataFrame:
    """Keywords meet texts by their rarest gram of up to eight signs; a keyword shorter than the least gram is one itself.

    Texts are looked through twice: the first pass counts the grams of the dictionary, the second finds the chosen ones. A bitmap of fixed
    size keeps other grams out of the shuffle; hashes and bits that coincide cost candidates only, as the whole keyword is looked for in the end.
    The texts of a gram are dealt to ``PARTS`` parts, so one that many texts hold is no hot key; the dictionary goes to each part.
    """
    context = texts.sparkSession.sparkContext
    length = F.char_length("keyword")
    sizes = [r["n"] for r in keywords.select(F.greatest(*[F.when(length >= n, n).otherwise(0) for n in GRAMS]).alias("n")).distinct().collect()]
    own = _keyword_grams(keywords)

    def counted(bits: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, hashes in _grams_in(batch.column(0).to_pylist(), bits.value, sizes):
                    grams, counts = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([_signed(grams), pa.array(counts.astype("int64"))], ["gram", "n"])

        return run

    def located(bits: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for of_text, hashes in _grams_in(batch.column(1).to_pylist(), bits.value, sizes):
                    order = np.lexsort((hashes, of_text))
                    of_text, hashes = of_text[order], hashes[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (of_text[1:] != of_text[:-1]) | (hashes[1:] != hashes[:-1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_text[new])), _signed(hashes[new])], ["id", "gram"])

        return run

    seen = texts.select(text_column).mapInArrow(counted(context.broadcast(_bits(own))), "gram bigint, n bigint")
    counts = seen.groupBy("gram").agg(F.sum("n").alias("n"))
    # A gram that no text holds has no count, and a keyword with one is in no text.
    rarest = materialize(own.join(counts, "gram", "left").groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).filter("rarest.n > 0").select(
        "keyword", F.col("rarest.gram").alias("gram")), "rarest")
    id_type = texts.schema[id_column].dataType.simpleString()
    held = texts.select(id_column, text_column).mapInArrow(located(context.broadcast(_bits(rarest))), f"id {id_type}, gram bigint")
    dealt = rarest.select("keyword", "gram", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    meeting = held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(dealt, ["gram", "part"])
    candidates = meeting.groupBy(F.col("id").alias(id_column)).agg(F.collect_set("keyword").alias("keywords"))
    hits = F.filter("keywords", lambda k: F.col(text_column).contains(k))
    return texts.join(candidates, id_column).select(id_column, F.explode(hits).alias("keyword"))


def keyword_matches(texts: DataFrame, dictionary: DataFrame, id_column: str, text_column: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(id, keyword) for each text of a unique id and each distinct keyword of ``dictionary`` (column ``keyword``) that occurs in it.

    The dictionary's size is measured first: up to ``sent_bytes`` it is sent as an automaton, beyond it is joined by grams; the rows
    are the same. Null texts and null keywords match nothing, the empty keyword matches every text.
    """
    keywords = dictionary.select("keyword").filter(F.col("keyword").isNotNull()).distinct()
    size, empty = keywords.agg(F.sum(F.octet_length("keyword")), F.max(F.col("keyword") == "")).first()
    rows = texts.select(id_column, text_column)
    found = (_by_automaton if (size or 0) <= sent_bytes else _by_grams)(rows, id_column, text_column, keywords.filter("keyword <> ''"))
    return found.union(rows.filter(F.col(text_column).isNotNull()).select(id_column, F.lit(""))) if empty else found
