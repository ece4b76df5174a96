"""Byte-level BPE in Spark's higher-order functions: encoding by a fold of ranked merges, and decoding.

A word is folded as one array of numbers, one for each piece: the rank of the piece together with the one before it, the byte where
it starts and its id, from the highest bits down. So the least number is the pair of the smallest rank, leftmost first. That rank is
the id of the joined piece, and pairs of ids find their ranks in a map that reads two slots at most. An id of a
text is one sign, so that ids with U+0000 after each are little-endian 32-bit numbers in UTF-16LE.

Words are counted over the corpus and the ``MAX_WORDS`` most frequent are folded once; their ids are a map of
bounded size as well. A rarer word is folded where it stands, so texts never go through a shuffle. Decoding
looks up each id's bytes and concatenates them. Maps are one-row tables and scalar subqueries: as literals of the plan, Spark would
keep them in the text of every plan that it has run. A subquery is a column first (``with_maps``), as functions of lambdas take none; each is
named once, so that Spark puts it in its place and no row holds it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.columns import let

#: Words whose ids are looked up; all others are encoded in their place.
MAX_WORDS = 1 << 17
#: Slots of a map of texts.
RANK_SLOTS, WORD_SLOTS = 1 << 17, 1 << 18
#: A pair of ids is at one of its remainders by these.
PAIR_SLOTS = 271_003, 299_539
#: Numbers of the fold: the bit where ranks begin, the bits of where a piece starts, and what is no id and no rank.
RANK, START, END = 40, 0xFFFFFF0000, 0xFFFF
#: White space of the split pattern: the Unicode property, which Java's \s is not.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file (base64 and number on each line); ids must be below 0xD800 to be signs."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    if max(ranks.values()) >= 0xD800:
        raise ValueError("an id of 0xD800 or more is no sign")
    return ranks


def java_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    """The split pattern with its white space spelled out."""
    return (pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))


def slots_of(key: Column, count: int) -> tuple[Column, Column]:
    """The two slots that a key may be in; ``count`` is a power of two."""
    return F.xxhash64(key).bitwiseAND(count - 1), F.shiftrightunsigned(F.xxhash64(key), 24).bitwiseAND(count - 1)


def choose(condition: Column, one: Column, other: Column) -> Column:
    """``one`` or ``other``; ``when`` looks at its list of branches each time it runs."""
    return F.call_function("if", condition, one, other)


def placed(slots: list[tuple[int, int]], count: int, moves: int = 200) -> dict[int, int]:
    """Key by slot, each key in one of its two; one that finds no place after many moves is left out."""
    at: dict[int, int] = {}
    for key in range(len(slots)):
        one, to = key, slots[key][0]
        for _ in range(moves):
            if to not in at:
                at[to] = one
                break
            at[to], one = one, at[to]
            to = slots[one][1] if slots[one][0] == to else slots[one][0]
    return at


def looked_up(table: Column, key: Column, slots: tuple[Column, Column], otherwise: Column) -> Column:
    """The value of ``key`` in one of its two slots of ``table`` (keys, values), or ``otherwise``, which runs only then."""
    first, second = slots
    return choose(table["keys"][first] == key, table["values"][first],
                  choose(table["keys"][second] == key, table["values"][second], otherwise))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def one_row(spark: SparkSession, columns: dict[str, tuple[Iterable, pa.DataType]]) -> Column:
    """A struct of arrays, named by ``columns``, as a scalar subquery over a table of one row."""
    row = pa.table({name: pa.array([list(values)], pa.list_(kind)) for name, (values, kind) in columns.items()})
    return spark.createDataFrame(row).select(F.struct(*columns)).scalar()


class TextMap:
    """Texts and their values in arrays by slot; a look-up reads two slots at most.

    The arrays are ``table``, which an expression names once (``let``).
    """

    def __init__(self, spark: SparkSession, keys: list[str], values: list[str], slots: list[tuple[int, int]], count: int, whole: bool = False) -> None:
        at = placed(slots, count)
        if whole and len(at) < len(keys):
            raise ValueError("the slots are too few for the keys")
        self.count = count
        # A free slot holds no key, which equals none.
        self.table = one_row(spark, {name: ([texts[at[k]] if k in at else None for k in range(count)], pa.string())
                                     for name, texts in (("keys", keys), ("values", values))})

    def find(self, table: Column, key: Column, otherwise: Column) -> Column:
        """The value of ``key``; ``table`` is what names this map's table."""
        return looked_up(table, key, slots_of(key, self.count), otherwise)


def merges(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of each two ids whose joined bytes have one, by the first id in 16 bits and the second in 16."""
    return {ranks[token[:k]] << 16 | ranks[token[k:]]: rank for token, rank in ranks.items()
            for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks}


def merge_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """keys, values: slots of the pairs of ids and their ranks; bytes: the id of each byte; pairs: the rank of each two bytes."""
    of = merges(ranks)
    keys = list(of)
    at = placed([tuple(k % m for m in PAIR_SLOTS) for k in keys], max(PAIR_SLOTS))
    if len(at) < len(keys):
        raise ValueError("the slots are too few for the pairs")
    # No pair is -1.
    columns = {"keys": (keys[at[k]] if k in at else -1 for k in range(max(PAIR_SLOTS))),
               "values": (of[keys[at[k]]] << RANK if k in at else 0 for k in range(max(PAIR_SLOTS))),
               "bytes": (ranks[bytes([b])] for b in range(256)),
               "pairs": (ranks.get(bytes([a, b]), END) << RANK for a in range(256) for b in range(256))}
    return one_row(spark, {name: (values, pa.int64()) for name, values in columns.items()})


class Tokenizer:
    """Columns that encode and decode by one rank file."""

    def __init__(self, docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        ranks = read_ranks(path)
        self.pattern = java_pattern(pattern)
        pieces = sorted((token.decode("latin-1"), rank) for token, rank in ranks.items())
        by_rank = [""] * (max(ranks.values()) + 1)
        for piece, rank in pieces:
            by_rank[rank] = piece
        # Spark hashes the keys, so that look-ups find the same slots.
        spark = docs.sparkSession
        self.pieces = one_row(spark, {"pieces": (by_rank, pa.string())})
        hashed = spark.createDataFrame(pieces, "piece string, rank int").select(
            "piece", "rank", F.array(*slots_of(F.col("piece"), RANK_SLOTS)).alias("slots")).toArrow().to_pydict()
        self.whole = TextMap(spark, hashed["piece"], [str(r) for r in hashed["rank"]], hashed["slots"], RANK_SLOTS, whole=True)
        self.merges = merge_table(spark, ranks)
        self.known: TextMap | None = None

    def with_maps(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the maps that encoding looks into; a later step names each once."""
        maps = {"_whole": self.whole.table, "_merges": self.merges} | ({"_words": self.known.table} if self.known else {})
        return rows.withColumns(maps)

    #: The ranks, in rows that ``with_maps`` made.
    ranks = property(lambda self: F.struct(F.col("_whole").alias("whole"), F.col("_merges").alias("merges")))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _rank(self, table: Column, left: Column, right: Column) -> Column:
        """The rank of two ids in its bits; ``END`` if they have none."""
        key = left * 65536 + right
        return looked_up(table, key, (key % _long(PAIR_SLOTS[0]), key % _long(PAIR_SLOTS[1])), _long(END << RANK))

    def _merge(self, table: Column, own: Column) -> Column:
        """One step of the fold: the pair of the smallest rank becomes one piece. An ``END`` stands at both sides of the word."""
        def joined(at: Column) -> Column:  # the second piece of the pair, from 1
            left, right = own[at - 2], own[at]
            new = F.shiftright(own[at - 1], RANK)
            return F.flatten(F.array(
                F.slice(own, F.lit(1), at - 2),
                F.array(self._rank(table, own[at - 3].bitwiseAND(END), new) + left.bitwiseAND(START) + new,
                        self._rank(table, new, right.bitwiseAND(END)) + right.bitwiseAND(START | END)),
                F.slice(own, at + 2, F.size(own))))

        best = F.array_min(own)
        return choose(best >= _long(END << RANK), own, let(F.array_position(own, best).cast("int"), joined))

    def fold(self, table: Column, word: Column) -> Column:
        """Ids of a word, as signs; ``table`` names the ranks."""
        def split(codes: Column) -> Column:
            end = F.array(_long(END << RANK | END))
            pieces = F.transform(codes, lambda b, i: F.coalesce(
                table["merges"]["pairs"][F.get(codes, i - 1) * 256 + b], _long(END << RANK)) + i.cast("long") * 65536 + table["merges"]["bytes"][b])
            return F.aggregate(codes, F.flatten(F.array(end, pieces, end)), lambda own, _: self._merge(table["merges"], own), lambda own: F.array_join(
                F.transform(F.slice(own, F.lit(2), F.size(own) - 2), lambda p: self._sign(p.bitwiseAND(END))), ""))

        def whole(raw: Column) -> Column:
            rank = self.whole.find(table["whole"], raw, F.lit(""))
            return let(rank, lambda r: choose(r != "", self._sign(r.try_cast("int")), let(F.transform(F.split(raw, ""), F.ascii), split)))

        return let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), whole)

    @staticmethod
    def _sign(rank: Column) -> Column:
        """The sign of an id."""
        return F.decode(F.unhex(F.lpad(F.hex(rank), 4, "0")), "UTF-16BE")

    def learn_words(self, docs: DataFrame, most: int = MAX_WORDS) -> None:
        """Have later columns look up the ids of the most frequent words of all texts."""
        counts = docs.select(F.explode(self.words(F.col("text"))).alias("word")).groupBy("word").count()
        top = counts.filter(F.col("count") > 1).orderBy(F.desc("count"), "word").limit(most)
        rows = self.with_maps(top.repartition(F.col("word"))).select(
            "word", let(self.ranks, lambda t: self.fold(t, F.col("word"))).alias("ids"), F.array(*slots_of(F.col("word"), WORD_SLOTS)).alias("slots")).toArrow().to_pydict()
        self.known = TextMap(docs.sparkSession, rows["word"], rows["ids"], rows["slots"], WORD_SLOTS)

    def encode(self, text: Column) -> Column:
        """The ids of a text, a sign each, in rows that ``with_maps`` made."""
        if self.known is None:
            return let(self.ranks, lambda t: F.array_join(F.transform(self.words(text), lambda word: self.fold(t, word)), ""))
        both = F.struct(self.ranks.alias("ranks"), F.col("_words").alias("words"))
        return let(both, lambda t: F.array_join(F.transform(self.words(text), lambda word: self.known.find(
            t["words"], word, self.fold(t["ranks"], word))), ""))

    @staticmethod
    def decode(ids: Column, pieces: Column) -> Column:
        """The bytes of an array of ids as signs, as binary; ``pieces`` are the tokens by id."""
        return F.encode(F.array_join(let(pieces, lambda pieces: F.transform(ids, lambda sign: pieces[F.ascii(sign)])), ""), "ISO-8859-1")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text); a null text is empty.

    Ids are those of plain text, without special tokens. Repeated rows are encoded each.
    """
    docs = docs.select("doc_id", "text")
    tokenizer = Tokenizer(docs, path)
    tokenizer.learn_words(docs)
    rows = tokenizer.with_maps(docs).withColumn("_pieces", tokenizer.pieces)

    def digests(ids: Column) -> Column:
        signs = F.encode(choose(F.size(ids) > 0, F.concat(F.array_join(ids, "\0"), F.lit("\0")), F.lit("")), "UTF-16LE")
        return F.struct(F.size(ids).cast("long").alias("n_tokens"), F.sha2(signs, 256).alias("ids_sha256"),
                        F.sha2(tokenizer.decode(ids, F.col("_pieces")["pieces"]), 256).alias("decoded_sha256"))

    # No sign splits into one empty text.
    ids = lambda signs: choose(signs == "", F.array().cast("array<string>"), F.split(signs, ""))
    return rows.select("doc_id", let(let(tokenizer.encode(F.col("text")), ids), digests).alias("own")).select("doc_id", "own.*")
