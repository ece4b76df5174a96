"""A bitmap of fixed size over the hashes of a key, to keep rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits.
WORDS = 1 << 14


def maybe_in(keys: DataFrame, key: str) -> Column:
    """Whether a row's ``key`` may be among those of ``keys``; false only if it is not.

    However many keys there are, ``WORDS`` numbers come to the driver and go out with the plan. With
    more keys than bits most rows pass, and the join that follows is as right, only larger.
    """
    place = F.pmod(F.xxhash64(key), F.lit(WORDS * 64))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    rows = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()
    words = [0] * WORDS
    for r in rows:
        words[r["word"]] = r["bits"]
    literal = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return F.getbit(F.element_at(literal, word.cast("int") + 1), bit) == 1
