"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader.

Words are runs of letters, of digits or of other signs, so "the***" is two
words. Unigrams and bigrams are hashed to a fixed number of weights, together
with two pseudo-words: how many of a text's trigrams repeat, and how long it is. Training
takes a bounded sample of labelled rows, the same for any order of them; scoring
is one sparse dot product per text, in the scan's tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.hashing import SLICE_BYTES, is_space, mix, segment_hashes, text_bytes

BITS = 18
#: Labelled rows that training reads at most, those of the smallest hash of doc_id.
MAX_LABELS = 6000
EPOCHS = 10
#: Score from which on a text counts as good.
KEEP = 0.3
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_REPEATS, _LENGTH = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate FTRL-proximal settings."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


def _run_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text; letters are A-Z, a-z and all beyond ASCII."""
    hashes = []
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    kind = np.where(is_space(data), 0, np.where(letter, 1, np.where(digit, 2, 3))).astype("int8")
    cuts = np.flatnonzero(np.diff(kind)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(data)]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    at = 0
    while at < len(starts):  # a slice of words at a time
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        hashes.append(segment_hashes(data, starts[at:to], ends[at:to]))
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, "uint64")


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight indices and values (of length 1 together) of one text's bytes; none for a text without words."""
    words = _run_hashes(data) if len(data) else np.zeros(0, "uint64")
    if not len(words):
        return np.zeros(0, "int64"), np.zeros(0)
    pairs = mix(words[:-1] * _NEXT + words[1:])
    triples = mix(pairs[:-1] * _NEXT + words[2:])
    keys, counts = np.unique(np.concatenate([words, pairs]) >> np.uint64(64 - BITS), return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt(values @ values)
    fresh = len(np.unique(triples)) / len(triples) if len(triples) else 1.0
    pseudo = mix(np.array([_REPEATS + np.uint64(round(fresh * 10)), _LENGTH + np.uint64(len(words).bit_length())]))
    return np.r_[keys, pseudo >> np.uint64(64 - BITS)].astype("int64"), np.r_[values, 0.5, 0.25]


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[lo:hi]


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], how: Ftrl = Ftrl(), epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, indices, values) in the given order."""
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = bias = 0.0
    for _ in range(epochs):
        for label, at, values in examples:
            gap = 1 / (1 + np.exp(-np.clip(w[at] @ values + bias, -30, 30))) - label
            grad = gap * values
            old = n[at]
            new = old + grad * grad
            zed = z[at] + grad - (np.sqrt(new) - np.sqrt(old)) / how.alpha * w[at]
            n[at], z[at] = new, zed
            w[at] = np.where(np.abs(zed) <= how.l1, 0.0, (np.sign(zed) * how.l1 - zed) / ((how.beta + np.sqrt(new)) / how.alpha + how.l2))
            step = bias_n + gap * gap
            bias_z += gap - (np.sqrt(step) - np.sqrt(bias_n)) / how.alpha * bias
            bias_n = step
            bias = -bias_z / ((how.beta + np.sqrt(bias_n)) / how.alpha)
    return w.astype("float32"), float(bias)


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, float]:
    """Weights and bias learned from ``max_labels`` labelled rows at most, which are what reaches the driver.

    Labels other than 0 and 1 and rows without doc_id are not learned from; of several labels of one doc_id
    the smallest counts, and of several texts. Without any example all scores are 0.5.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(max_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text) for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array([a.astype("int32") for a, _ in found], pa.list_(pa.int32())),
                 pa.array([v.astype("float32") for _, v in found], pa.list_(pa.float32()))], ["doc_id", "label", "at", "value"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(run, "doc_id string, label int, at array<int>, value array<float>").toArrow()
    order = np.argsort(mix(np.array([hash_text(d) for d in rows["doc_id"].to_pylist()], "uint64")), kind="stable")
    # Views of the chunks as they came, so that the driver holds the examples once.
    at, value = ([one.values.to_numpy() for one in rows[c]] for c in ("at", "value"))
    label = rows["label"].to_pylist()
    return fit([(label[k], at[k], value[k]) for k in order.tolist()])


def hash_text(text: str) -> int:
    data = np.frombuffer(text.encode(), "uint8")
    return int(segment_hashes(data, np.array([0]), np.array([len(data)]))[0])


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """``docs`` with ``score``; a text that is null, empty or without words gets the bias alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array([bias + (weights[at] @ values if len(at) else 0.0) for at, values in map(features, _texts(batch))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(points, -30, 30))), pa.float64())], [*batch.schema.names, "score"])

    kept = docs.drop("score")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; other columns are neither read nor returned."""
    own = docs.select("doc_id", "text")
    return scored(own, *train(own, labels, max_labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs`` whose texts the classifier takes for good, with their columns."""
    result = scored(docs, *train(docs, labels, max_labels))
    return result.filter(F.col("score") >= KEEP).select(*(c for c in docs.columns))
