"""Vectorised hashing of words and word shingles of a batch of texts.

A word is a run of bytes other than white space (0x20, 0x09-0x0D); A-Z count as
a-z. Works on the UTF-8 bytes of a whole Arrow batch in slices of bounded size,
so neither a batch nor one very long text needs memory in proportion to itself
times the width of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit value over all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], "int64", len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8")
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def powers(count: int) -> np.ndarray:
    steps = np.full(max(count, 1), _BASE)
    steps[0] = 1
    return np.cumprod(steps)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each segment ``data[start:end]``; segments are in order and don't overlap or stay empty."""
    if not len(starts):
        return np.zeros(0, "uint64")
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
    chars = data[place + np.repeat(starts, sizes)].astype("uint64") + np.uint64(1)
    return mix(np.add.reduceat(chars * powers(int(sizes.max()))[place], firsts) + sizes.astype("uint64"))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _pieces(space: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, from, to): runs of whole texts up to a slice, long texts cut at white space."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        at, end = int(offsets[first]), int(offsets[last])
        while end - at > SLICE_BYTES:
            gaps = np.flatnonzero(space[at + SLICE_BYTES: end])
            if not len(gaps):
                break
            cut = at + SLICE_BYTES + int(gaps[0])
            yield first, last, at, cut
            at = cut
        yield first, last, at, end
        first = last


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the place of its first word (one more at the end)."""
    data, offsets = text_bytes(column)
    space = is_space(data)
    hashes, places = [], []
    for first, last, lo, hi in _pieces(space, offsets):
        if lo == hi:
            continue
        part = data[lo:hi]
        part = np.where((part >= 65) & (part <= 90), part | 32, part)
        inside = ~space[lo:hi]
        edge = np.zeros(hi - lo + 1, bool)
        cuts = offsets[first: last + 1]
        edge[cuts[(cuts >= lo) & (cuts <= hi)] - lo] = True
        edge[0] = edge[-1] = True
        starts = np.flatnonzero(inside & (edge[:-1] | np.r_[True, ~inside[:-1]]))
        ends = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True])) + 1
        hashes.append(segment_hashes(part, starts, ends))
        places.append(starts + lo)
    if not hashes:
        return np.zeros(0, "uint64"), np.zeros(len(offsets), "int64")
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets, "left")


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int,
                   points: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text the distinct hashes of its ``size``-word shingles, ascending, and with ``points`` of the words their sums.

    A text with fewer words has one: the whole sequence. One without words has none.
    """
    span = max(len(words) - size + 1, 0)
    joined = np.zeros(span, "uint64")
    summed = None if points is None else np.zeros(span, "int64")
    for j in range(size):
        joined = joined * _FOLD + words[j: j + span]
        if summed is not None:
            summed += points[j: j + span]
    joined = mix(joined)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            if summed is None:
                yield np.unique(joined[lo: hi - size + 1]), None
            else:
                own, at = np.unique(joined[lo: hi - size + 1], return_index=True)
                yield own, summed[lo + at]
        elif hi > lo:
            total = hi - lo
            for h in words[lo:hi].tolist():
                total = (total * int(_FOLD) + h) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([total ^ 0x5851F42D4C957F2D], "uint64")), None if points is None else points[lo:hi].sum(keepdims=True)
        else:
            yield np.zeros(0, "uint64"), None if points is None else np.zeros(0, "int64")


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype="uint64").view("int64"))
