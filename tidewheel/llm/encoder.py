"""Byte-level BPE of whole texts with a cache of frequent words, vectorised over an Arrow batch.

A text is cut ahead of each blank between two non-blank signs. The split pattern of this family of
tokenizers always breaks there, so the parts are encoded independently. Hashes of the parts find their ids in a
direct-mapped cache; missing parts go to the encoder in one call. Texts where a blank touches other white space or ends the text
go to the encoder whole. Tokens that the file adds to its model cut a text first and have their own ids.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken

from tidewheel.llm.hashing import SLICE_BYTES, segment_hashes

_TOUCHING = re.compile(r"\s\x20|\x20\s|\x20\Z")
_SLOT_BITS = 18
_STORE = 1 << 21


def byte_of_sign() -> dict[str, int]:
    """The printable signs that stand for bytes in the vocabulary file of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a ``tokenizers`` file adds to its model; they are found in the text before anything else."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that take in what is around them are not supported")
    return {t["content"]: t["id"] for t in added}


def ranks_of(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a ``tokenizers`` byte-level BPE file, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    signs = byte_of_sign()
    return {bytes(signs[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in signs for c in token)}


class Encoder:
    """Ids of texts; one for each task, as it holds the vocabulary and the cache."""

    def __init__(self, path: str) -> None:
        ranks = ranks_of(path)
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, "int64")
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)
        self.added = added_tokens(path)
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(1 << _SLOT_BITS, "uint64")
        self.at = np.zeros(1 << _SLOT_BITS, "int64")
        self.size = np.zeros(1 << _SLOT_BITS, "int64")
        self.store = np.zeros(0, "uint32")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), "uint32")

    def _around(self, text: str) -> np.ndarray:
        """Ids of a text with added tokens: what lies between them is encoded by itself."""
        out, at = [], 0
        for found in self.cuts.finditer(text):
            out += [self._whole(text[at: found.start()]), np.array([self.added[found[0]]], "uint32")]
            at = found.end()
        return np.concatenate([*out, self._whole(text[at:])])

    def _parts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are cut at every blank."""
        raw = [text.encode() for text in texts]
        data = np.frombuffer(b"".join(raw), "uint8")
        ends_of = np.cumsum([len(r) for r in raw])
        firsts = np.r_[0, ends_of[:-1]]
        cut = np.zeros(len(data), bool)
        cut[data == 32] = True
        cut[firsts] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(data)]
        keys = segment_hashes(data, starts, ends)
        slot = (keys >> np.uint64(64 - _SLOT_BITS)).astype("int64")
        if len(self.store) > _STORE:
            self._clear()
        at, size = self.at[slot], self.size[slot]
        lost = np.flatnonzero(self.hash[slot] != keys)
        if len(lost):
            new, pick, back = np.unique(keys[lost], return_index=True, return_inverse=True)
            pick = lost[pick]
            # A part without a blank ahead would run into its neighbour: it is encoded by itself.
            alone = np.flatnonzero(data[starts[pick]] != 32)
            chunks = {int(k): self._whole(bytes(data[starts[pick[k]]: ends[pick[k]]]).decode()) for k in alone}
            rest = np.setdiff1d(np.arange(len(new)), alone)
            joined = b"".join(data[s:e].tobytes() for s, e in zip(starts[pick[rest]].tolist(), ends[pick[rest]].tolist(), strict=True))
            ids = self._whole(joined.decode())
            reach = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(ends[pick[rest]] - starts[pick[rest]]), "left") + 1 if len(rest) else np.zeros(0, "int64")
            new_size = np.zeros(len(new), "int64")
            new_size[rest] = np.diff(np.r_[0, reach])
            new_at = np.zeros(len(new), "int64")
            base = len(self.store)
            new_at[rest] = base + np.r_[0, reach[:-1]] if len(rest) else 0
            tail = base + len(ids)
            for k, own in chunks.items():
                new_at[k], new_size[k] = tail, len(own)
                tail += len(own)
            self.store = np.concatenate([self.store, ids, *chunks.values()])
            at[lost], size[lost] = new_at[back], new_size[back]
            where = (new >> np.uint64(64 - _SLOT_BITS)).astype("int64")
            self.hash[where], self.at[where], self.size[where] = new, new_at, new_size
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.store[np.repeat(at - (stop - size), size) + np.arange(total)]
        bound = stop[np.searchsorted(starts, ends_of, "left") - 1]
        return np.split(ids, bound[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, "uint32")] * len(texts)
        group: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.cuts and self.cuts.search(text):
                out[k] = self._around(text)
                continue
            if len(text) > SLICE_BYTES or _TOUCHING.search(text):
                out[k] = self._whole(text)
                continue
            group.append(k)
            held += len(text)
            if held >= SLICE_BYTES:
                for g, ids in zip(group, self._parts([texts[g] for g in group]), strict=True):
                    out[g] = ids
                group, held = [], 0
        if group:
            for g, ids in zip(group, self._parts([texts[g] for g in group]), strict=True):
                out[g] = ids
        return out


def texts_of(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()
