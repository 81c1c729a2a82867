"""Array kernels over many texts at once: word bounds, word hashes, shingle sets.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z in hashes where
`lower` is asked for.  All hashes have 64 bits and depend on the words only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
#: Odd 64-bit multipliers of the hashes; any odd values serve.
MULTIPLY = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
#: Blocks of eight bytes that are hashed in arrays; longer words go to xxhash one by one.
BLOCKS = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche; works in place and returns `x`."""
    x ^= x >> U(32)
    x *= MULTIPLY[3]
    x ^= x >> U(29)
    x *= MULTIPLY[1]
    x ^= x >> U(32)
    return x


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the len+1 offsets into them; null texts are empty."""
    if text.null_count:
        text = pc.fill_null(text, "" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    if len(text) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a run of texts.

    start, end: byte bounds of each word; first: len+1 word offsets of the texts; hash: per word.
    """

    def __init__(self, text: pa.Array, lower: bool = True):
        self.bytes, self.offsets = buffers(text)
        n = self.bytes.size
        ink = ~SPACE[self.bytes]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        opens, closes = ink.copy(), ink.copy()
        if n:
            opens[1:] &= ~ink[:-1] | edge[1:-1]
            closes[:-1] &= ~ink[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.ink = ink
        self.folded = LOWER[self.bytes] if lower else self.bytes
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hashes(self.folded, self.start, self.end)
        return self._hash

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.count.size), self.count)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from its bytes and length."""
    size = (end - start).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((data.size + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = size.astype(np.uint64) * MULTIPLY[0]
    live = np.arange(size.size)
    for k in range(BLOCKS):
        if not live.size:
            break
        left = size[live] - 8 * k
        part = eight[start[live] + 8 * k]
        short = np.clip(8 - left, 0, 7).astype(np.uint64) * U(8)
        part = (part << short) >> short
        h[live] = mix(h[live] ^ part) + MULTIPLY[4]
        live = live[left > 8]
    for i in live.tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return mix(h)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window, and the len+1 offsets of the texts.

    A text of 1 to k-1 words has its whole sequence as its one shingle; without words, none.
    """
    h, first, count = words.hash, words.first, words.count
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], n)
    length = np.repeat(np.minimum(count, k), n)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    out = length.astype(np.uint64) * MULTIPLY[2]
    short = length < k
    anyshort = bool(short.any())
    for j in range(k):
        part = padded[at + j] * (MULTIPLY[j % 5] + U(2 * (j // 5)))
        if anyshort:
            part[length <= j] = 0
        out += part
    return mix(out), offsets


def distinct_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, with the new offsets; keeps the top 52 bits of each.

    52 bits leave room for the text's number, so one sort serves all texts of a slice.
    """
    n = offsets.size - 1
    assert n <= 4096
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    key = np.sort((values >> U(12)) | (text << U(52)))
    if key.size:
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    cut = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U(52)) if n < 4096 else np.append(np.searchsorted(key, np.arange(n, dtype=np.uint64) << U(52)), key.size)
    return key & U((1 << 52) - 1), cut


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each byte range: its hash, and its length with its first bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((data.size + 1,), dtype="<u8", buffer=padded, strides=(1,))
    short = np.clip(8 - (end - start), 0, 8).astype(np.uint64) * U(8)
    check = np.where(short < 64, (eight[start] << np.minimum(short, U(63))) ^ (end - start).astype(np.uint64) * MULTIPLY[0], U(0))
    return hashes(data, start, end), check


class KeyTable:
    """Flat open-address table that numbers 128-bit keys in order of arrival."""

    def __init__(self, slots: int = 1 << 16):
        self.names = np.zeros((2, 1 << 12), np.uint64)
        self.known = 0
        self._clear(slots)

    def _clear(self, slots: int) -> None:
        self.slots = slots
        self.key, self.check = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.number = np.full(slots, -1, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for those not known."""
        mask = self.slots - 1
        slot = (key & U(mask)).astype(np.int64)
        out = self.number[slot]
        wrong = np.flatnonzero((out >= 0) & ((self.key[slot] != key) | (self.check[slot] != check)))
        while wrong.size:
            slot[wrong] = (slot[wrong] + 1) & mask
            s = slot[wrong]
            out[wrong] = self.number[s]
            wrong = wrong[(out[wrong] >= 0) & ((self.key[s] != key[wrong]) | (self.check[s] != check[wrong]))]
        return out

    def insert(self, key: np.ndarray, check: np.ndarray) -> None:
        """Number new, distinct keys."""
        n, at = key.size, self.known
        if at + n > self.names.shape[1]:
            self.names = np.concatenate([self.names[:, :at], np.zeros((2, max(at, n) + n), np.uint64)], axis=1)
        self.names[0, at : at + n], self.names[1, at : at + n] = key, check
        self.known = at + n
        if self.known * 2 > self.slots:
            self._clear(1 << int(self.known * 4).bit_length())
            self._place(self.names[0, : self.known], self.names[1, : self.known], 0)
        else:
            self._place(key, check, at)

    def _place(self, key: np.ndarray, check: np.ndarray, at: int) -> None:
        mask = self.slots - 1
        slot, left = (key & U(mask)).astype(np.int64), np.arange(key.size)
        while left.size:
            free = left[self.number[slot[left]] < 0]
            self.number[slot[free]] = (at + free).astype(np.int32)  # of several for a slot the last stays
            mine = free[self.number[slot[free]] == at + free]
            self.key[slot[mine]], self.check[slot[mine]] = key[mine], check[mine]
            left = left[self.number[slot[left]] != at + left]
            slot[left] = (slot[left] + 1) & mask
