"""Token ids of many texts, with each distinct chunk encoded once per worker.

Texts are cut into chunks where the public tokenizers used here must cut too: before ASCII white space
that follows a character that surely is none, and before an ASCII sign or digit that follows a letter.
No pre-token reaches over such a place and what follows it is read alike by itself, so ids of a text are the
ids of its chunks in order (tests compare with whole texts).  Chunks are looked up by 128 bits (a
64-bit hash, and length with the first bytes) in flat arrays; at `ENTRIES` chunks or `POOL` ids the
table drops all but the frequent ones.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from .common import hold
from .textkernel import LOWER, SPACE, KeyTable, buffers, word_keys

ENTRIES, POOL, SLOTS = 900_000, 7_000_000, 1 << 21
#: New chunks handed to the library in one string.
JOINED = 256

U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[:128] = True
_SIGN &= ~(_LETTER | SPACE)
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True  # two-byte characters; white space among them begins with C2
_LEAD3 = np.zeros(256, bool)
_LEAD3[[0xE0, *range(0xE4, 0xF0)]] = True  # three bytes; white space begins with E1, E2 or E3
_LEAD4 = np.zeros(256, bool)
_LEAD4[0xF0:] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks of all texts."""
    n = data.size
    ascii_letter, space, sign = _LETTER[data], SPACE[data], _SIGN[data]
    letter, ink = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # of the character before each place
    letter[1:] = ascii_letter
    if n and data.max() >= 0x80:
        high = data >= 0x80
        letter[2:] |= (data[:-1] == 0xC3) & high[1:] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        ink[2:] |= _LEAD2[data[:-1]] & high[1:]
        ink[3:] |= _LEAD3[data[:-2]] & high[2:]
        ink[4:] |= _LEAD4[data[:-3]] & high[3:]
    ink[1:] |= ascii_letter | sign
    cut = (space & ink[:-1]) | (sign & letter[:-1])
    if n:
        cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class ChunkCoder:
    """ids(texts) for an encoder of lists of chunks.

    fold: A-Z may be read as a-z and one leading space dropped, as the tokenizer does so itself.
    """

    def __init__(self, encode_many, fold: bool = False):
        self.encode_many, self.fold = encode_many, fold
        self.reset()

    def reset(self) -> None:
        self.table = KeyTable(SLOTS)
        self.begin, self.size, self.uses = (np.zeros(ENTRIES, np.int64) for _ in range(3))
        self.pool = np.zeros(POOL, np.uint32)
        self.used = 0

    def add(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Store new, distinct chunks."""
        n, at = key.size, self.table.known
        if at + n > self.begin.size:
            self.begin, self.size, self.uses = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.begin, self.size, self.uses))
        if self.used + ids.size > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros(ids.size, np.uint32)])
        self.pool[self.used : self.used + ids.size] = ids
        self.begin[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + n], self.uses[at : at + n] = sizes, 0
        self.table.insert(key, check)
        self.used += ids.size

    def thin(self) -> None:
        """Keep chunks used three times or more, a quarter of the bounds at most."""
        often = np.flatnonzero(self.uses[: self.table.known] > 2)
        often = often[np.argsort(-self.uses[often], kind="stable")][: ENTRIES // 4]
        often = often[np.cumsum(self.size[often]) <= POOL // 4]
        key, check, size = self.table.names[0, often], self.table.names[1, often], self.size[often]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[often] - ends + size, size) + np.arange(ends[-1] if ends.size else 0)]
        self.reset()
        self.add(key, check, size, ids)

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and len+1 offsets; a null text has none."""
        data, offsets = buffers(text)
        start = cuts(data, offsets)
        per_text = np.searchsorted(start, offsets)
        end = np.append(start[1:], data.size) if start.size else start
        if self.fold:
            data = LOWER[data]
            start = start + (SPACE[data[start]] if start.size else 0)
        key, check = word_keys(data, start, end)
        if self.table.known > ENTRIES * 3 // 4 or self.used > POOL * 3 // 4:
            self.thin()
        at = self.table.find(key, check)
        new = np.flatnonzero(at < 0)
        if new.size:
            _, first = np.unique(key[new], return_index=True)
            first = new[first]
            raw = data.tobytes()
            coded = self.encode_many([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist())])
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self.add(key[first], check[first], sizes, np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())))
            at[new] = self.table.find(key[new], check[new])
        self.uses[: self.table.known] += np.bincount(at, minlength=self.table.known)
        size = self.size[at]
        ends = np.cumsum(size)
        out = self.pool[np.repeat(self.begin[at] - ends + size, size) + np.arange(ends[-1] if ends.size else 0)]
        return out, np.concatenate([[0], ends])[per_text]


def library_coder(file: str, fold: bool) -> ChunkCoder:
    """This worker's coder over the tokenizers library."""
    return hold(("library", file, fold), lambda: new_coder(file, fold))


def new_coder(file: str, fold: bool) -> ChunkCoder:
    """A coder over the tokenizers library; strings of special tokens count as plain text.

    New chunks go to the library joined by a special token, which it cuts out before anything else;
    chunks that hold the string of a special token go alone, with special tokens off.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    special = {v.content: k for k, v in tokenizer.get_added_tokens_decoder().items()}
    joint, mark = next(iter(special.items()))

    def encode_many(chunks: list[str]) -> list[list[int]]:
        alone = {i for i, x in enumerate(chunks) if any(y in x for y in special)}
        rest = [x for i, x in enumerate(chunks) if i not in alone] if alone else chunks
        out: list[list[int]] = []
        for i in range(0, len(rest), JOINED):
            flat = tokenizer.encode(joint.join(rest[i : i + JOINED]) + joint, add_special_tokens=False).ids
            ends = np.flatnonzero(np.array(flat, np.uint32) == mark).tolist()
            out += [flat[a:b] for a, b in zip([0, *(x + 1 for x in ends)], ends)]
        if alone:
            given = iter(out)
            tokenizer.encode_special_tokens = True
            out = [tokenizer.encode(x, add_special_tokens=False).ids if i in alone else next(given) for i, x in enumerate(chunks)]
            tokenizer.encode_special_tokens = False
        return out

    return ChunkCoder(encode_many, fold)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    n = offsets.size - 1
    out = np.insert(ids, offsets[1:], np.full(n, end, ids.dtype))
    return out, offsets + np.arange(n + 1)
