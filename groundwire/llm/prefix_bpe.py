"""Byte-pair encoding by dynamic programming over prefixes.

For each prefix of a byte string there is exactly one token that ends its encoding.  A token t ending
at i is that token when t is whole under the merges and the pair (last token of the prefix before t,
t) is one that the merges keep apart.  Both hold exactly when encoding the joined bytes by merges gives
these tokens back, which is looked up once per pair.  With the last tokens stored, bytes can be appended and
text after an edit encoded again without starting over.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hold, slices, tokenizer_file
from .tokens import ChunkCoder

#: Pair verdicts kept at most.
PAIRS = 500_000


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_encode(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges in rank order, lowest first and leftmost on ties: the definition of the encoding."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


class PrefixEncoder:
    """Encoder over a rank table; `ranks` has every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def keeps(self, token: int) -> bool:
        """Whether the merges give `token` for its own bytes."""
        if (got := self.whole.get(token)) is None:
            got = self.whole[token] = merge_encode(self.bytes_of[token], self.ranks) == [token]
        return got

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges keep `left` and `right` as neighbours."""
        if (got := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[left, right] = merge_encode(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return got

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Fill last[i] (the token ending prefix i + 1) from len(last) on."""
        ranks, longest = self.ranks, self.longest
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is not None and self.keeps(token) and (start == 0 or self.apart(last[start - 1], token)):
                    last.append(token)
                    break

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(data, last)
        return self.tokens(last)


class Buffer:
    """Bytes with the last token of each prefix: appends and edits cost what they touch."""

    def __init__(self, coder: PrefixEncoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.extend(self.data, self.last)

    def replace(self, lo: int, hi: int, new: bytes) -> int:
        """Put `new` in place of data[lo:hi]; the number of prefixes encoded again.

        Past the edit, the old last tokens hold again once `longest` of them in a row agree, since a
        prefix's token rests on that many before it only.
        """
        old, tail = self.last, len(self.data) - hi
        self.data = self.data[:lo] + new + self.data[hi:]
        self.last = old[:lo]
        self.coder.extend(self.data, self.last, lo + len(new))
        same, done = 0, len(new)
        while len(self.last) < len(self.data):
            self.coder.extend(self.data, self.last, len(self.last) + 1)
            done += 1
            same = same + 1 if self.last[-1] == old[len(old) - len(self.data) + len(self.last) - 1] else 0
            if same >= self.coder.longest:
                self.last += old[len(old) - len(self.data) + len(self.last) :]
                break
        assert len(self.last) == lo + len(new) + tail
        return done

    def ids(self) -> list[int]:
        return self.coder.tokens(self.last)


def _coder(file: str, pattern: str):
    coder = PrefixEncoder(read_ranks(file))
    find = regex.compile(pattern).findall

    def encode_many(chunks):
        done: dict[str, list[int]] = {}
        out = []
        for chunk in chunks:
            ids: list[int] = []
            for match in find(chunk):
                if (got := done.get(match)) is None:
                    got = done[match] = coder.encode(match.encode())
                ids += got
            out.append(ids)
        return out

    size = max(coder.bytes_of) + 1
    lengths = np.array([len(coder.bytes_of.get(i, b"")) for i in range(size)], np.int64)
    pool = np.frombuffer(b"".join(coder.bytes_of.get(i, b"") for i in range(size)), np.uint8)
    return ChunkCoder(encode_many), lengths, np.cumsum(lengths) - lengths, pool


def _rows(file: str, pattern: str, with_ids: bool):
    def run(batches):
        coder, lengths, begin, pool = hold(("prefix", file, pattern), lambda: _coder(file, pattern))
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                ids, at = coder.ids(text[lo:hi])
                size = lengths[ids]
                ends = np.cumsum(size)
                data = pool[np.repeat(begin[ids] - ends + size, size) + np.arange(ends[-1] if ends.size else 0)]
                raw, cut = ids.astype("<u4"), np.concatenate([[0], ends])[at].tolist()
                bounds = at.tolist()
                coded = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
                back = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
                arrays = [batch.column("doc_id")[lo:hi], pa.array(np.diff(at)), pa.array(coded), pa.array(back)]
                if with_ids:
                    arrays.append(pa.array([raw[a:b].tolist() for a, b in zip(bounds, bounds[1:])], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    return run


def encode_documents(docs: DataFrame, file: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids on demand), one row per row of `docs`.

    Each match of `pattern` is encoded by itself.  Null texts are empty; repeated rows and null ids keep
    their rows; other columns are not read; an empty table gives an empty result.
    """
    file = file or tokenizer_file("byte_bpe_50k.tiktoken")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(text, _rows(file, pattern, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)
