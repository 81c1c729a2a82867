"""Phrase collocations by direct hashing and pruning (PCY / DHP).

Pass k counts the phrases of k words, and while it scans, hashes the phrases of k + 1 words into buckets.  The next
pass counts a phrase only if its bucket holds enough occurrences and (Apriori) its parts of k words are frequent.
Both tests read bitmaps of `n_buckets` bits, which is what is broadcast: 16 MB each at most, whatever the corpus.  A bit
may be set for a phrase that is not frequent, never the other way round, and what passes is counted exactly, as
text; so the bitmaps' size decides the work and not the result.

Bucket counts are held in one byte each (they saturate above the threshold) and leave a task as compressed blocks of
`BLOCK` buckets.  Phrases leave a slice counted; equal phrases of a slice are told apart by 128 bits.

The first rows of each language come from a tournament: each round keeps the best of groups of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, saved, slices
from .near_dup import _dealt, hot_keys
from .textkernel import LOWER, MULTIPLY, buffers, mix, word_keys

U = np.uint64
LEAST, FIRST, COVER = 10, 2000, 50
#: Bounds of the number of buckets; within them there is one for each TEXT_PER_BUCKET bytes of text.
FEWEST, MOST, TEXT_PER_BUCKET = 1 << 16, 1 << 27, 32
#: Buckets in a block that leaves a task, and the value at which their counts stop.
BLOCK, FULL = 1 << 16, 255
#: Text bytes handled by one round of array work, and phrases whose text is put together at once.
SLICE, TAKEN = 1 << 21, 1 << 15
#: Rows of a group in one round of the tournament, in multiples of the rows that it keeps.
GROUP = 16
#: Exact while a has 15 digits at most and l and r have 18.
SCORE = "cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
#: Piece separators and word separators of the contract.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True


class Phrases:
    """Words of a slice's texts within pieces, and the hash and text of each run of words."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets = buffers(text)
        n = data.size
        breaks = _BREAK[data]
        ink = ~(breaks | _GAP[data])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        opens, closes = ink.copy(), ink.copy()
        if n:
            opens[1:] &= ~ink[:-1] | edge[1:-1]
            closes[:-1] &= ~ink[1:] | edge[1:-1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(offsets, start, side="right") - 1
        self.piece = np.cumsum(breaks | edge[:-1])[start] if n else start
        folded = LOWER[data]
        self.words = word_keys(folded, start, end)
        size = end - start + 1
        self.stop = np.cumsum(size)  # behind each word's space in `data`
        self.begin = self.stop - size
        # all words in their order, one space behind each
        letter = np.ones(self.stop[-1] if size.size else 0, bool)
        letter[self.stop - 1] = False
        self.data = np.full(letter.size, 0x20, np.uint8)
        self.data[letter] = folded[ink]
        self.lang = lang
        names = lang.dictionary_encode()
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names.dictionary.to_pylist()], np.uint64)
        self.seed = seeds[names.indices.to_numpy()[self.text]] if start.size else np.zeros(0, np.uint64)

    def runs(self, k: int) -> np.ndarray:
        """First words of all runs of k words within a piece."""
        n = self.piece.size - k + 1
        return np.flatnonzero(self.piece[: max(n, 0)] == self.piece[k - 1 :][: max(n, 0)])

    def key(self, first: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """Hash of each run of k words and its language; which: 0, or 1 for an independent one."""
        out = self.seed[first] * MULTIPLY[4] + U(k)
        for j in range(k):
            out = mix(out ^ (self.words[which][first + j] * MULTIPLY[j]))
        return out

    def counted(self, first: np.ndarray, k: int, key: np.ndarray) -> pa.RecordBatch:
        """lang, phrase, n of the runs, equal ones once."""
        check = self.key(first, k, 1)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if (same & (check[order][1:] != check[order][:-1])).any():
            order = np.lexsort((check, key))
            same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
        edge = np.flatnonzero(np.concatenate([[True], ~same])) if order.size else order
        n = np.diff(np.append(edge, order.size))
        first = first[order[edge]]
        lo, hi = self.begin[first], self.stop[first + k - 1] - 1
        size = hi - lo
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        raw = np.zeros(cut[-1], np.uint8)
        for k in range(0, size.size, TAKEN):  # places of some phrases at once: eight bytes for each of theirs
            part = slice(k, k + TAKEN)
            at, end = cut[k], cut[min(k + TAKEN, size.size)]
            raw[at:end] = self.data[np.repeat(lo[part] - cut[k : k + size[part].size], size[part]) + np.arange(at, end)]
        phrase = pa.Array.from_buffers(pa.large_string(), first.size, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())
        return _rows(lang=self.lang.take(pa.array(self.text[first])), phrase=phrase, n=pa.array(n.astype(np.int64)))


_KINDS = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "block": pa.int32(), "held": pa.binary()}
_SCHEMA = "lang string, phrase string, n long, block int, held binary"


def _rows(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[name] if name in columns else pa.nulls(size, kind) for name, kind in _KINDS.items()], names=list(_KINDS))


def _bits(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & U(bitmap.size * 8 - 1)
    return (bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)


def _pass(k: int, last: bool, n_buckets: int, filled, frequent):
    """Pass k over the texts: counted phrases of k words, and blocks of bucket counts of those of k + 1."""

    def run(batches):
        counts = np.zeros(0 if last else n_buckets, np.uint8)
        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang")
            for lo, hi in slices(text, SLICE):
                found = Phrases(text[lo:hi], lang[lo:hi])
                first = found.runs(k)
                key = found.key(first, k)
                if k > 1:
                    parts = _bits(frequent.value, found.key(np.arange(max(found.piece.size - k + 2, 0)), k - 1))
                    keep = parts[first] & parts[first + 1] if first.size else np.zeros(0, bool)
                    first, key = first[keep], key[keep]
                    keep = _bits(filled.value, key)
                    first, key = first[keep], key[keep]
                if first.size:
                    yield found.counted(first, k, key)
                if not last:
                    longer = found.runs(k + 1)
                    if k > 1:  # a longer phrase is frequent only if both its parts may be
                        may = np.zeros(found.piece.size + 1, bool)
                        may[first] = True
                        longer = longer[may[longer] & may[longer + 1]]
                    bucket, n = np.unique((found.key(longer, k + 1) & U(n_buckets - 1)).astype(np.int64), return_counts=True)
                    counts[bucket] = np.minimum(counts[bucket] + n, FULL)
        for b in range(0, counts.size, BLOCK):
            part = counts[b : b + BLOCK]
            if part.any():
                yield _rows(block=pa.array([b // BLOCK], pa.int32()), held=pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)]))

    return run


def _merged(least: int):
    """Rows sorted by block: the bitmap of each block's buckets that hold `least` or more."""

    def run(batches):
        block, total = None, None

        def bitmap():
            raw = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([raw])], names=["block", "bits"])

        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist()):
                if b != block:
                    if block is not None:
                        yield bitmap()
                    block, total = b, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(pa.decompress(raw, BLOCK, "zstd", asbytes=True), np.uint8)
        if block is not None:
            yield bitmap()

    return run


def _keys_of(k: int, n_buckets: int):
    """Bits of frequent phrases: the blocks of the bitmap that some rows set."""

    def run(batches):
        bits = np.zeros(n_buckets // 8, np.uint8)
        for batch in batches:
            text, lang = batch.column("phrase"), batch.column("lang")
            for lo, hi in slices(text, SLICE):
                found = Phrases(text[lo:hi], lang[lo:hi])
                at = found.key(found.runs(k), k) & U(n_buckets - 1)
                np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & U(7)).astype(np.uint8)))
        size = BLOCK // 8
        for b in range(0, bits.size, size):
            if bits[b : b + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([b // size], pa.int32()), pa.array([bits[b : b + size].tobytes()])], names=["block", "bits"])

    return run


def _either(batches):
    """Rows sorted by block: the union of each block's bits."""
    block, total = None, None
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
            if b != block:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()])], names=["block", "bits"])
                block, total = b, np.zeros(BLOCK // 8, np.uint8)
            total = total | np.frombuffer(raw, np.uint8)
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()])], names=["block", "bits"])


def _broadcast(blocks: DataFrame, n_buckets: int):
    """The bitmap of (block, bits) on all executors: n_buckets / 8 bytes."""
    out = np.zeros(n_buckets // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] * (BLOCK // 8) :][: BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(out)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def frequent_phrases(texts: DataFrame, most: int = 3, least: int = LEAST, n_buckets: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, n) of the phrases of 1, 2, ... `most` words with n >= `least`, and (lang, n) of all words.

    `texts` has text and lang without nulls.
    """
    if not 1 <= least <= FULL:
        raise ValueError(f"least is to be from 1 to {FULL}")
    if n_buckets is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // TEXT_PER_BUCKET
        n_buckets = min(max(FEWEST, 1 << int(size).bit_length()), MOST)
    tables, filled, frequent, words = [], None, None, None
    for k in range(1, most + 1):
        last = k == most
        out = saved(arrow_map(texts, _pass(k, last, n_buckets, filled, frequent), _SCHEMA), f"pass{k}")
        counted = out.where("block is null")
        if k == 1:
            words = saved(counted.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        tables.append(saved(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"frequent{k}"))
        if not last:
            merged = arrow_map(_by_block(out.where("block is not null").select("block", "held")), _merged(least), "block int, bits binary")
            filled = _broadcast(merged, n_buckets)
            marks = arrow_map(tables[-1], _keys_of(k, n_buckets), "block int, bits binary")
            frequent = _broadcast(arrow_map(_by_block(marks), _either, "block int, bits binary"), n_buckets)
    return tables, words


def _counts(cuts: DataFrame, part: str, table: DataFrame, name: str) -> DataFrame:
    """`cuts` with the count of the phrase in column `part` as `name`; parts that many phrases share are dealt over tasks."""
    keyed = cuts.withColumn("key", F.struct("lang", F.col(part).alias("phrase")))
    hot = hot_keys(keyed.groupBy("key").agg(F.count("*").alias("held")))
    found = table.select(F.struct("lang", "phrase").alias("key"), F.col("n").alias(name))
    return _dealt(keyed, hot, "phrase").join(_dealt(found, hot, None), ["key", "salt"]).drop("key", "salt")


def _best(rows: DataFrame, first: int) -> DataFrame:
    """The first rows of each language with their rank, by rounds over groups of bounded size."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = rows.count() // (GROUP * first) + 1
    while groups > 1:
        each = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        rows = saved(rows.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= first).drop("rank"), "round")
        groups //= GROUP
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)


def phrases(docs: DataFrame, most: int = 3, least: int = LEAST, first: int = FIRST, cover: int = COVER, n_buckets: int | None = None) -> DataFrame:
    """Each language's first collocations: lang, rank, phrase, a, l, r, n, score.

    Null texts count as empty; a null lang is `und`.  Very long texts count whole, repeated rows each time they
    occur.  A phrase's lowest-scoring cut counts, of equal ones the first; equal scores rank by a, then by the phrase's
    bytes.  A table without phrases gives an empty result.  Other columns are not read.  Scores are exact while a
    stays below 10 ** 15 and l and r below 10 ** 18.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    tables, words = frequent_phrases(texts, most, least, n_buckets)
    scored = None
    for k in range(2, most + 1):
        parts = F.split("phrase", " ")
        cuts = tables[k - 1].select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("k"), parts.alias("w"))
        cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.lit(k) - F.col("k"))).alias("right"))
        for j in range(1, k):
            of = saved(_counts(_counts(cuts.where(F.col("k") == j), "left", tables[j - 1], "l"), "right", tables[k - j - 1], "r").drop("left", "right"), "cuts")
            scored = of if scored is None else scored.unionByName(of)
    scored = scored.withColumn("score", F.expr(SCORE))
    least_cut = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase goes if one that holds it has enough of its occurrences; phrases of k words hold those of fewer in their parts
    inner = None
    for k in range(3, most + 1):
        w = F.split("phrase", " ")
        held = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(k - 1)), lambda m: F.transform(F.sequence(F.lit(1), F.lit(k + 1) - m), lambda i: F.concat_ws(" ", F.slice(w, i, m))))))
        of = tables[k - 1].select("lang", "n", held.alias("phrase"))
        inner = of if inner is None else inner.unionByName(of)
    kept = least_cut
    if inner is not None:
        longest = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        kept = least_cut.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    rows = saved(kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")), "scored")
    totals = words.select("lang", "n")
    return _best(rows, first).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
