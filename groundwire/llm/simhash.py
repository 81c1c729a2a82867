"""SimHash near-duplicates: 64-bit fingerprints, compared bit-sliced.

A fingerprint has a bit set where over half of the XXH64 hashes of the text's 3-word shingles have it.  Equal
fingerprints are one class, named by its smallest doc_id, so copies are compared once.

Two fingerprints that differ in at most r bits agree on one of r + 1 disjoint groups of bits.  Classes are therefore
bucketed by each group's value; a bucket that holds more than `BLOCK` classes is split again by the bits that its
members need not share yet, which have to agree on one of r + 1 groups as well, and so on: at every level no pair
is lost, and since fingerprints are distinct, the last level cannot hold more than `BLOCK` in a bucket.

Within a task, whole buckets are laid side by side into blocks.  A block is stored vertically, one plane of lanes for
each bit.  The distances of 64 lanes to a fingerprint grow in bitwise counters through carry-save adders, two planes
at a time; lanes whose counter overflows are beyond the radius, and a word of lanes is abandoned once all are.
Each block returns its local components as stars, so a dense group of n classes gives n links, and star rounds join
those of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, saved, slices
from .near_dup import _dealt, components, hot_keys
from .textkernel import Words

U = np.uint64
WORDS, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Most classes in a bucket that is compared at once; blocks hold up to twice as many.
BLOCK = 2048
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 17
#: Byte ranges beyond this go to the library one by one.
LONGEST = 256
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _round(acc, lane):
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte range of `data`."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((data.size + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((data.size + 1,), "<u4", padded, strides=(1,))
    h = np.full(size.size, U(seed) + P5, np.uint64)
    at = start.copy()
    wide = np.flatnonzero((size >= 32) & (size <= LONGEST))
    if wide.size:
        with np.errstate(over="ignore"):
            v = [np.full(wide.size, x, np.uint64) for x in (U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1)]
        live = np.arange(wide.size)
        while live.size:
            here = at[wide[live]]
            for j in range(4):
                v[j][live] = _round(v[j][live], eight[here + 8 * j])
            at[wide[live]] += 32
            live = live[end[wide[live]] - at[wide[live]] >= 32]
        got = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for j in range(4):
            got = (got ^ _round(U(0), v[j])) * P1 + P4
        h[wide] = got
    h += size.astype(np.uint64)
    left = np.where(size <= LONGEST, end - at, 0)
    live = np.flatnonzero(left >= 8)
    while live.size:
        h[live] = _turn(h[live] ^ _round(U(0), eight[at[live]]), 27) * P1 + P4
        at[live] += 8
        left[live] -= 8
        live = live[left[live] >= 8]
    live = np.flatnonzero(left >= 4)
    h[live] = _turn(h[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
    at[live] += 4
    left[live] -= 4
    live = np.flatnonzero(left > 0)
    while live.size:
        h[live] = _turn(h[live] ^ (padded[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    h ^= h >> U(32)
    for i in np.flatnonzero(size > LONGEST).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h


def joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each with one space behind it, and where each begins."""
    size = words.end - words.start + 1
    ends = np.cumsum(size)
    begin = ends - size
    if not size.size:
        return np.zeros(0, np.uint8), begin
    # the byte behind a word is a separator, or none at the end of the data
    out = np.append(words.folded, np.uint8(0x20))[np.repeat(words.start - begin, size) + np.arange(ends[-1])]
    out[ends - 1] = 0x20
    return out, begin


def fingerprint_of(text: pa.Array, k: int = WORDS) -> np.ndarray:
    """Fingerprint of each text of a slice; zero for texts without words."""
    words = Words(text)
    data, begin = joined(words)
    stop = begin + (words.end - words.start)
    n = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    ones = np.zeros((n.size, BITS), np.int64)
    of = np.repeat(np.arange(n.size), n)
    first = np.arange(offsets[-1]) + np.repeat(words.first[:-1] - offsets[:-1], n)
    last = first + np.repeat(np.minimum(words.count, k), n) - 1
    for lo in range(0, first.size, CHUNK):
        part = slice(lo, lo + CHUNK)
        h = xxh64(data, begin[first[part]], stop[last[part]])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts = of[part]
        edge = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        ones[texts[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    over = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def _fingerprint_rows(batches):
    for batch in batches:
        text = batch.column("text")
        for lo, hi in slices(text):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(fingerprint_of(text[lo:hi]).view(np.int64))], names=["doc_id", "fp"])


def close_pairs(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of a block whose fingerprints differ in at most `radius` bits."""
    n = fp.size
    words = -(-n // 64)
    lanes = np.zeros((words * 64, 8), np.uint8)
    lanes[:n] = fp.astype("<u8").view(np.uint8).reshape(-1, 8)
    # (BITS, words): plane b holds bit b of all lanes
    planes = np.packbits(np.unpackbits(lanes, axis=1, bitorder="little").T.copy(), axis=1, bitorder="little").view("<u8")
    digits = max(1, int(radius).bit_length())
    begin = (1 << digits) - 1 - radius  # so that a counter overflows just beyond the radius
    row, word = np.nonzero(np.arange(words)[None, :] >= (np.arange(n) // 64)[:, None])
    count = [np.full(row.size, U(0xFFFFFFFFFFFFFFFF) if begin >> d & 1 else U(0), np.uint64) for d in range(digits)]
    beyond = np.zeros(row.size, np.uint64)
    for b in range(0, BITS, 2):
        x, y = (planes[c][word] ^ (U(0) - ((fp[row] >> U(c)) & U(1))) for c in (b, b + 1))
        half = count[0] ^ x
        carry = (count[0] & x) | (half & y)
        count[0] = half ^ y
        for d in range(1, digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        beyond |= carry
        if b % 8 == 6:
            keep = np.flatnonzero(beyond != U(0xFFFFFFFFFFFFFFFF))
            if keep.size < 0.75 * row.size:
                row, word, beyond, count = row[keep], word[keep], beyond[keep], [c[keep] for c in count]
    within = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, lane = np.nonzero(within)
    i, j = row[cell], word[cell] * 64 + lane
    real = (j > i) & (j < n)
    return i[real], j[real]


def local_stars(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b): each linked fingerprint of a block with the smallest (as a long) of its component within the block."""
    i, j = close_pairs(fp, radius)
    own = fp.view(np.int64)
    label = own.copy()
    while i.size and (label[i] != label[j]).any():
        was = label.copy()
        np.minimum.at(label, i, was[j])
        np.minimum.at(label, j, was[i])
    some = np.flatnonzero(label != own)
    return own[some], label[some]


def _block_rows(radius: int):
    """Rows sorted by key; whole buckets are compared together, of at most BLOCK rows each."""

    def run(batches):
        key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compare(fp):
            # a fingerprint may stand in several buckets of a block
            a, b = local_stars(np.unique(fp).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            held = np.concatenate([held, batch.column("fp").to_numpy()])
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            lo = 0
            for edge, after in zip(edges.tolist(), [*edges[1:].tolist(), key.size]):
                if after - lo > 2 * BLOCK:
                    yield compare(held[lo:edge])
                    lo = edge
            key, held = key[lo:], held[lo:]
        if key.size:
            yield compare(held)

    return run


def _agreements(radius: int) -> list[list[tuple[int, int, int]]]:
    """Per level (path, child, mask): the bits on which the members of a child's buckets agree.

    The last level leaves so few bits that a bucket cannot hold more than BLOCK distinct fingerprints.
    """
    levels, now = [], [(0, 0)]
    while True:
        level = []
        for path, mask in now:
            left = [b for b in range(BITS) if not mask >> b & 1]
            cut = [round(len(left) * k / (radius + 1)) for k in range(radius + 2)]
            level += [(path, path * (radius + 1) + k, mask | sum(1 << b for b in left[cut[k] : cut[k + 1]])) for k in range(radius + 1)]
        levels.append(level)
        now = [(child, mask) for _, child, mask in level]
        if max(BITS - mask.bit_count() for _, mask in now) <= BLOCK.bit_length() - 1:
            return levels


def simhash_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of fingerprints whose components are those of all pairs within `radius` bits.

    `classes` has fp, long and distinct.
    """
    spark = classes.sparkSession
    rows = classes.select("fp", F.lit(0).alias("path"))
    links = None
    for level in _agreements(radius):
        signed = [(path, child, mask - (1 << 64) if mask >> 63 else mask) for path, child, mask in level]
        # a row for each choice of groups: (radius + 1) ** level
        masks = spark.createDataFrame(signed, "path int, child int, mask long")
        keyed = rows.join(F.broadcast(masks), "path").select("fp", F.col("child").alias("path"), F.xxhash64("child", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        keyed = saved(keyed, "keyed")
        counted = saved(keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "sizes")
        hot = hot_keys(counted)
        found = saved(_dealt(keyed, hot, "fp").join(_dealt(counted, hot, None), ["key", "salt"]).drop("salt"), "buckets")
        small = found.where(F.col("held") <= BLOCK).select("key", "fp")
        got = saved(arrow_map(small.repartition("key").sortWithinPartitions("key"), _block_rows(radius), "a long, b long"), "links")
        links = got if links is None else links.unionByName(got)
        rows = found.where(F.col("held") > BLOCK).select("fp", "path")
        if rows.isEmpty():
            break
    return links


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable).

    Documents whose fingerprints differ in at most `radius` bits are linked.  Null and wordless texts have fingerprint
    zero and are linked like any other; of very long texts all shingles count; a bit that exactly half the hashes have
    is 0.  Repeated rows of one doc_id each have their row in the result, and link what any of them links.  A null
    doc_id joins nothing: component_id is null.  An empty table gives an empty result.  Other columns are not read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = saved(arrow_map(text, _fingerprint_rows, "doc_id long, fp long"), "fingerprints")
    known = prints.where("doc_id is not null")
    classes = saved(known.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("held")), "classes")
    # texts under one doc_id are tied together
    several = known.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).where("a > b")
    ties = known.join(several.select("doc_id", "b"), "doc_id").select(F.col("fp").alias("a"), "b")
    found = components(simhash_links(classes, radius).unionByName(ties), "stars")
    placed = saved(classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", "held", F.coalesce("component", "fp").alias("key")), "placed")
    # both a component and a class may hold most of the documents
    least = saved(placed.groupBy("key").agg(F.min("low").alias("component_id"), F.count("*").alias("held")), "least")
    hot = hot_keys(least)
    named = _dealt(placed, hot, "fp").join(_dealt(least.drop("held"), hot, None), ["key", "salt"]).select(F.col("fp").alias("key"), "component_id")
    hot = hot_keys(classes.select(F.col("fp").alias("key"), "held"))
    whole = _dealt(known.withColumnRenamed("fp", "key"), hot, "doc_id").join(_dealt(named, hot, None), ["key", "salt"]).select("doc_id", "key", "component_id")
    alone = prints.where("doc_id is null").select("doc_id", F.col("fp").alias("key"), F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).select("doc_id", F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")
