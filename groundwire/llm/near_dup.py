"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct 5-word shingles.  Sketching follows Dahlgaard, Knudsen and
Thorup (FOCS 2017): in round i < t each element falls into a hashed bin, in round t + j into bin
j, with a hashed value in [i, i + 1); the sketch keeps the least value of each bin and rounds end
once every bin is filled, which round 2t - 1 guarantees.  Equal coordinates estimate the Jaccard
similarity with Chernoff-like concentration.

1. Equal sets become one class, named by its smallest doc_id.
2. Classes whose sketches agree on one of `bands` bands of `rows` coordinates share a bucket.  Every
   class is paired with the smallest class of all its buckets, then, in buckets that hold several
   components, with that bucket's smallest; pairs are confirmed on the full sets.
3. Members of buckets that still hold several components are searched completely.  By the prefix bound two sets
   of this similarity share one of the first n - ceil(0.75 n) + 1 shingles of each in any common order, here the
   rarest first by counts in `SLOTS` hashed slots; pairs across components that do, and pass the exact bounds of their
   sizes and places, are confirmed too.  Members of one component need no further pair, so large groups
   of copies stay linear.
4. Components follow by large-star / small-star rounds on the confirmed links.

At similarity 0.75 the default 50 bands of 5 miss a pair with probability 1.3e-6; in steps 1 and 2 a signature bound
(0.74 of 250 bits equal, 0.875 expected, 6 standard deviations off) passes pairs over that step 3 finds again.

Rows of a key that holds more than one in `HOT_KEYS` of all rows are dealt over several tasks; there are
fewer such keys than `HOT_KEYS`, which bounds the table of them.

Texts, sets and bands are kept by bitmaps of the ids and keys asked for (`FILTER_BITS` bits at most) where they are read, so
that the others are not shuffled to be dropped.  A bitmap lets some others pass, which exact joins drop later.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, ordered, saved, slices, whole_row
from .textkernel import MULTIPLY, Words, distinct_sets, mix, shingles

U = np.uint64
WORDS = 5
BANDS, ROWS = 50, 5
#: Members compared with one copy of their leader's set.
SALT_ROWS = 512
SIGNATURE_SHARE = 0.74
#: Slots of the shingle counts that order shingles by rarity.
SLOTS = 1 << 20
#: Bits of a bitmap of ids or keys at most; more of them let more rows pass, which decides the work and not the result.
FILTER_BITS = 1 << 27
#: A key is hot with more than this many rows and more than one in HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS = 1024, 1 << 16
MASK52 = U((1 << 52) - 1)


def sets_of(text: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice, and offsets."""
    return distinct_sets(*shingles(Words(text), k))


def sketches(values: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch (n x t) of each non-empty set; rows of empty sets are all ones."""
    n = offsets.size - 1
    out = np.full((n, t), np.iinfo(np.uint64).max, np.uint64)
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    live = values
    flat = out.reshape(-1)
    empty_left = np.where(size > 0, t, 0)
    for i in range(2 * t):
        if not live.size:
            break
        h = mix(live + U((i + 1) * int(MULTIPLY[0]) % 2**64))
        place = (h % U(t)).astype(np.int64) if i < t else np.full(h.size, i - t)
        value = (U(i) << U(53)) | (h >> U(11))
        np.minimum.at(flat, text * t + place, value)
        if i >= 1:
            empty_left = (out == np.iinfo(np.uint64).max).sum(1) * (size > 0)
            keep = empty_left[text] > 0
            if not keep.all():
                live, text = live[keep], text[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * MULTIPLY[1] * np.ones((len(sketch), 1), np.uint64)
    for j in range(rows):
        key = mix(key ^ (parts[:, :, j] * MULTIPLY[j % 5]))
    return key


def signature(sketch: np.ndarray) -> np.ndarray:
    """One hashed bit of each coordinate (up to 256), packed into four longs."""
    n, t = sketch.shape
    bits = np.zeros((n, 256), np.uint8)
    bits[:, : min(t, 256)] = (mix(sketch[:, :256].copy()) & U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view("<i8")


def _sketch_rows(bands: int, rows: int, k: int):
    t = bands * rows

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                values, cut = sets_of(text[lo:hi], k)
                size = np.diff(cut)
                a = np.concatenate([[U(0)], np.cumsum(mix(values ^ (MULTIPLY[2] & MASK52)), dtype=np.uint64)])
                b = np.concatenate([[U(0)], np.cumsum(mix(values ^ (MULTIPLY[4] & MASK52)), dtype=np.uint64)])
                sk = sketches(values, cut, t)
                sig = signature(sk)
                keys = band_keys(sk, bands, rows).view(np.int64)
                full = size > 0
                keys = keys[full]
                bounds = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(size.astype(np.int64)), pa.array((a[cut[1:]] - a[cut[:-1]]).view(np.int64)), pa.array((b[cut[1:]] - b[cut[:-1]]).view(np.int64)), *(pa.array(np.ascontiguousarray(sig[:, j])) for j in range(4)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))],
                    names=["doc_id", "n_shingles", "f1", "f2", "s0", "s1", "s2", "s3", "bands"],
                )

    return run


def bitmap(hashes: DataFrame) -> Broadcast:
    """Bitmap of the low bits of column `hash` (long) in unsigned words, 64 bits or more for each row up to `FILTER_BITS`."""
    bits = min(FILTER_BITS, 1 << max(10, (64 * hashes.count()).bit_length()))
    slots = hashes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("held"))
    out = np.zeros(bits >> 6, np.uint64)
    for part in words.toArrow().to_batches():  # FILTER_BITS / 64 rows at most
        out[part.column("word").to_numpy()] = part.column("held").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes stand in the bitmap: all that were given to it, and some others."""
    slot = hashes.view(np.uint64) & U(64 * words.size - 1)
    return (words[(slot >> U(6)).astype(np.int64)] >> (slot & U(63)) & U(1)).astype(bool)


def _asked(batches, words: np.ndarray):
    """The rows of the batches whose column `hash` passes the bitmap."""
    for batch in batches:
        some = _passes(words, batch.column("hash").to_numpy())
        if some.any():
            yield batch.filter(pa.array(some))


def _band_rows(wanted: Broadcast):
    """Rows whose `bands` are cut to the keys that pass the bitmap, without those that keep none."""

    def run(batches):
        for batch in batches:
            bands = batch.column("bands")
            cut = bands.offsets.to_numpy() - bands.offsets[0].as_py()
            keys = bands.flatten()
            some = _passes(wanted.value, keys.to_numpy())
            bounds = np.concatenate([[0], np.cumsum(some)])[cut].astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(bounds), keys.filter(pa.array(some)))
            yield batch.set_column(batch.schema.get_field_index("bands"), "bands", left).filter(pa.array(np.diff(bounds) > 0))

    return run


def _set_rows(k: int, wanted: Broadcast):
    def run(batches):
        for batch in _asked(batches, wanted.value):
            text = batch.column("text")
            for lo, hi in slices(text):
                values, cut = sets_of(text[lo:hi], k)
                raw = pa.py_buffer(values.tobytes())
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cut * 8).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], out], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    """Rows sorted by (leader, salt, role): the leader's sets, then its members one by one."""

    def run(batches):
        leader, held = None, []
        for batch in batches:
            b, member, role, sets = (batch.column(x) for x in ("b", "a", "role", "shingles"))
            yes_a, yes_b = [], []
            for of, a, kind, raw in zip(b.to_pylist(), member.to_pylist(), role.to_pylist(), sets):
                got = np.frombuffer(raw.as_buffer(), np.uint64)
                if of != leader:
                    leader, held = of, []
                if kind == 0:
                    if not any(got.size == x.size and np.array_equal(got, x) for x in held):
                        held.append(got)
                    continue
                for x in held:
                    small, large = (got, x) if got.size <= x.size else (x, got)
                    if 100 * small.size < percent * large.size:
                        continue
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, large.size - 1)] == small).sum())
                    if both and 100 * both >= percent * (small.size + large.size - both):
                        yes_a.append(a)
                        yes_b.append(of)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(yes_a, pa.int64()), pa.array(yes_b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough.

    Each b's set goes to as many tasks as its pairs need (one for 512 pairs), so that no b, however
    common, gathers its partners in one task; a task holds one b's set at a time.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("long").alias("n_salts"))
    members = pairs.join(salts, "b").select("b", "a", F.pmod(F.xxhash64("a"), F.col("n_salts")).alias("salt"), F.lit(1).alias("role"))
    leaders = salts.select("b", F.col("b").alias("a"), F.explode(F.expr("sequence(0L, n_salts - 1)")).alias("salt"), F.lit(0).alias("role"))
    # by a merge join at every size, so that what is moved follows the input
    rows = members.unionByName(leaders).join(sets.select(F.col("doc_id").alias("a"), "shingles").hint("merge"), "a")
    return arrow_map(rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "role"), _confirm(percent), "a long, b long")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `links` (a, b).

    Large-star and small-star rounds; each round is a written table, so a lost executor costs
    one round.  The rounds end when no link changes, after about log(n) of them.
    """
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    was = mark(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = saved(small, name)
        new = mark(now)
        if new == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _possible(percent: int, t: int) -> Column:
    """Pairs that sizes and signatures leave possible; columns n, s0-s3 and their twins with 2."""
    unequal = sum((F.bit_count(F.col(f"s{j}").bitwiseXOR(F.col(f"{j}s"))) for j in range(4)), F.lit(0))
    limit = math.floor((1 - SIGNATURE_SHARE) * min(t, 256))
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (unequal <= limit)


def _twin(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key), F.col("n").alias("n2"), *(F.col(f"s{j}").alias(f"{j}s") for j in range(4)))


def hot_keys(counted: DataFrame) -> DataFrame:
    """key and salts (tasks to share it) of the hot keys of `counted` (key, held): fewer than HOT_KEYS rows."""
    total = counted.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // HOT_KEYS)
    return saved(counted.where(F.col("held") > limit).select("key", F.ceil(F.col("held") / limit).cast("int").alias("salts")), "hot")


def _dealt(rows: DataFrame, hot: DataFrame, by: str | None) -> DataFrame:
    """`rows` with salt: that of the hash of column `by`, or without `by` a copy of the row for each salt of its key."""
    rows = rows.join(F.broadcast(hot), "key", "left")
    n = F.coalesce("salts", F.lit(1))
    salt = F.explode(F.sequence(F.lit(0), n - 1)) if by is None else F.pmod(F.hash(by), n)
    return rows.withColumn("salt", salt).drop("salts")


def _slot_counts(wanted: Broadcast):
    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in _asked(batches, wanted.value):
            for raw in batch.column("shingles"):
                np.add.at(total, (np.frombuffer(raw.as_buffer(), np.uint64) & U(SLOTS - 1)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    return run


def _prefix_rows(counts: Broadcast, percent: int, wanted: Broadcast):
    def run(batches):
        uses = counts.value
        for batch in _asked(batches, wanted.value):
            for who, raw in zip(batch.column("rep").to_pylist(), batch.column("shingles")):
                got = np.frombuffer(raw.as_buffer(), np.uint64)
                n = got.size
                prefix = n - -(-n * percent // 100) + 1
                # the sets are sorted, so ties of the count stand in the order of the shingles
                first = np.argsort(uses[(got & U(SLOTS - 1)).astype(np.int64)], kind="stable")[:prefix]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(first.size, who)), pa.array(got[first].view(np.int64)), pa.array(np.arange(1, first.size + 1)), pa.array(np.full(first.size, n))], names=["rep", "key", "place", "n"])

    return run


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of distinct members (rep, c) of different components c that may be similar enough.

    For each shingle only members outside its most common component look for partners, so that the work is linear
    in the size of that component.
    """
    spark = sets.sparkSession
    members = saved(members, "members")
    wanted = bitmap(members.select(F.xxhash64("rep").alias("hash")))
    ids = sets.select(F.col("doc_id").alias("rep"), "shingles", F.xxhash64("doc_id").alias("hash"))
    counts = np.zeros(SLOTS, np.int64)
    for part in arrow_map(ids, _slot_counts(wanted), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():  # SLOTS rows at most
        counts[part.column("slot").to_numpy()] = part.column("n").to_numpy()
    firsts = arrow_map(ids, _prefix_rows(spark.sparkContext.broadcast(counts), percent, wanted), "rep long, key long, place long, n long")
    held = saved(firsts.join(members, "rep"), "prefixes")
    of_key = held.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("several"), F.sum("count").alias("held")).where("several > 1").select("key", "main", "held")
    of_key = saved(of_key, "keys")
    hot = hot_keys(of_key)
    rows = saved(_dealt(held, hot, "rep").join(_dealt(of_key.drop("held"), hot, None), ["key", "salt"]), "shared")
    left = _dealt(rows.where("c <> main").drop("salt", "main"), hot, None).withColumnRenamed("rep", "a")
    right = rows.select("key", "salt", F.col("rep").alias("b"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    sizes = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    # at the first shared shingle enough others must follow in both for the overlap that the sizes ask for
    room = (1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))) * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    pairs = left.join(right, ["key", "salt"]).where((F.col("c") != F.col("c2")) & sizes & room)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Null or wordless texts have an empty set and stay alone; of very long texts all shingles count.  doc_id names a document: repeated rows
    of one id are copies of each other and each has its row in the result.  A null doc_id joins
    nothing: component_id is null and kept is true.  An empty table gives an empty result.  Other
    columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    t = bands * rows
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"
    sketched = saved(arrow_map(text, _sketch_rows(bands, rows, words), schema), "sketches")
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = saved(known.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep")), "classes")

    def reps(known: DataFrame) -> DataFrame:
        found = known.join(classes.select("f1", "f2", F.col("rep").alias("doc_id")), ["f1", "f2", "doc_id"])
        return found.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "s0", "s1", "s2", "s3", "bands")

    buckets = saved(reps(known).select("rep", F.explode("bands").alias("key")).groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("held")).where("held > 1"), "leaders")
    hot = hot_keys(buckets)
    # most keys have one class and no bucket, so their rows are not moved again
    some = reps(arrow_map(known, _band_rows(bitmap(buckets.select(F.col("key").alias("hash")))), schema))
    members = some.select("rep", F.explode("bands").alias("key"))
    shared = saved(_dealt(members, hot, "rep").join(_dealt(buckets.drop("held"), hot, None), ["key", "salt"]), "buckets")

    marks = reps(known).drop("bands").join(shared.select("rep").distinct(), "rep", "left_semi")
    marks = saved(marks, "marks")
    # one scan for the sets of all candidates and of the few other texts that pass the bitmap, which no pair asks for
    wanted = bitmap(marks.select(F.xxhash64("rep").alias("hash")))
    sets = saved(arrow_map(text.where("doc_id is not null").withColumn("hash", F.xxhash64("doc_id")), _set_rows(words, wanted), "doc_id long, shingles binary"), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        return saved(confirmed(pairs, sets, percent), "links")

    # first every class with the smallest leader of its buckets: one pair a class, whatever the group's size
    star = shared.groupBy(F.col("rep").alias("a")).agg(F.min("leader").alias("b")).where("a <> b")
    star = star.join(marks.withColumnRenamed("rep", "a"), "a").join(_twin(marks.withColumnRenamed("rep", "b"), "b"), "b").where(_possible(percent, t)).select("a", "b")
    links = checked(saved(star, "stars"))
    found = saved(components(links), "components")

    # then, in buckets that still hold several components, with the bucket's leader, and at last all across
    for whole in (False, True):
        placed = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "salt", "rep", "leader", F.coalesce("component", "rep").alias("c"))
        mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max_by("c", F.col("rep") == F.col("leader")).alias("c2")).where("lo < hi").select("key", "c2")
        rest = saved(placed.join(_dealt(mixed, hot, None), ["key", "salt"]).join(marks, "rep"), "mixed")
        if rest.isEmpty():
            break
        if whole:
            pairs = _across(rest.select("rep", "c").distinct(), sets, percent)
        else:
            pairs = rest.where("c <> c2").select(F.col("rep").alias("a"), F.col("leader").alias("b"), "n", "s0", "s1", "s2", "s3").distinct()
            pairs = pairs.join(_twin(marks.withColumnRenamed("rep", "b"), "b"), "b").where(_possible(percent, t))
        pairs = saved(pairs.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            continue
        more = checked(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = saved(components(links), "components")

    by_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    alone = sketched.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = known.select("doc_id", "n_shingles", "f1", "f2").join(by_class, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that are not their component's smallest; all columns stay, whatever their names.

    Rows that repeat one doc_id and its text count as one document, so one of them stays.  Different texts under
    one doc_id are documents of their own, in the order of a hash of the text.  All rows without a doc_id stay, and
    all empty texts.  Very long texts count whole; an empty table gives an empty result.
    """
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null").select("row.*")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        verdict = near_duplicates(named, **options).where("kept").select("doc_id")
        return named.join(verdict, "doc_id", "left_semi").select("row.*").unionByName(unnamed)
    # a doc_id does not name one document here, so places in the order of doc_id do
    single = named.withColumn("content", F.sha2("text", 256)).dropDuplicates(["doc_id", "content"])
    placed = ordered(single, ["doc_id", "content"], "place")
    verdict = near_duplicates(placed.select(F.col("place").alias("doc_id"), "text"), **options).where("kept").select(F.col("doc_id").alias("place"))
    return placed.join(verdict, "place", "left_semi").select("row.*").unionByName(unnamed)
