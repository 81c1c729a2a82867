"""Language identification by prediction by partial matching over bytes.

For each language a variable-order context tree holds which bytes followed every context of up to
`ORDER` bytes.  With escape method C a byte that followed its context c times of n, among d distinct
bytes, costs -log2(c / (n + d)); an unseen byte first pays the escape -log2(d / (n + d)) and then its cost in
the next shorter context, down to a uniform byte.  Statistics are frozen after training, so the cost of a byte
is a function of its (ORDER + 1)-gram: exact code lengths of whole texts are sums over table lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_remainder, saved, slices, whole_row, with_columns
from .textkernel import LOWER, MULTIPLY, buffers

U = np.uint64
ORDER = 3
#: Training documents drawn for each language (expected number; the draw is a hash of doc_id).  This bound on the labelled
#: rows is the only one: all grams of the drawn texts count.
SAMPLE_DOCS = 3000
#: Languages that share one cost table, and tables that a worker holds at once; further tables are read for each slice.
GROUP, HELD_GROUPS = 5, 6
UNDETERMINED = "und"
#: Bytes whose costs are looked up in one round.
WINDOW = 1 << 19


def grams(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The k bytes up to each place as a number below 2^(8k); bytes before a text count as 0."""
    out = data.astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for j in range(1, k):
        before = np.zeros_like(out)
        before[j:] = data[:-j]
        for i in range(j):  # the first j bytes of a text have nothing of it before them
            near = starts + i
            before[near[near < np.append(starts[1:], data.size)]] = 0
        out |= before << np.uint32(8 * j)
    return out


def _count_rows(order: int):
    def run(batches):
        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang")
            for lo, hi in slices(text):
                names = lang[lo:hi].to_numpy(zero_copy_only=False).astype(str)
                for name in np.unique(names).tolist():
                    raw = pa.array([x.as_py().encode() for x, y in zip(text[lo:hi], names) if y == name], pa.binary())
                    data, offsets = buffers(raw)
                    code, n = np.unique(grams(LOWER[data], offsets, order + 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * code.size), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


class PPM:
    """Frozen statistics of several languages as one hash table of gram -> cost in each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """counts: for each language the distinct (order + 1)-grams and their counts."""
        self.order, self.languages = order, sorted(counts)
        levels: list[list[tuple]] = []
        for name in self.languages:
            code, n = counts[name]
            own = []
            for k in range(order + 1):  # k bytes of context
                mask = (1 << 8 * (k + 1)) - 1
                gram, at = np.unique(code & mask, return_inverse=True)
                own.append((gram, np.bincount(at, n)))
            levels.append(own)
        # each order has the union of the languages' grams; what a language lacks it escapes from
        self.tables = []
        uniform = np.full((1, len(self.languages)), 8.0, np.float32)
        below = (np.zeros(1, np.int64), uniform)
        self.below = below
        self.escapes = []
        for k in range(order + 1):
            union = np.unique(np.concatenate([own[k][0] for own in levels])) if levels else np.zeros(0, np.int64)
            cost = self._fallback(union, k)
            context = np.unique(union >> 8)
            escape = np.zeros((context.size, len(self.languages)), np.float32)
            for j, own in enumerate(levels):
                gram, n = own[k]
                held, at = np.unique(gram >> 8, return_inverse=True)
                total, distinct = np.bincount(at, n), np.bincount(at)
                escape[np.searchsorted(context, held), j] = -np.log2(distinct / (total + distinct))
                # grams that this language lacks pay its escape from their context, where it knows that
                cost[:, j] += escape[np.searchsorted(context, union >> 8), j]
                cost[np.searchsorted(union, gram), j] = -np.log2(n / (total + distinct)[at])
            self.tables.append(Hashed(union, cost))
            self.escapes.append(Hashed(context, escape))

    def _fallback(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Costs after the escape from the k-byte context, for grams of k + 1 bytes."""
        if k == 0:
            return np.full((gram.size, len(self.languages)), 8.0, np.float32)
        return self.lookup(gram & ((1 << 8 * k) - 1), k - 1)

    def lookup(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Cost in bits of the last byte of each (k + 1)-gram, in each language."""
        at = self.tables[k].find(gram)
        out = self.tables[k].values[at]
        lost = np.flatnonzero(at == self.tables[k].missing)
        if lost.size:
            rest = self._fallback(gram[lost], k)
            out[lost] = rest + self.escapes[k].values[self.escapes[k].find(gram[lost] >> 8)]
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length of each text in each language."""
        out = np.zeros((offsets.size - 1, len(self.languages)))
        gram = grams(LOWER[data], offsets, self.order + 1)
        for a in range(0, data.size, WINDOW):
            b = min(a + WINDOW, data.size)
            cost = self.lookup(gram[a:b].astype(np.int64), self.order)
            first = np.searchsorted(offsets, a, "right") - 1
            last = np.searchsorted(offsets, b - 1, "right") - 1
            text = np.repeat(np.arange(last - first + 1), np.diff(np.clip(offsets[first : last + 2], a, b)))
            for j in range(cost.shape[1]):
                out[first : last + 1, j] += np.bincount(text, cost[:, j], minlength=last - first + 1)
        return out


class Hashed:
    """Open-address table of non-negative numbers to rows of values; the last row stands for none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(4, int(keys.size * 3).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        self.rows = np.full(self.mask + 1, keys.size, np.int32)
        self.values = np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)])
        self.missing = keys.size
        slot, left = self._slot(keys), np.arange(keys.size)
        while left.size:
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = keys[free]
            self.rows[slot[free]] = free
            left = left[self.slots[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        # of equal slots the last key written stays, and its row with it
        self.rows[slot] = np.arange(keys.size)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULTIPLY[0]) >> U(40)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.slots[slot]
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while wrong.size:
            slot[wrong] = (slot[wrong] + 1) & self.mask
            held = self.slots[slot[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return self.rows[slot]


def train(docs: DataFrame, held_out_mod: int = 5, sample_docs: int = SAMPLE_DOCS) -> list[Broadcast]:
    """Models of all languages, `GROUP` in each, by name; from documents with text and lang whose id has a remainder that is not 0.

    About `sample_docs` documents of each language, drawn by a hash of doc_id, give the statistics.  A language's
    costs do not depend on the others of its group.
    """
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(held_out_mod) != 0))
    sizes = usable.groupBy("lang").count()
    share = sizes.select("lang", (F.lit(float(sample_docs)) / F.col("count")).alias("share"))
    draw = (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)) < F.col("share")
    drawn = usable.join(F.broadcast(share), "lang").where(draw).select("lang", "text")
    counted = arrow_map(drawn, _count_rows(ORDER), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = saved(counted, "grams")
    names = sorted(row["lang"] for row in counted.select("lang").distinct().collect())
    models = []
    for a in range(0, len(names), GROUP):  # the driver has one group's counts at a time
        part = counted.where(F.col("lang").isin(names[a : a + GROUP])).toPandas()
        models.append(docs.sparkSession.sparkContext.broadcast(PPM({name: (own["gram"].to_numpy(), own["n"].to_numpy()) for name, own in part.groupby("lang")})))
    return models


def _costs(models, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All languages by name, and the exact code length of each text in each."""
    names, bits = [], []
    for k, shared in enumerate(models):
        ppm = shared.value
        names += ppm.languages
        bits.append(ppm.bits(data, offsets))
        if k >= HELD_GROUPS and getattr(shared, "_path", None):
            del ppm, shared._value  # the next use reads it from the executor's disk
    return names, np.concatenate(bits, 1)


def _predict(models):
    def run(batches):
        for batch in batches:
            text, letter = batch.column("text"), batch.column("letter")
            for lo, hi in slices(text):
                n = hi - lo
                data, offsets = buffers(text[lo:hi])
                ok = letter[lo:hi].to_numpy(zero_copy_only=False) & bool(models)
                names, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                if models:
                    learned, bits = _costs(models, data, offsets)
                    low = bits.min(1)
                    best = bits.argmin(1)
                    p = 1 / np.exp2(np.clip(low[:, None] - bits, -1000, 0)).sum(1)
                    names[ok], score[ok] = np.array(learned, object)[best[ok]], p[ok]
                yield pa.RecordBatch.from_arrays([batch.column("row")[lo:hi], pa.array(names, pa.string()), pa.array(score)], names=["row", "lang", "score"])

    return run


def identify(docs: DataFrame, models: list[Broadcast]) -> DataFrame:
    """row (all columns of a row of `docs`), lang and score.

    lang is `und` (score 0) where the text is null, empty or has no letter, or no language was learned;
    else the language with the shortest code, ties to the first by name, and its share of the
    likelihoods.  Very long texts are read in windows; repeated rows are judged each.
    """
    text = F.col("text").cast("string")
    row = whole_row(docs)
    rows = docs.select(row, text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letter"))
    return arrow_map(rows, _predict(models), with_columns(docs.select(row).schema, lang="string", score="double"))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`.

    A null id is not held out; repeated rows have a row each; null, empty and letterless texts are `und` with score 0;
    other columns are not read, whatever their names; an empty table gives an empty result.
    """
    rows = identify(docs.select("doc_id", "text"), train(docs))
    remainder = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5
    return rows.select("row.doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of `docs`, all columns, whose language is recognised with a score of `least` or more.

    Null, empty and letterless texts go; null ids and repeated rows stay as they are; columns of any name pass
    through; an empty table, or one without a labelled text to learn from, gives an empty result.
    """
    rows = identify(docs, train(docs))
    return rows.where((F.col("lang") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
