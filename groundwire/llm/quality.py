"""Quality classifier: random-indexing word vectors, pooled, then a small calibrated network.

Random indexing (Kanerva and others, 2000): every word has a sparse ternary index vector, which its hash gives
without a table; its context vector is the sum of the index vectors around its occurrences in all documents.  Context
vectors are learned for words that make up more than one in `SHARES` of all words: there are fewer than
`SHARES` of these, which bounds what every task is given, at any size of the corpus.  A document is the
mean of its words' index and context vectors (rarer words have their index vector alone).  A two-layer network
in numpy gives a logit; a temperature fitted on withheld training rows calibrates its probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_remainder, saved, slices, whole_row, with_columns
from .textkernel import MULTIPLY, SPACE, buffers, hashes, mix

U = np.uint64
DIMENSIONS, NONZERO, REACH = 64, 6, 2
#: A word with more than one in SHARES of all words, and LEAST_USES uses or more, has a context vector.
SHARES, LEAST_USES = 1 << 17, 2
#: Labelled documents that the network is fitted on (expected number; drawn by a hash of doc_id).
SAMPLE_LABELS = 20_000
HIDDEN, PASSES, RATE, DECAY = 32, 60, 3e-3, 1e-4
#: Marks that stand in the stream as words: a word equal to the one before, and a word in capitals; 0 is no word.
REPEATED, CAPITALS = U(1), U(2)
WORK_ROWS = 1 << 16

_CLASS = np.full(256, 2, np.uint8)  # signs
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1
_CLASS[SPACE] = 3


def word_stream(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, of digits or of signs; case counts) with marks; offsets of the texts."""
    data, offsets = buffers(text)
    kind = _CLASS[data]
    n = data.size
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n) if start.size else start
    keep = np.flatnonzero(kind[start] != 3)
    start, end = start[keep], end[keep]
    h = hashes(data, start, end)
    first = np.searchsorted(start, offsets)
    h = np.maximum(h, U(3))
    same = np.zeros(h.size, bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < h.size]] = False
    upper = (data >= 65) & (data <= 90)
    capital = np.zeros(h.size, bool)
    long = np.flatnonzero(end - start > 1)
    capital[long] = upper[start[long]] & upper[start[long] + 1]
    extra = same.astype(np.int64) + capital
    if not extra.any():
        return h, first
    at = np.cumsum(extra + 1) - 1  # each word's mark, if any, stands before it
    out = np.empty(at[-1] + 1, np.uint64)
    out[at] = h
    out[at[same] - 1] = REPEATED
    both = capital & same
    out[at[capital & ~same] - 1] = CAPITALS
    out[at[both] - 2] = CAPITALS
    return out, np.concatenate([[0], at + 1])[first]


def index_places(words: np.ndarray) -> np.ndarray:
    """Dimensions (n, NONZERO) of the index vectors' entries, which are +1 and -1 in turn."""
    h = mix(words ^ MULTIPLY[2])
    return np.stack([(h >> U(6 * j)) & U(DIMENSIONS - 1) for j in range(NONZERO)], axis=1).astype(np.int64)


def index_vectors(words: np.ndarray) -> np.ndarray:
    """Index vectors of hashed words; zeros for 0, which is no word."""
    out = np.zeros((words.size, DIMENSIONS), np.int8)
    place, row = index_places(words), np.arange(words.size)
    for j in range(NONZERO):
        out[row, place[:, j]] += 1 - 2 * (j % 2)
    out[words == 0] = 0
    return out


def _word_counts(batches):
    for batch in batches:
        text = batch.column("text")
        for lo, hi in slices(text):
            word, n = np.unique(word_stream(text[lo:hi])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*word.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), int(n.sum())], pa.int64())], names=["word", "n"])


def common_words(text: DataFrame, shares: int = SHARES) -> np.ndarray:
    """Sorted hashes of the words that have context vectors: fewer than `shares`."""
    counts = saved(arrow_map(text, _word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= LEAST_USES)), "uses")
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = counts.where(F.col("word").isNotNull() & (F.col("n") * F.lit(shares) > total)).select("word").toArrow()
    return np.sort(got["word"].to_numpy().view(np.uint64))


def find(words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted word in the sorted words; -1 where it is not among them."""
    if not words.size:
        return np.full(wanted.size, -1)
    at = np.minimum(np.searchsorted(words, wanted), words.size - 1)
    return np.where(words[at] == wanted, at, -1)


def context_sums(stream: np.ndarray, first: np.ndarray, words: np.ndarray, total: np.ndarray, uses: np.ndarray) -> None:
    """Add the index vectors around each occurrence of `words` within its text to `total`, and their number to `uses`."""
    # places between texts keep contexts apart
    padded = np.concatenate([np.zeros(REACH, np.uint64), np.insert(stream, np.repeat(first[1:], REACH), 0)])
    for a in range(REACH, padded.size - REACH, WORK_ROWS):
        b = min(a + WORK_ROWS, padded.size - REACH)
        some, local = np.unique(padded[a - REACH : b + REACH], return_inverse=True)
        own = find(words, some)[local[REACH : local.size - REACH]]
        here = np.flatnonzero(own >= 0)
        here = here[np.argsort(own[here], kind="stable")]
        own = own[here]
        if not own.size:
            continue
        index = index_vectors(some).astype(np.int16)
        around = sum(index[local[here + REACH + j]] for j in range(-REACH, REACH + 1) if j)
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[head]] += np.add.reduceat(around, head, axis=0, dtype=np.int64)
        uses[own[head]] += np.diff(np.append(head, own.size))


def _context_rows(shared):
    def run(batches):
        words = shared.value
        total, uses = np.zeros((words.size, DIMENSIONS), np.int64), np.zeros(words.size, np.int64)
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                context_sums(*word_stream(text[lo:hi]), words, total, uses)
        seen = np.flatnonzero(uses)
        if seen.size:
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(uses[seen]), *(pa.array(np.ascontiguousarray(total[seen, j])) for j in range(DIMENSIONS))], names=["place", "uses", *(f"c{j}" for j in range(DIMENSIONS))])

    return run


def word_vectors(docs: DataFrame, shares: int = SHARES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common words, sorted, and their context vectors, learned from every text of `docs`."""
    names = [f"c{j}" for j in range(DIMENSIONS)]
    text = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    words = common_words(text, shares)
    rows = arrow_map(text, _context_rows(docs.sparkSession.sparkContext.broadcast(words)), "place long, uses long, " + ", ".join(f"{x} long" for x in names))
    # one row for each common word reaches the driver
    got = rows.groupBy("place").agg(F.sum("uses").alias("uses"), *(F.sum(x).alias(x) for x in names)).toPandas()
    out = np.zeros((words.size, DIMENSIONS), np.float32)
    if len(got):
        context = got[names].to_numpy(np.float64)
        uses = got["uses"].to_numpy(np.float64)
        context = context / uses[:, None] - context.sum(0) / uses.sum()
        size = np.sqrt((context**2).sum(1, keepdims=True))
        out[got["place"].to_numpy()] = context / np.maximum(size, 1e-9) * np.minimum(1, uses / 5)[:, None]
    return words, out


class Vectors:
    """Vectors of any words: a linear map of their index vectors beside (or, folded, added to) those of common words."""

    def __init__(self, words: np.ndarray, context: np.ndarray, index: np.ndarray, added: bool = False):
        self.words, self.context, self.index, self.added = words, context, index.astype(np.float32), added

    def of(self, words: np.ndarray) -> np.ndarray:
        place = index_places(words)
        own = sum((1 - 2 * (j % 2)) * self.index[place[:, j]] for j in range(NONZERO))
        at = find(self.words, words)
        held = np.flatnonzero(at >= 0)
        if self.added:
            own[held] += self.context[at[held]]
            return own
        out = np.zeros((words.size, own.shape[1] + self.context.shape[1]), np.float32)
        out[:, : own.shape[1]] = own
        out[held, own.shape[1] :] = self.context[at[held]]
        return out


def plain(words: np.ndarray, context: np.ndarray) -> Vectors:
    """Index vectors of length 1, then context vectors."""
    return Vectors(words, context, np.eye(DIMENSIONS) / np.sqrt(NONZERO))


def pooled(stream: np.ndarray, first: np.ndarray, vectors: Vectors) -> np.ndarray:
    """Mean of the words' vectors of each text; zeros without words."""
    count = np.diff(first)
    out = np.zeros((count.size, vectors.of(stream[:0]).shape[1]))
    text = np.repeat(np.arange(count.size), count)
    for a in range(0, stream.size, WORK_ROWS):
        some, local = np.unique(stream[a : a + WORK_ROWS], return_inverse=True)
        of = text[a : a + WORK_ROWS]
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[head]] += np.add.reduceat(vectors.of(some)[local], head, axis=0, dtype=np.float64)
    return out / np.maximum(count, 1)[:, None]


def _feature_rows(shared):
    def run(batches):
        vectors = plain(*shared.value)
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                x = pooled(*word_stream(text[lo:hi]), vectors).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("label")[lo:hi], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    return run


class Network:
    """Two layers over standardised inputs; `fit` trains with Adam, then fits the temperature."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = RATE, seed: int = 11) -> Network:
        if not len(y):
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held = order[: len(y) // 7] if len(y) >= 70 else order[:0]
        used = order[held.size :]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-3
        share = np.clip(y[used].mean(), 0.01, 0.99)
        self.weights[3][:] = np.log(share / (1 - share))
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(passes):
            for rows in np.array_split(rng.permutation(used), max(1, used.size // 128)):
                z = (x[rows] - self.mean) / self.scale
                w1, b1, w2, b2 = self.weights
                h = np.tanh(z @ w1 + b1)
                error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - y[rows]) / rows.size
                back = error[:, None] * w2 * (1 - h**2)
                step += 1
                for w, g, m, v in zip(self.weights, [z.T @ back + DECAY * w1, back.sum(0), h.T @ error + DECAY * w2, error.sum(keepdims=True)], first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        check = held if held.size else used
        logit, truth = self.logits(x[check]), y[check]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -logit, logit) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def folded(self, words: np.ndarray, context: np.ndarray) -> tuple[Vectors, np.ndarray, np.ndarray, float]:
        """The first layer applied to word vectors: pooling and that layer are both linear."""
        w1, b1, w2, b2 = self.weights
        inner = w1 / self.scale[:, None]
        vectors = Vectors(words, (context @ inner[DIMENSIONS:]).astype(np.float32), inner[:DIMENSIONS] / np.sqrt(NONZERO), added=True)
        return vectors, b1 - self.mean @ inner, w2 / self.temperature, float(b2[0] / self.temperature)


def fit(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, sample: int = SAMPLE_LABELS) -> tuple[np.ndarray, np.ndarray, Network]:
    """Common words with their context vectors, from all of `docs`, and the network from labelled rows that are not held out.

    Several labels of one document count as the least of them; null labels and null ids do not count.  All texts of
    one id are learned from.
    """
    spark = docs.sparkSession
    words, context = word_vectors(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_remainder(held_out_mod) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    count = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(1_000_003.0 * sample / max(count, 1)))
    # about `sample` rows of two numbers: a bound that holds at every size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")
    got = arrow_map(rows, _feature_rows(spark.sparkContext.broadcast((words, context))), "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.stack([np.frombuffer(b, "<f4") for b in got["x"]]).astype(np.float64) if len(got) else np.zeros((0, 2 * DIMENSIONS))
    return words, context, Network(2 * DIMENSIONS).fit(x, got["label"].to_numpy(np.float64))


def _score_rows(model):
    def run(batches):
        vectors, bias, outer, shift = model.value
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                h = np.tanh(pooled(*word_stream(text[lo:hi]), vectors) + bias)
                p = 1 / (1 + np.exp(-np.clip(h @ outer + shift, -60, 60)))
                yield pa.RecordBatch.from_arrays([batch.column("row")[lo:hi], pa.array(p)], names=["row", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (all columns of a row of `docs`) and score, the probability of label 1."""
    words, context, network = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(network.folded(words, context))
    row = whole_row(docs)
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _score_rows(model), with_columns(docs.select(row).schema, score="double"))


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Null and empty texts get the score of a document without words; very long texts are read whole, in windows; without
    labels every score is that of an untrained network; a null id is not held out; repeated rows have a
    row each; other columns are not read, whatever their names; an empty table gives an empty result.
    """
    rows = scored(docs.select("doc_id", "text"), labels)
    remainder = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5
    return rows.select("row.doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows of `docs`, all columns, that are predicted to be good.

    Null and empty texts are judged like a document without words; null ids and repeated rows stay as they are;
    columns of any name pass through; an empty table gives an empty result.
    """
    return scored(docs, labels).where(F.col("score") >= least).select("row.*")
