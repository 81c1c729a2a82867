"""Quality rules: base counts of a text, and a line labelling by a linear-chain conditional random field.

Every line of a text is content or boilerplate.  Binary features of a line's own look and of its neighbour's
label score each labelling; Viterbi decoding picks the best one.  A document stays if its base counts pass and
half of its words or more stand in content lines.

Weights are fitted by conditional likelihood (forward-backward, Adam) on a bounded sample of labelled documents.  What
their lines count as comes from evidence that is no feature of a line: every line of a document labelled poor is
boilerplate, and so is a line that occurs all over the corpus in many different surroundings (counted over all
documents; copies of one document give one surrounding); all other lines of good documents are content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices
from .textkernel import LOWER, MULTIPLY, SPACE, Words, buffers, hashes, mix

U = np.uint64
#: Labelled documents that the weights are fitted on (expected number; drawn by a hash of doc_id).
SAMPLE_DOCS = 3000
#: Fitting cuts longer documents into chains of so many lines.
CHAIN_LINES = 200
#: A line is shared by the corpus with so many distinct surroundings, if they are half of its occurrences or more.
SURROUNDINGS = 5
#: Bits of the filter that keeps lines of the sample while all lines are counted.
FILTER_BITS = 1 << 22
STEPS, RATE, DECAY = 200, 0.05, 1e-3
CONTENT_SHARE = 0.5

FEATURES = ("any", "no_word", "under_3_words", "over_9_words", "some_symbols", "many_symbols", "many_digits", "mostly_capitals", "closed_sentence", "bar", "repeated_line", "few_letters", "stuttering", "mostly_titled", "first_line", "last_line")
K = len(FEATURES)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, DIGIT, BAR, STOP = _table(b"#*$%&|<>"), _table(b"0123456789"), _table(b"|"), _table(b".!?")
UPPER = _table(bytes(range(65, 91)))
LETTER = UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(128, 256)))
_FOLD = LOWER.copy()
_FOLD[48:58] = 48


class Lines:
    """Base counts of each text of a slice, and lines with their features.

    first: len+1 line offsets of the texts; words: of each line; features: lines x K booleans.
    """

    def __init__(self, text: pa.Array):
        w = Words(text, lower=False)
        data, offsets, n = w.bytes, w.offsets, w.bytes.size
        docs = offsets.size - 1
        self.n_words = w.count.astype(np.int64)

        def total(mask, bounds):
            run = np.zeros(n + 1, np.int64)
            np.cumsum(mask, out=run[1:])
            return run[bounds[1:]] - run[bounds[:-1]]

        self.word_chars = total(w.ink & ((data & 0xC0) != 0x80), offsets)
        self.n_symbols = total(SYMBOL[data], offsets)

        # lines: \n ends one; every text has one more than it has \n
        breaks = np.flatnonzero(data == 10)
        of_break = np.searchsorted(offsets, breaks, "right") - 1
        per_doc = np.bincount(of_break, minlength=docs) + 1
        self.first = np.concatenate([[0], np.cumsum(per_doc)])
        start = np.empty(self.first[-1], np.int64)
        head = np.zeros(start.size, bool)
        head[self.first[:-1]] = True
        start[head], start[~head] = offsets[:-1], breaks + 1
        end = np.empty_like(start)
        last = np.zeros(start.size, bool)
        last[self.first[1:] - 1] = True
        end[last], end[~last] = offsets[1:], breaks
        of_line = np.repeat(np.arange(docs), per_doc)

        at = np.searchsorted(w.start, start)
        stop = np.searchsorted(w.start, end)
        self.words = stop - at
        key = mix(hashes(data, start, end) ^ (of_line.astype(np.uint64) * MULTIPLY[1]))
        live = np.flatnonzero(self.words > 0)
        _, once = np.unique(key[live], return_index=True)
        repeated = np.zeros(start.size, bool)
        repeated[live] = True
        repeated[live[once]] = False
        self.n_dup_lines = np.bincount(of_line[repeated], minlength=docs)

        # 3-word windows that occur twice or more in a text
        h = w.hash
        m = h.size
        of_word = w.text_of_word()
        covered = np.zeros(m, bool)
        if m >= 3:
            window = mix(h[:-2] * MULTIPLY[0] + h[1:-1] * MULTIPLY[1] + h[2:] * MULTIPLY[2] + of_word[:-2].astype(np.uint64) * MULTIPLY[4])
            inside = np.flatnonzero(of_word[:-2] == of_word[2:])
            order = inside[np.argsort(window[inside])]
            sorted_keys = window[order]
            same = np.zeros(order.size, bool)
            same[1:] = sorted_keys[1:] == sorted_keys[:-1]
            same[:-1] |= same[1:]
            twice = np.zeros(m + 2, bool)
            twice[order[same]] = True
            covered = twice[:m].copy()
            covered[1:] |= twice[: m - 1]
            covered[2:] |= twice[: m - 2]
        self.n_repeat_words = np.bincount(of_word[covered], minlength=docs)

        runs = {name: np.concatenate([[0], np.cumsum(mask)]) for name, mask in (("ink", w.ink), ("symbol", SYMBOL[data]), ("digit", DIGIT[data]), ("upper", UPPER[data]), ("letter", LETTER[data]), ("bar", BAR[data]))}
        within = {name: run[end] - run[start] for name, run in runs.items()}
        stutter = np.zeros(m, bool)
        stutter[1:] = h[1:] == h[:-1]
        stuttered = np.concatenate([[0], np.cumsum(stutter)])
        titled = np.concatenate([[0], np.cumsum(UPPER[data[w.start]])])
        final = np.zeros(start.size, bool)
        has = np.flatnonzero(self.words > 0)
        final[has] = STOP[data[w.end[stop[has] - 1] - 1]]
        ink = np.maximum(within["ink"], 1)
        f = np.zeros((start.size, K), bool)
        f[:, 0] = True
        f[:, 1], f[:, 2], f[:, 3] = self.words == 0, self.words < 3, self.words > 9
        f[:, 4], f[:, 5] = within["symbol"] * 20 >= ink, within["symbol"] * 5 >= ink
        f[:, 6] = within["digit"] * 5 >= ink
        f[:, 7] = (within["upper"] * 2 > within["letter"]) & (self.words > 0)
        f[:, 8], f[:, 9], f[:, 10] = final, within["bar"] > 1, repeated
        f[:, 11] = within["letter"] * 2 < ink
        f[:, 12] = 2 * (stuttered[stop] - stuttered[at]) > self.words
        f[:, 13] = (2 * (titled[stop] - titled[at]) > self.words) & (self.words > 1)
        f[:, 14], f[:, 15] = head, last
        self.features = f


def line_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each line (case and digits folded; 0 without a word), of its surroundings, and the texts' line offsets."""
    data, offsets = buffers(text)
    docs = offsets.size - 1
    breaks = np.flatnonzero(data == 10)
    per_doc = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=docs) + 1
    first = np.concatenate([[0], np.cumsum(per_doc)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head, last = np.zeros(start.size, bool), np.zeros(start.size, bool)
    head[first[:-1]], last[first[1:] - 1] = True, True
    start[head], start[~head] = offsets[:-1], breaks + 1
    end[last], end[~last] = offsets[1:], breaks
    ink = np.concatenate([[0], np.cumsum(~SPACE[data])])
    key = np.where(ink[end] > ink[start], hashes(_FOLD[data], start, end) | U(1), U(0))
    before, after = np.zeros_like(key), np.zeros_like(key)
    before[1:], after[:-1] = key[:-1], key[1:]
    before[head], after[last] = 0, 0
    return key, mix(before * MULTIPLY[0] + after * MULTIPLY[1]), first


def steps(first: np.ndarray):
    """Lines at each place of their texts: k -> (texts that are longer than k, their lines)."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, (size.max() if size.size else 0) + 1), "right")
    for k, n in enumerate(live.tolist()):
        yield order[:n], first[order[:n]] + k


class LineField:
    """Two-label linear chain: weights of features for each label, and of label pairs."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((K, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of all lines; ties to content (0)."""
        score = features @ self.emit
        back = np.zeros(score.shape, np.int8)
        state = np.zeros((first.size - 1, 2))
        held = list(steps(first))
        for k, (docs, lines) in enumerate(held):
            if k == 0:
                state[docs] = score[lines]
                continue
            ways = state[docs][:, :, None] + self.move[None]
            back[lines] = ways.argmax(1)
            state[docs] = ways.max(1) + score[lines]
        label = np.zeros(len(score), np.int8)
        now = state.argmax(1).astype(np.int8)
        for k in range(len(held) - 1, -1, -1):
            docs, lines = held[k]
            label[lines] = now[docs]
            now[docs] = back[lines, now[docs]]
        return label

    def gradient(self, features: np.ndarray, first: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the labels and its gradient."""
        score = features @ self.emit
        held = list(steps(first))
        alpha, beta = np.zeros(score.shape), np.zeros(score.shape)
        for k, (docs, lines) in enumerate(held):
            alpha[lines] = score[lines] if k == 0 else np.logaddexp.reduce(alpha[lines - 1][:, :, None] + self.move[None], axis=1) + score[lines]
        for k in range(len(held) - 2, -1, -1):
            _, after = held[k + 1]
            beta[after - 1] = np.logaddexp.reduce(self.move[None] + (score[after] + beta[after])[:, None, :], axis=2)
        z = np.repeat(np.logaddexp.reduce(alpha[first[1:] - 1], axis=1), np.diff(first))
        p = np.exp(alpha + beta - z[:, None])
        inner = np.ones(len(score), bool)
        inner[first[:-1]] = False
        inner = np.flatnonzero(inner)
        pair = np.exp(alpha[inner - 1][:, :, None] + self.move[None] + (score[inner] + beta[inner])[:, None, :] - z[inner][:, None, None])
        real = np.eye(2)[truth]
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
        value = float((score * real).sum() + (seen * self.move).sum() - z[first[:-1]].sum())
        return value, features.T @ (real - p), seen - pair.sum(0)

    def fit(self, features: np.ndarray, first: np.ndarray, truth: np.ndarray) -> LineField:
        if not len(features):
            return self
        x = features.astype(np.float64)
        weights, m, v = [self.emit, self.move], [0.0, 0.0], [0.0, 0.0]
        for step in range(1, STEPS + 1):
            _, *grad = self.gradient(x, first, truth)
            for i, (w, g) in enumerate(zip(weights, grad)):
                g = -g / len(x) + DECAY * w
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                w -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return self


def _sample_rows(batches):
    for batch in batches:
        text = batch.column("text")
        for lo, hi in slices(text):
            lines = Lines(text[lo:hi])
            packed = np.packbits(lines.features, axis=1)
            keys, _, _ = line_keys(text[lo:hi])
            cut = list(zip(lines.first.tolist(), lines.first[1:].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("poor")[lo:hi], pa.array([packed[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "poor", "features", "keys"])


def _occurrences(wanted):
    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                key, around, _ = line_keys(text[lo:hi])
                slot = (key & U(FILTER_BITS - 1)).astype(np.int64)
                some = np.flatnonzero((key > 0) & (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool))
                pair, n = np.unique(np.stack([key[some], around[some]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64)), pa.array(n)], names=["line", "around", "n"])

    return run


def shared_lines(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Those of the sample's line keys that occur in many surroundings, counted over all of `docs` (column text)."""
    spark, keys = docs.sparkSession, np.unique(keys[keys > 0])
    bits = np.zeros(FILTER_BITS, bool)
    bits[(keys & U(FILTER_BITS - 1)).astype(np.int64)] = True
    wanted = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    found = arrow_map(docs.select("text"), _occurrences(wanted), "line long, around long, n long").groupBy("line", "around").agg(F.sum("n").alias("n"))
    often = found.groupBy("line").agg(F.count("*").alias("places"), F.sum("n").alias("n")).where((F.col("places") >= SURROUNDINGS) & (2 * F.col("places") >= F.col("n")))
    # the sample's own lines only, of which there is a bounded number of documents
    own = spark.createDataFrame(pa.table({"line": pa.array(keys.view(np.int64))}))
    got = often.join(own, "line", "left_semi").select("line").toArrow()
    return got["line"].to_numpy().view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE_DOCS) -> LineField:
    """Weights from about `sample` documents that `labels` (doc_id, quality) marks; from any documents without `labels`.

    Several labels of one document count as the least of them; null labels and ids do not count.  Where nothing is
    labelled, all weights are 0 and every line is content.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("octet_length(text) > 0")
    if labels is None:
        pool = text.withColumn("poor", F.lit(False))
    else:
        marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).alias("poor"))
        pool = marked
    count = pool.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(1_000_003.0 * sample / max(count, 1))
    # about `sample` rows of an id and a flag: a bound that holds at every size
    drawn = pool.where(draw) if labels is None else text.join(F.broadcast(pool.where(draw)), "doc_id")
    got = arrow_map(drawn.select("doc_id", "poor", "text"), _sample_rows, "doc_id long, poor boolean, features binary, keys binary").toPandas().sort_values(["doc_id", "features", "keys"])
    if not len(got):
        return LineField()
    keys = np.frombuffer(b"".join(got["keys"]), np.uint64)
    features = np.unpackbits(np.frombuffer(b"".join(got["features"]), np.uint8).reshape(-1, K // 8), axis=1).astype(bool)
    size = np.array([len(x) // 8 for x in got["keys"]])
    truth = np.repeat(got["poor"].to_numpy(bool), size) | np.isin(keys, shared_lines(text, keys))
    first = np.concatenate([[0], np.cumsum(size)])
    cuts = np.concatenate([np.arange(a, b, CHAIN_LINES) for a, b in zip(first[:-1].tolist(), first[1:].tolist())] + [first[-1:]])
    return LineField().fit(features, cuts, truth.astype(np.int64))


def _rule_rows(model, share: float):
    def run(batches):
        field = model.value
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                lines = Lines(text[lo:hi])
                content = field.viterbi(lines.features, lines.first) == 0
                run_sum = np.concatenate([[0], np.cumsum(lines.words * content)])
                kept_words = run_sum[lines.first[1:]] - run_sum[lines.first[:-1]]
                n = lines.n_words
                failed = (n < 50) | (100 * lines.n_repeat_words > 50 * n)
                part = kept_words / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], *(pa.array(x.astype(np.int64)) for x in (n, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)), pa.array(failed), pa.array(~failed & (part >= share)), pa.array(part)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
                )

    return run


def line_rules(docs: DataFrame, labels: DataFrame | None = None, share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts, base_failed, kept and content_share for every row of `docs`.

    Null and wordless texts have zero words, fail the base and are not kept; very long texts are labelled whole;
    repeated rows and null ids keep their rows; other columns are not read; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(text, _rule_rows(model, share), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
