"""Language-model scores by subword lattice likelihood.

The pieces of a public vocabulary, with the bytes as a last resort, span a lattice over each word; a
word's probability is the sum over all its segmentations of the product of the pieces' probabilities, by
a forward recursion in log space.  Pieces start from the vocabulary's own scores and are fitted by expectation
maximisation on the words of all training documents, whose end is one more piece; piece sequences that
end so have total probability 1.  A document's score is the log10 of that marginal probability over its words and end.

Beside it stands word_arc_score, in which each training word is one more arc over its whole length, with its count less
a discount D over all tokens; the discounts' sum is the weight of the segmentations into pieces.

Word counts follow the corpus, so they are never broadcast whole: a head of at most `HEAD` frequent words
goes to every task, counts of the other words of each document are joined by word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_remainder, saved, slices, tokenizer_file
from .textkernel import KeyTable, Words, word_keys

HEAD = 1 << 17
#: Words kept by a task while it counts or scores; beyond, counts are handed on and scores made anew.
TASK_WORDS = 300_000
ROUNDS = 3
#: Bytes of words that share one round of array work.
BLOCK_BYTES = 100_000
#: Weight of a piece's rank where scores are ranks (as in merge vocabularies): p ~ 1 / (rank + RANK_SHIFT).
RANK_SHIFT = 50.0
SPACE_MARK = "▁"
#: What each piece has beside its expected count, so that none is impossible.
FLOOR = 0.01


def vocabulary(file: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (0x20 begins a word) with probabilities from their scores; all bytes are pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    weight: dict[bytes, float] = {bytes([i]): 1e-7 for i in range(256)}
    ranks = [model.get_score(i) for i in range(model.get_piece_size())]
    as_ranks = min(ranks) < -1000
    for i, score in enumerate(ranks):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        raw = model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        if b" " in raw[1:]:
            continue
        weight[raw] = weight.get(raw, 0.0) + (1 / (RANK_SHIFT - score) if as_ranks else math.exp(score))
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, p / p.sum()


class Lattice:
    """Marginal log probabilities of words over all segmentations, and expected counts of pieces.

    A byte trie of the pieces is walked from every place of many words at once; the arcs found are sorted by
    the place where they end, and each place takes one step of the recursion for all words.
    """

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = np.asarray(log_p, np.float64)
        nodes: dict[bytes, int] = {b"": 0}
        for x in pieces:
            for k in range(1, len(x) + 1):
                nodes.setdefault(x[:k], len(nodes))
        self.child = np.zeros((len(nodes), 256), np.uint16 if len(nodes) < 1 << 16 else np.uint32)  # 0: none
        for x, i in nodes.items():
            if x:
                self.child[nodes[x[:-1]], x[-1]] = i
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[nodes[x] for x in pieces]] = np.arange(len(pieces))

    def scores(self, words: list[bytes], weight: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word (with its leading space); fills `counts` if given."""
        out, a, held = np.zeros(len(words)), 0, 0
        for i, x in enumerate(words):
            held += len(x)
            if held >= BLOCK_BYTES or i == len(words) - 1:
                out[a : i + 1] = self._block(words[a : i + 1], None if counts is None else weight[a : i + 1], counts)
                a, held = i + 1, 0
        return out

    def _block(self, words: list[bytes], weight, counts) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(size.size), size)
        ends = np.cumsum(size)
        at, node, depth = np.arange(data.size), self.child[0, data], 1
        found: list[tuple] = []
        while at.size:
            alive = np.flatnonzero(node)
            at, node = at[alive], node[alive]
            piece = self.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], at[hit] + depth, piece[hit]))
            more = np.flatnonzero(at + depth < ends[word[at]])
            at = at[more]
            node = self.child[node[more], data[at + depth]]
            depth += 1
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        of = word[start]
        first = (ends - size)[of]
        # every word has one place more than bytes
        source, target, cost = start + of, end + of, self.log_p[piece]
        alpha = self._sweep(source, target, end - first, cost, ends - size + np.arange(size.size), data.size + size.size)
        last = ends + np.arange(size.size)
        total = alpha[last]
        if counts is not None:
            beta = self._sweep(target, source, ends[of] - start, cost, last, data.size + size.size)
            counts += np.bincount(piece, np.exp(alpha[source] + cost + beta[target] - total[of]) * weight[of], minlength=counts.size)
        return total

    @staticmethod
    def _sweep(source, target, step, cost, origin, places) -> np.ndarray:
        """Log sums of all paths from each word's origin; arcs are taken by their step."""
        order = np.argsort(step * (places + 1) + target)
        source, target, step, cost = source[order], target[order], step[order], cost[order]
        value = np.full(places, -np.inf)
        value[origin] = 0.0
        fresh = np.concatenate([[True], target[1:] != target[:-1]])
        bounds = np.searchsorted(step, np.arange(1, step[-1] + 2))
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            term = value[source[a:b]] + cost[a:b]
            head = np.flatnonzero(fresh[a:b])
            top = np.maximum.reduceat(term, head)
            term = np.exp(term - np.repeat(top, np.diff(np.append(head, b - a))))
            value[target[a:b][head]] = top + np.log(np.add.reduceat(term, head))
        return value


class Counter:
    """Words seen by a task, numbered, with their bytes."""

    def __init__(self):
        self.table, self.words = KeyTable(1 << 18), []

    def numbers(self, words: Words) -> tuple[np.ndarray, int]:
        """Number of each word, and how many were known before."""
        before = self.table.known
        key, check = word_keys(words.folded, words.start, words.end)
        at = self.table.find(key, check)
        new = np.flatnonzero(at < 0)
        if new.size:
            _, first = np.unique(key[new], return_index=True)
            first = new[first]
            raw = words.folded.tobytes()
            self.words += [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
            self.table.insert(key[first], check[first])
            at[new] = self.table.find(key[new], check[new])
        return at, before


def _count_rows(batches):
    seen, uses = Counter(), np.zeros(0, np.int64)

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(seen.words, pa.binary()), pa.array(uses)], names=["word", "n"])

    for batch in batches:
        text = batch.column("text")
        for lo, hi in slices(text):
            at, _ = seen.numbers(Words(text[lo:hi]))
            now = np.bincount(at, minlength=seen.table.known)
            now[: uses.size] += uses
            uses = now
            if seen.table.known > TASK_WORDS:
                yield flush()
                seen, uses = Counter(), np.zeros(0, np.int64)
    if uses.size:
        yield flush()


def _expect_rows(model):
    def run(batches):
        pieces, log_p = model.value
        lattice, counts = Lattice(pieces, log_p), np.zeros(len(pieces))
        for batch in batches:
            words = [b" " + x for x in batch.column("word").to_pylist()]
            lattice.scores(words, batch.column("n").to_numpy().astype(np.float64), counts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["piece", "n"])

    return run


def fit(counts: DataFrame, documents: int, file: str, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, float]:
    """Pieces, their natural log probabilities and that of the end, from all training words."""
    spark = counts.sparkSession
    pieces, p = vocabulary(file)
    end = 0.02
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, np.log(p)))
        # a row for each piece of the vocabulary at most reaches the driver
        got = arrow_map(counts, _expect_rows(model), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(len(pieces))
        n[got["piece"].to_numpy(np.int64)] = got["n"].to_numpy()
        if not n.sum():
            break
        end = (documents + FLOOR) / (n.sum() + documents + FLOOR * (n.size + 1))
        p = (n + FLOOR) / (n + FLOOR).sum()
    return pieces, np.log(p) + math.log1p(-end), math.log(end)


def _score_rows(model, head, parts: tuple[float, float, float, float, float]):
    discount, tokens, weight, end, piece_end = parts

    def run(batches):
        from pyspark import TaskContext

        pieces, log_p, _ = model.value
        frequent = head.value
        lattice, seen = Lattice(pieces, log_p), Counter()
        value, count, total = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                n = hi - lo
                if seen.table.known > TASK_WORDS:
                    seen, value, count, total = Counter(), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
                words = Words(text[lo:hi])
                at, before = seen.numbers(words)
                fresh = seen.words[before:]
                pieced = math.log(weight) + lattice.scores([b" " + x for x in fresh])
                c = np.fromiter((frequent.get(x, -1) for x in fresh), np.int64, len(fresh))
                value, count = np.concatenate([value, pieced]), np.concatenate([count, c])
                whole = np.full(c.size, -np.inf)
                held = np.flatnonzero(c > discount)
                whole[held] = np.log((c[held] - discount) / tokens)
                total = np.concatenate([total, np.where(c < 0, 0.0, np.logaddexp(whole, pieced) / math.log(10))])
                of = words.text_of_word()
                score = np.bincount(of, total[at], minlength=n) + end
                pieces_alone = np.bincount(of, (value[at] - math.log(weight)) / math.log(10), minlength=n) + piece_end
                c = count[at]
                head_known = np.bincount(of, c >= 0, minlength=n)
                # sum of log10(c + 1); the divisor is the same for all tokens
                head_log = np.bincount(of, np.log10(np.maximum(c, 0) + 1.0), minlength=n)
                rare = np.flatnonzero(c < 0)
                pair, times = np.unique((of[rare].astype(np.int64) << 32) | at[rare], return_counts=True)
                which = pair & 0xFFFFFFFF
                tail = [seen.words[i] for i in which.tolist()]
                cut = np.searchsorted(pair, np.arange(n + 1, dtype=np.int64) << 32).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(tail, pa.binary()), pa.array(times.astype(np.int64)), pa.array(value[which])], names=["word", "times", "pieced"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(words.count.astype(np.int64) + 1), pa.array(head_known.astype(np.int64)), pa.array(head_log), pa.array(score), pa.array(pieces_alone), lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "word_arc_score", "score", "tail"],
                )
                row += n

    return run


def head_words(counts: DataFrame, most: int = HEAD) -> dict[bytes, int]:
    """Frequent words, `most` at most: all of the least count (a power of 2) that this allows."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    held, least = 0, None
    for power, n in sizes:
        if held + n > most:
            break
        held, least = held + n, power
    if least is None:
        return {}
    return {bytes(w): n for w, n in counts.where(F.col("n") >= 2**least).collect()}


def score_documents(docs: DataFrame, file: str | None = None, mod: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_arc_score for every row of `docs`.

    Null and wordless texts are the end alone; null ids count as training documents; repeated rows count each; very
    long texts and words have their whole cost; other columns are not read; without training documents the
    pieces keep the vocabulary's own scores and every c, N and V is 0; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    file = file or tokenizer_file("piece_bpe_32k.model")
    out = F.coalesce(id_remainder(mod) == held, F.lit(False))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text"))
    training = text.where(~F.col("held_out"))
    counts = saved(arrow_map(training.select("text"), _count_rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    documents = training.select("held_out").count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    n, v = total["n"] + documents, total["v"] + (documents > 0)

    fitted = fit(counts, documents, file)
    discount = total["once"] / (total["once"] + 2 * total["twice"]) if total["once"] else 0.5
    weight = discount * v / n if n else 1.0
    end = math.log10(max(documents - discount, 0) / max(n, 1) + weight * math.exp(fitted[2]))
    model, head = spark.sparkContext.broadcast(fitted), spark.sparkContext.broadcast(head_words(counts))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, word_arc_score double, score double, tail array<struct<word: binary, times: long, pieced: double>>"
    scored = saved(arrow_map(text, _score_rows(model, head, (discount, max(n, 1), weight, end, fitted[2] / math.log(10))), schema), "scored")

    # natural logs throughout: a long word's probability is below the least double
    whole = F.ln((F.col("n") - F.lit(discount)) / F.lit(float(max(n, 1))))
    both = F.greatest(whole, "pieced") + F.log1p(F.exp(-F.abs(whole - F.col("pieced"))))
    word_log = F.when(F.col("n") > F.lit(discount), both).otherwise(F.col("pieced")) / F.lit(math.log(10))
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times", "t.pieced").join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("tail_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("tail_logs"),
        F.sum(F.col("times") * word_log).alias("tail_score"),
    )
    divisor = math.log10(n + 1 * (v + 1))
    end_log = math.log10(documents + 1)
    rows = scored.drop("tail").join(tail, "row", "left")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(documents > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) + end_log - F.col("n_tokens") * divisor).alias("base_score"),
        "score",
        (F.col("word_arc_score") + F.coalesce("tail_score", F.lit(0.0))).alias("word_arc_score"),
    )
