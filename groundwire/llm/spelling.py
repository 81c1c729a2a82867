"""Spelling variants by Aho-Corasick automata over halves of words.

A word that one inserted, deleted or replaced code point makes of another leaves one of its two halves as it was: the
first half stands at the start of the variant, or the second at its end.  So every word's halves become patterns of
automata, and every word is scanned: a hit counts if it lies at the start (first half) or the end (second half), if the
lengths of the two words differ by one at most, and if the distance, which is then computed, is one.

Patterns are dealt to shards by a hash of the half, about `SHARD` of them to a shard, and a word is scanned by the
shards that can hold a pattern at its start or its end; there are four at most, because the lengths of a half
follow from the word's.  A half that very many words share would make its shard quadratic.  Such words (there are
fewer such halves than `near_dup.HOT_KEYS`) are paired by what is left of them with at most one code point taken out,
which two words at distance one have in common, and which bounds a group by the alphabet.

A pair is found once in each direction: by the first half where that matches, otherwise by the second.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, saved
from .near_dup import hot_keys

LEAST_LENGTH, LEAST_USES, RATIO, MISTYPED = 6, 5, 5, 199
#: Patterns of a shard, on average.
SHARD = 8192
#: Pairs whose distance is computed at once, and the longest words of these; longer ones go one by one.
PAIRS, LONGEST = 1 << 18, 64
#: Fixed values of the contract: the letters of a run.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_uses: int = LEAST_USES) -> DataFrame:
    """word and n of all runs of letters, as lower-cased and mistyped by the contract, long and common enough."""
    runs = F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(RUN + f"{{{least_length},}}"), F.lit(0)))
    # an id that is null counts as no characters
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(h % MISTYPED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_uses)


def pieces(words: DataFrame, least_length: int) -> DataFrame:
    """word, n, side, half, rest and own: a word's own halves, and what else at its ends may be a near word's half."""
    size = F.length("word")
    sizes = F.filter(F.array(size - 1, size, size + 1), lambda x: x >= least_length)
    heads = F.array_distinct(F.transform(sizes, lambda x: F.floor(x / 2).cast("int")))
    tails = F.array_distinct(F.transform(sizes, lambda x: F.ceil(x / 2).cast("int")))
    ends = F.concat(F.transform(heads, lambda x: F.struct(F.lit(0).alias("side"), x.alias("cut"))), F.transform(tails, lambda x: F.struct(F.lit(1).alias("side"), x.alias("cut"))))
    rows = words.select("word", "n", F.explode(ends).alias("x")).select("word", "n", "x.*")
    cut, head = F.col("cut"), F.col("side") == 0
    own = cut == F.when(head, F.floor(size / 2)).otherwise(F.ceil(size / 2))
    half = F.when(head, F.substring("word", F.lit(1), cut)).otherwise(F.substring("word", size - cut + 1, cut))
    rest = F.when(head, F.substring("word", cut + 1, size)).otherwise(F.substring("word", F.lit(1), size - cut))
    return rows.select("word", "n", "side", own.alias("own"), half.alias("half"), rest.alias("rest"))


class Shard:
    """The automaton over the halves of some words."""

    def __init__(self, side: list[int], half: list[str], word: list[str], n: list[int]):
        order = sorted(range(len(half)), key=lambda i: (half[i], side[i]))
        self.word, self.n = [word[i] for i in order], np.array([n[i] for i in order], np.int64)
        self.size = np.array([len(x) for x in self.word], np.int64)
        self.by_name = np.argsort(np.argsort(np.array(self.word, object), kind="stable"), kind="stable")
        self.codes, self.first_half = _codes(self.word), self.size // 2
        self.begin, self.many, groups = [], [], {}
        for place, i in enumerate(order):
            of = groups.setdefault(half[i], [-1, -1])
            if of[side[i]] < 0:
                of[side[i]] = len(self.begin)
                self.begin.append(place)
                self.many.append(0)
            self.many[-1] += 1
        self.automaton = ahocorasick.Automaton()
        for text, (head, tail) in groups.items():
            self.automaton.add_word(text, (len(text), head, tail))
        self.automaton.make_automaton()
        self.begin, self.many = np.array(self.begin, np.int64), np.array(self.many, np.int64)

    def near(self, words: list[str]):
        """(number of the word in `words`, number of its near word here), in runs of bounded size."""
        codes, size = _codes(words), np.array([len(x) for x in words], np.int64)
        asked, group, tail, waiting = [], [], [], 0
        many = self.many.tolist()
        for k, word in enumerate(words):
            last = len(word) - 1
            for end, (length, head, back) in self.automaton.iter(word):
                if head >= 0 and end == length - 1:
                    asked.append(k), group.append(head), tail.append(False)
                    waiting += many[head]
                if back >= 0 and end == last:
                    asked.append(k), group.append(back), tail.append(True)
                    waiting += many[back]
            if waiting > PAIRS:
                yield self._verified(words, codes, size, asked, group, tail)
                asked, group, tail, waiting = [], [], [], 0
        if asked:
            yield self._verified(words, codes, size, asked, group, tail)

    def _verified(self, words, codes, size, asked, group, tail):
        group = np.array(group, np.int64)
        many = self.many[group]
        ends = np.cumsum(many)
        b = np.repeat(self.begin[group] - ends + many, many) + np.arange(ends[-1])
        a, tail = np.repeat(np.array(asked, np.int64), many), np.repeat(np.array(tail, bool), many)
        fit = np.abs(size[a] - self.size[b]) <= 1
        a, b, tail = a[fit], b[fit], tail[fit]
        short = (size[a] <= LONGEST) & (self.size[b] <= LONGEST)
        good = np.zeros(a.size, bool)
        for lo in range(0, a.size, PAIRS):
            part = np.flatnonzero(short[lo : lo + PAIRS]) + lo
            near, same = one_apart(codes[a[part]], size[a[part]], self.codes[b[part]], self.size[b[part]])
            # where the first half matches too, the pair is found by that
            good[part] = near & ~(tail[part] & (same >= self.first_half[b[part]]))
        for i in np.flatnonzero(~short).tolist():
            x, y = words[a[i]], self.word[b[i]]
            good[i] = _one_apart(x, y) and not (tail[i] and x.startswith(y[: len(y) // 2]))
        return a[good], b[good]


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the words up to LONGEST, zero behind their ends."""
    return np.array([*words, ""], f"<U{LONGEST + 1}").view(np.uint32).reshape(len(words) + 1, LONGEST + 1)[:-1]


def one_apart(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows of code points are one edit apart, and how many code points their starts share."""
    unequal = x != y
    same = np.where(unequal.any(1), unequal.argmax(1), x.shape[1])
    shift_x, shift_y = np.flatnonzero(nx == ny + 1), np.flatnonzero(ny == nx + 1)
    near = (nx == ny) & (unequal.sum(1) == 1)
    for rows, longer, shorter in ((shift_x, x, y), (shift_y, y, x)):
        # behind the first difference the longer word goes on as the shorter one, a place later
        late = longer[rows, 1:] != shorter[rows, :-1]
        behind = np.arange(late.shape[1])[None, :] >= same[rows, None]
        near[rows] = ~(late & behind).any(1)
    return near, same


def _one_apart(x: str, y: str) -> bool:
    if len(x) < len(y):
        x, y = y, x
    k = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(y))
    return x != y and (x[k + 1 :] == y[k:] if len(x) > len(y) else x[k + 1 :] == y[k + 1 :])


def _scan_rows(batches):
    """Rows sorted by (shard, own first): patterns, then the words to scan; n_near and the best near word of each."""
    shard, held, automaton = None, ([], [], [], []), None
    for batch in batches:
        table = batch.to_pydict()
        at, size = 0, batch.num_rows
        while at < size:
            if table["shard"][at] != shard:
                shard, held, automaton = table["shard"][at], ([], [], [], []), None
            stop = at
            pattern = table["pattern"][at]
            while stop < size and table["shard"][stop] == shard and table["pattern"][stop] == pattern:
                stop += 1
            if pattern:
                for of, name in zip(held, ("side", "half", "word", "n")):
                    of.extend(table[name][at:stop])
            elif held[0]:
                if automaton is None:
                    automaton = Shard(*held)
                words = table["word"][at:stop]
                for a, b in automaton.near(words):
                    if not a.size:
                        continue
                    order = np.lexsort((automaton.by_name[b], -automaton.n[b], a))
                    a, b = a[order], b[order]
                    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                    n = np.diff(np.append(edge, a.size))
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in a[edge].tolist()]), pa.array(n), pa.array(-automaton.n[b[edge]]), pa.array([automaton.word[i] for i in b[edge].tolist()])], names=["word", "n_near", "less", "near"])
            at = stop


def _by_variants(own: DataFrame, asked: DataFrame) -> DataFrame:
    """Near words by crowded halves: those whose rests agree but for one code point taken out of either."""

    def spread(rows):
        size = F.length("rest")
        fewer = F.transform(F.sequence(F.lit(0), size), lambda i: F.concat(F.substring("rest", F.lit(1), i), F.substring("rest", i + 2, size)))
        return rows.withColumn("left", F.explode(F.array_distinct(fewer)))  # the last takes nothing out

    a = spread(asked).select("key", "left", "side", F.col("word"))
    b = spread(own).select("key", "left", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = a.join(b, ["key", "left"]).where(F.levenshtein("word", "near") == 1)
    first = F.floor(F.length("near") / 2).cast("int")
    by_head = F.substring("word", F.lit(1), first) == F.substring("near", F.lit(1), first)
    pairs = pairs.where((F.col("side") == 0) | ~by_head).select("word", "near", "near_n").distinct()
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("x")).select("word", "n_near", "x.less", "x.near")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n_near, near (of largest n, then smallest) and near_n, of the words of `words` (word, n) with a near word."""
    held = saved(pieces(words, least_length), "pieces")
    key = F.xxhash64("side", "half")
    held = held.withColumn("key", key)
    hot = hot_keys(held.where("own").groupBy("key").agg(F.count("*").alias("held")))
    marked = held.join(F.broadcast(hot), "key", "left")
    shards = words.count() * 2 // SHARD + 1
    shard = F.pmod("key", F.lit(shards)).alias("shard")
    plain = marked.where("salts is null")
    own = plain.where("own").select(shard, F.lit(True).alias("pattern"), "side", "half", "word", "n")
    asked = plain.select(shard, "word").distinct().select("shard", F.lit(False).alias("pattern"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("string").alias("half"), "word", F.lit(None).cast("long").alias("n"))
    rows = own.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.desc("pattern"))
    found = arrow_map(rows, _scan_rows, "word string, n_near long, less long, near string")
    crowded = marked.where("salts is not null")
    found = found.unionByName(_by_variants(crowded.where("own"), crowded))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("x"))
    return out.select("word", "n_near", F.col("x.near").alias("near"), (-F.col("x.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form): the last word that forms lead to, each round twice as far.

    A form is used several times as often as its word, so there are no rings and few rounds.
    """
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_uses: int = LEAST_USES, ratio: int = RATIO) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Null texts have no words; a null doc_id counts as no characters in the hash that mistypes; repeated rows count each
    time; words of any length are compared whole.  Of equally frequent near words the smallest in code-point order is the form.
    A table without words gives an empty result.  Other columns are not read.
    """
    words = saved(vocabulary(docs, least_length, least_uses), "vocabulary")
    near = near_words(words, least_length)
    fits = F.col("near_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    out = saved(out, "forms")
    found = roots(out.where("form is not null"))
    return out.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
