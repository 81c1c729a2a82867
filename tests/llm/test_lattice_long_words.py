"""Long unseen words keep their whole cost, in Python and in the tail's SQL expression."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

HELD = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
TRAINING = [i for i in range(200) if i not in HELD]


def spelled(word, number, log_p):
    """Natural log of the sum over all segmentations, one place after another."""
    longest = max(map(len, number))
    a = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        for k in range(max(0, j - longest), j):
            if word[k:j] in number:
                a[j] = np.logaddexp(a[j], a[k] + log_p[number[word[k:j]]])
    return float(a[-1])


@pytest.mark.parametrize("trained", [False, True])
@pytest.mark.parametrize("head", [1 << 17, 0])
def test_long_words(spark, monkeypatch, trained, head):
    from groundwire.llm import lm

    monkeypatch.setattr(lm.head_words, "__defaults__", (head,))
    r = random.Random(8)
    long = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k)) for k in (100, 600, 4000)] + ["".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(111))]
    rows = [(i, f"the {x}") for i, x in zip(HELD, long)]
    if trained:
        rows += [(TRAINING[0], f"the cat and the dog {long[1]}"), (TRAINING[1], "a cat and a dog")]
    counts = Counter(x for i, text in rows if i in TRAINING for x in text.split())
    documents = sum(i in TRAINING for i, _ in rows)
    got = {q.doc_id: (q.word_arc_score, q.score) for q in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    seen = spark.createDataFrame([(bytearray(x.encode()), n) for x, n in counts.items()], "word binary, n long")
    pieces, log_p, end = lm.fit(seen, documents, P.path("piece_bpe_32k.model"))
    number = {x: k for k, x in enumerate(pieces)}
    n, v = sum(counts.values()) + documents, len(counts) + (documents > 0)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    weight = discount * v / n if n else 1.0

    def cost(word):
        whole = math.log((counts[word] - discount) / n) if counts[word] > discount else -math.inf
        return np.logaddexp(whole, math.log(weight) + spelled(b" " + word.encode(), number, log_p)) / math.log(10)

    last = math.log10(max(documents - discount, 0) / max(n, 1) + weight * math.exp(end))
    for i, text in rows:
        assert got[i][0] == pytest.approx(sum(cost(x) for x in text.split()) + last, rel=1e-9), i
        assert got[i][1] == pytest.approx((sum(spelled(b" " + x.encode(), number, log_p) for x in text.split()) + end) / math.log(10), rel=1e-9), i
    assert got[HELD[2]][0] < got[HELD[0]][0] - 1000 and got[HELD[2]][0] < -5000
