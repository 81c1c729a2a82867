"""Random indexing, pooling and scores against plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

KINDS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")


def _stream(text):
    """Words with marks as strings: a repeated word and a word in capitals are preceded by their mark."""
    out, before = [], None
    for w in KINDS.findall((text or "").encode()):
        if len(w) > 1 and w[:2].isalpha() and w[:2].isupper() and max(w[:2]) < 128:
            out.append("CAPITALS")
        if w == before:
            out.append("REPEATED")
        out.append(w)
        before = w
    return out


def _hash(word):
    from groundwire.llm.quality import CAPITALS, REPEATED, word_stream

    if isinstance(word, str):
        return int({"CAPITALS": CAPITALS, "REPEATED": REPEATED}[word])
    return int(word_stream(pa.array([word.decode()]))[0][-1])


def _index(word):
    from groundwire.llm.quality import DIMENSIONS, NONZERO, index_places

    out = np.zeros(DIMENSIONS)
    for j, place in enumerate(index_places(np.array([_hash(word)], np.uint64))[0]):
        out[place] += -1 if j % 2 else 1
    return out, NONZERO


def test_context_vectors_and_scores(docs, labels, rows):
    from groundwire.llm.quality import fit, quality, word_vectors

    streams = [_stream(r[1]) for r in rows]
    uses = Counter(w for s in streams for w in s)
    total = sum(uses.values())
    shares = 300
    wanted = {w for w, n in uses.items() if n >= 2 and n * shares > total}
    words, context = word_vectors(docs, shares)
    assert words.tolist() == sorted(_hash(w) for w in wanted) and 20 < len(words) < shares
    sums = defaultdict(lambda: np.zeros(64))
    for s in streams:
        for k, w in enumerate(s):
            if w in wanted:
                for j in (-2, -1, 1, 2):
                    if 0 <= k + j < len(s):
                        sums[w] += _index(s[k + j])[0]
    mean = sum(sums.values()) / sum(uses[w] for w in wanted)
    for w in wanted:
        v = sums[w] / uses[w] - mean
        v = v / max(np.linalg.norm(v), 1e-9) * min(1, uses[w] / 5)
        assert np.allclose(context[np.searchsorted(words, np.uint64(_hash(w)))], v, atol=1e-5)

    words, context, network = fit(docs, labels)
    place = {int(h): k for k, h in enumerate(words)}
    got = {r.doc_id: r.score for r in quality(docs, labels).collect()}
    for (i, *_), s in zip(rows, streams):
        x = np.zeros(128)
        for w in s:
            index, nonzero = _index(w)
            x[:64] += index / np.sqrt(nonzero)
            if _hash(w) in place:
                x[64:] += context[place[_hash(w)]]
        logit = network.logits((x / max(len(s), 1))[None])[0] / network.temperature
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(logit, -60, 60)))) < 2e-3


def test_good_keeps_clashing_columns(docs, labels):
    from tests.llm.test_whole_rows import _clashing

    from groundwire.llm.quality import good

    clashing = _clashing(docs)
    got = good(clashing, labels)
    assert got.columns == clashing.columns and got.where("__score = 2 and score = 7").count() == got.count() > 20
