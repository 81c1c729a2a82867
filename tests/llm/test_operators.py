"""Operators against brute force, libraries and round trips, on rows with every oddity."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def raw_ids(ids):
    return np.array(ids, "<u4").tobytes()


def test_near_dup(docs, empty, rows):
    from groundwire.llm.near_dup import near_duplicates

    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    of = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and of[a] != of[b]:
                    of[a] = of[b] = min(of[a], of[b])
                    changed = True
    want = Counter((i, len(sets[i]) if i is not None else 1, of.get(i), i is None or of[i] == i) for i, *_ in rows)
    assert multiset(near_duplicates(docs).collect()) == want
    assert near_duplicates(empty).count() == 0


def test_large_group_of_mutated_copies(spark):
    """Copies with several edits: links among copies that the group's smallest does not reach are found too."""
    import random

    from groundwire.llm.near_dup import near_duplicates

    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(250):
        w = list(base)
        for k in r.sample(range(120), r.randint(0, 9)):
            w[k] = f"n{r.randint(0, 10**9)}"
        texts.append(w)
    sets = [{tuple(w[k : k + 5]) for k in range(116)} for w in texts]
    of = list(range(250))
    find = lambda x: x if of[x] == x else find(of[x])
    for a in range(250):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (232 - both):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(250)}


def test_wavelet_tokens(docs, empty, rows):
    from groundwire.llm.wavelet import read_documents, write_shards

    encode = library("byte_bpe_50k.json")
    got = read_documents(*write_shards(docs, limit=2000)).orderBy("start").collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    assert len(got) == len(want)
    for r, (i, text, *_) in zip(got, want):
        ids = [*encode(text), 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(raw_ids(ids)))
        at += len(ids)
    assert read_documents(*write_shards(empty)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_wavelet_matrix(n):
    from groundwire.llm.wavelet import WaveletMatrix, dump, load

    v = np.random.default_rng(n).integers(0, 700, n).astype(np.uint32)
    m, who, nulls, lengths, first = load(dump(WaveletMatrix.build(v, 16), np.array([7]), np.array([0]), np.array([n]), 3))
    assert (m.values() == v).all() and (m.access(np.arange(n)) == v).all()
    assert (who.tolist(), nulls.tolist(), lengths.tolist(), first) == ([7], [0], [n], 3)
    for x in {0, 699, 65536, *v[:5].tolist()}:
        assert m.occurrences(int(x)).tolist() == np.flatnonzero(v == x).tolist()
        assert m.count(int(x), n // 3, n) == int((v[n // 3 :] == x).sum())


def test_token_counts(docs, empty, rows):
    from groundwire.llm.separators import document_tokens

    encode = library("byte_bpe_50k.json")
    got = document_tokens(docs).orderBy("doc_index").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(encode(text)) + 1) for i, text, *_ in rows)
    at = 0
    for k, r in enumerate(got):
        assert (r.doc_index, r.start, r.closed) == (k, at, True)
        at += r.n_tokens
    assert document_tokens(empty).count() == 0


def test_separators_over_blocks_and_files(spark):
    from groundwire.llm.separators import scan_separators

    r = np.random.default_rng(1)
    flat = np.where(r.random(997) < 0.05, 9, 1)
    cuts = [0, 0, 100, 101, 640, 997]
    files = spark.createDataFrame([(f"f{k}", bytearray(flat[a:b].astype("<u2").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "path string, content binary")
    got = scan_separators(files, separator=9, block=37).orderBy("doc_index").collect()
    ends = np.flatnonzero(flat == 9)
    starts = [0, *(ends + 1).tolist()]
    want = [(k, starts[k], int(e) - starts[k] + 1, True) for k, e in enumerate(ends)]
    if starts[-1] < 997:
        want.append((len(ends), starts[-1], 997 - starts[-1], False))
    assert [tuple(x) for x in got] == want


def test_prefix_bpe(docs, empty, rows):
    import tiktoken

    from groundwire.llm.prefix_bpe import Buffer, PrefixEncoder, encode_documents, merge_encode, read_ranks

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text, *_ in rows:
        ids = coder.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(raw_ids(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert multiset(encode_documents(docs).collect()) == want
    assert encode_documents(empty).count() == 0
    table = PrefixEncoder(read_ranks(P.path("byte_bpe_50k.tiktoken")))
    b = Buffer(table, b"the quick brown fox ")
    b.append(b"jumps over there")
    assert b.ids() == merge_encode(b.data, ranks)
    redone = b.replace(4, 9, b"slow")
    assert b.ids() == merge_encode(b.data, ranks) and redone <= len(b.data)


def test_packing(docs, empty, rows):
    from groundwire.llm.packing import pack_documents

    encode = library("word_bpe_49k.json")
    got = pack_documents(docs).collect()
    want = Counter()
    total = 0
    for i, text, *_ in rows:
        ids = [*encode(text), 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(raw_ids(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1
    assert pack_documents(empty).count() == 0


def test_line_rules(docs, empty, rows):
    from groundwire.llm.rules import line_rules

    want = Counter()
    for i, text, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 2 * len(covered) > len(w)] += 1
    got = line_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert line_rules(empty).count() == 0


def test_viterbi_is_the_best_labelling():
    from itertools import product

    from groundwire.llm.rules import K, LineField

    r = np.random.default_rng(2)
    field = LineField(r.normal(size=(K, 2)), r.normal(size=(2, 2)))
    x, first = r.random((11, K)) < 0.4, np.array([0, 6, 7, 11])
    got = field.viterbi(x, first)
    for a, b in zip(first, first[1:]):
        s = x[a:b] @ field.emit
        best = max(product((0, 1), repeat=b - a), key=lambda y: sum(s[k, y[k]] for k in range(b - a)) + sum(field.move[y[k - 1], y[k]] for k in range(1, b - a)))
        assert got[a:b].tolist() == list(best)


def test_field_gradient():
    from groundwire.llm.rules import K, LineField

    r = np.random.default_rng(3)
    field = LineField(r.normal(size=(K, 2)) * 0.3, r.normal(size=(2, 2)) * 0.3)
    x, first, truth = (r.random((9, K)) < 0.4).astype(float), np.array([0, 4, 9]), r.integers(0, 2, 9)
    value, emit, move = field.gradient(x, first, truth)
    for w, g in ((field.emit, emit), (field.move, move)):
        w[0, 1] += 1e-6
        assert abs((field.gradient(x, first, truth)[0] - value) / 1e-6 - g[0, 1]) < 1e-3
        w[0, 1] -= 1e-6


def test_lattice_lm(docs, empty, rows):
    from groundwire.llm.lm import Lattice, score_documents, vocabulary

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, end = Counter(), object()
    for i, text, *_ in rows:
        if not held(i):
            counts.update([*words(text), end])
    n, v = sum(counts.values()), len(counts)
    got = score_documents(docs).collect()
    want = Counter()
    for i, text, *_ in rows:
        w = [*words(text), end]
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert Counter((*tuple(r)[:5], round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_documents(empty).count() == 0

    pieces, p = vocabulary(P.path("piece_bpe_32k.model"))
    number, lattice = {x: k for k, x in enumerate(pieces)}, Lattice(pieces, np.log(p))
    sample = [b" the", b" q", " é".encode(), b" internationalisation", b" zzzzqx"]
    expected = np.zeros(len(pieces))
    for word, value in zip(sample, lattice.scores(sample, np.ones(5), expected)):
        a = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            a[j] = sum(a[k] * p[number[word[k:j]]] for k in range(j) if word[k:j] in number)
        assert abs(value - math.log(a[-1])) < 1e-9
    assert abs(sum(c * len(x) for c, x in zip(expected, pieces)) - sum(map(len, sample))) < 1e-6


def test_language(docs, empty, rows):
    from groundwire.llm.language import languages, recognised

    got = languages(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (104, 105, 106, 108)} == {"und"}
    truth = {i: lang for i, text, lang, *_ in rows if i is not None and i < 60 and len(text) > 80}
    assert np.mean([by[i].lang_pred == lang for i, lang in truth.items()]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert languages(empty).count() == 0 and recognised(docs).columns == docs.columns


def test_ppm_costs():
    """Table costs equal escape-by-escape costs."""
    from groundwire.llm.language import PPM, grams

    text = b"abracadabra abracadabra"
    code, n = np.unique(grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 4), return_counts=True)
    model = PPM({"x": (code.astype(np.int64), n)})
    seen = Counter()
    padded = bytes(3) + text
    for k in range(3, len(padded)):
        for size in range(4):
            seen[padded[k - size : k + 1]] += 1

    def cost(gram):
        if not gram:
            return 8.0
        follow = [c for g, c in seen.items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        if seen[gram]:
            return -math.log2(seen[gram] / (sum(follow) + len(follow)))
        escape = -math.log2(len(follow) / (sum(follow) + len(follow))) if follow else 0.0
        return escape + cost(gram[1:])

    probe = b"bracazz abra"
    data = np.frombuffer(probe, np.uint8)
    want = sum(cost((bytes(3) + probe)[k - 3 : k + 1]) for k in range(3, len(probe) + 3))
    assert abs(model.bits(data, np.array([0, len(probe)]))[0, 0] - want) < 1e-3


def test_quality(docs, empty, labels, rows):
    from groundwire.llm.quality import good, quality

    got = quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 3]
    assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 1) for r in known]) > 0.9
    assert quality(empty, labels).count() == 0 and quality(docs, labels.limit(0)).count() == len(rows)
    assert good(docs, labels).columns == docs.columns


def test_nearest(spark):
    from groundwire.llm.hnsw import nearest

    r = np.random.default_rng(4)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[300:500] = x[0]  # a common vector
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [None] * 16), (None, x[1].tolist()), (1100, x[5].tolist()), (1100, x[5].tolist()), (1200, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for q in nearest(df, shard_rows=200).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    ids, v = np.append(np.arange(700), 1100), np.vstack([x, x[5]]).astype(np.float64)
    hits = 0
    for q in (0, 100, 200, 300, 400, 500, 600, 1100):
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits += len({int(ids[k]) for k in order} & {i for i, _ in got[q]})
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q]) and len(got[q]) == 10
        if q in (0, 300, 400):
            assert got[q] == [(int(ids[k]), 0.0) for k in order]
    assert set(got) == {0, 100, 200, 300, 400, 500, 600, 1100} and hits >= 72
    assert nearest(df.limit(0)).count() == 0


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, str(tmp_path))
        assert kept.columns == docs.columns and kept.exceptAll(now).isEmpty(), name
        now = spark.createDataFrame(kept.collect(), kept.schema)
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) and not {104, 105, 106, 108} & set(ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(ids)
