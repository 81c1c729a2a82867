"""Every stage of the pipeline over the whole table against a plainer reading of it, and what packing returns against the library."""

import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def one_of_each(texts):
    """Ids that are the smallest of their component, over all pairs."""
    sets, ids = {i: shingles(x) for i, x in texts.items()}, sorted(texts)
    of = {i: i for i in ids}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                of[y] = x
    return {i for i in ids if of[i] == i}


def test_stages_against_plain_readings(spark):
    import corpus_pipeline
    from groundwire.llm.language import languages
    from groundwire.llm.quality import quality

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, DIR)
        rows = out.collect()
        assert all(texts[r.doc_id] == r.text for r in rows) and out.columns == docs.columns
        kept[name] = {r.doc_id for r in rows}
        assert len(rows) == len(kept[name])
        if name == "language":  # each document by its own prediction
            judged = {r.doc_id for r in languages(held).collect() if r.lang_pred != "und" and r.score >= 0.5}
        elif name == "quality":
            judged = {r.doc_id for r in quality(held, labels).collect() if r.predicted == 1}
        else:
            judged = one_of_each({i: texts[i] for i in kept["quality"]})
        assert kept[name] == judged, name
        held = spark.createDataFrame(rows, out.schema)

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    got = {}
    for r in corpus_pipeline.run(spark, DIR).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == kept["near_dup"]
    places: dict = {}
    for doc_id, pieces in got.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            part = ids[at : at + 2048]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (n, at, part.size, zlib.crc32(part.tobytes()))
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            at += part.size
        assert at == ids.size
    for rows in places.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(length for rows in places.values() for _, length in rows)
    assert len(places) == -(-total // 2048)
