"""Every learned language is a candidate, however many there are."""

import random

import numpy as np


def test_more_than_64_languages(spark):
    from groundwire.llm.language import languages

    r = random.Random(2)
    rows = []
    for k in range(70):
        syllables = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)]
        for j in range(6 if k < 68 else 4):  # the last two are the rarest
            rows.append((len(rows), " ".join("".join(r.choices(syllables, k=2)) for _ in range(60)), f"l{k:02d}"))
    truth = {i: lang for i, _, lang in rows}
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {q.lang_pred for q in got} == set(truth.values())
    assert all(q.lang_pred == truth[q.doc_id] and q.score > 0.99 for q in got)


def test_groups_change_no_cost():
    from groundwire.llm.language import PPM, grams

    def counts(text):
        code, n = np.unique(grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 4), return_counts=True)
        return code.astype(np.int64), n

    held = {"a": counts(b"abracadabra abracadabra"), "b": counts(b"the other one over there"), "c": counts(b"ou est la bibliotheque")}
    data, offsets = np.frombuffer(b"the other cadabra est", np.uint8), np.array([0, 9, 21])
    alone = np.concatenate([PPM({k: v}).bits(data, offsets) for k, v in held.items()], 1)
    assert np.allclose(PPM(held).bits(data, offsets), alone, atol=1e-3)
