"""The verdict of the line labelling against enumeration, and the evidence it is fitted on against a plain count."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa


def _texts():
    r = random.Random(8)
    line = lambda n: " ".join(r.choice(["ono", "the", "re", "atti", "bele", "sun", "Wen"]) + r.choice("abcdef") for _ in range(n))
    out = []
    for i in range(160):
        if i % 4 == 3:
            body = [" | ".join(line(1) for _ in range(30)), line(8).upper() + "!!", "*** $$$ " + line(20)]
        else:
            body = [line(30) + ".", line(25) + ".", line(3)]
        if i % 3 == 0:
            body.insert(1, f"Shared notice no {i % 9}")
        out.append((i, "\n".join(body), int(i % 4 != 3)))
    copy = "\n".join([line(30), "inner line of a copy", line(30)])
    return out + [(200 + i, copy, 1) for i in range(30)]


def _tables(spark):
    rows = _texts()
    return rows, spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_shared_lines_by_plain_count(spark):
    from groundwire.llm.rules import SURROUNDINGS, line_keys, shared_lines

    rows, docs = _tables(spark)
    seen = defaultdict(list)
    fold = str.maketrans("123456789", "000000000")
    for _, text, _ in rows:
        lines = [x.lower().translate(fold) for x in text.split("\n")]
        for k, x in enumerate(lines):
            if x.split():
                seen[x].append((lines[k - 1] if k else "", lines[k + 1] if k + 1 < len(lines) else ""))
    want = {x for x, around in seen.items() if len(set(around)) >= SURROUNDINGS and 2 * len(set(around)) >= len(around)}
    assert "shared notice no 0" in want and "inner line of a copy" not in want
    keys, _, _ = line_keys(pa.array([text for _, text, _ in rows]))
    hashed, _, _ = line_keys(pa.array(sorted(want)))
    assert set(shared_lines(docs, keys).tolist()) == set(hashed.tolist())


def test_kept_by_enumeration(spark):
    from groundwire.llm.rules import Lines, fit, line_rules

    rows, docs = _tables(spark)
    field = fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert field.emit.any()
    got = {r.doc_id: r for r in line_rules(docs.select("doc_id", "text"), docs.select("doc_id", "quality")).collect()}
    poor = 0
    for i, text, quality in rows:
        lines = Lines(pa.array([text]))
        score = lines.features @ field.emit
        n = len(score)
        value = lambda y: sum(score[k, y[k]] for k in range(n)) + sum(field.move[y[k - 1], y[k]] for k in range(1, n))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        words = np.array([len(x.split()) for x in text.split("\n")])
        content = words[np.array(best) == 0].sum() / words.sum()
        assert abs(got[i].content_share - content) < 1e-12
        assert got[i].kept == (not got[i].base_failed and content >= 0.5)
        poor += not got[i].base_failed and not got[i].kept and quality == 0
    assert poor > 20 and all(got[i].kept for i, _, q in rows if q == 1 and not got[i].base_failed)


def test_nothing_labelled(spark):
    from groundwire.llm.rules import fit

    _, docs = _tables(spark)
    assert not fit(docs, docs.where("false").select("doc_id", "quality")).emit.any()
