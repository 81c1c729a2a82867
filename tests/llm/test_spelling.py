"""Spelling variants against plain SQL over whole tables, and the parts against loops."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def by_sql(documents):
    from groundwire.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(con.sql(ORACLE_SQL["op11_spelling"]).fetchall())


def _frame(rows):
    ids = pd.array([r[0] for r in rows], "Int64")
    return pd.DataFrame({"doc_id": ids, "text": [r[1] for r in rows], "lang": [r[2] for r in rows]})


@pytest.mark.parametrize("hot_rows", [1024, 1])
def test_whole_table(spark, monkeypatch, hot_rows):
    from groundwire.llm import near_dup
    from groundwire.llm.queries import op11_spelling

    monkeypatch.setattr(near_dup, "HOT_ROWS", hot_rows)  # with 1, halves that two words share are crowded
    got = op11_spelling(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS
    want = by_sql(pd.read_parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == want and sum(r[4] > 0 for r in want) > 50


def test_odd_rows(spark, docs, rows, empty):
    from groundwire.llm.spelling import spelling_variants

    assert sorted(map(tuple, spelling_variants(docs).collect())) == by_sql(_frame(rows))
    assert spelling_variants(empty).count() == 0


def test_long_words_ties_and_chains(spark):
    from groundwire.llm.spelling import spelling_variants

    long = "é" * 70 + "abcdefgh" * 10
    words = {"people": 400, "peopla": 60, "peoplas": 7, "xpeople": 60, "peple": 5, long: 50, long[1:]: 6, long + "z": 5, "ýåuvwxyz": 5, "zzzzzz": 5}
    rows = [(k, " ".join(w for w, n in words.items() for _ in range(n)), "en") for k in (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, spelling_variants(frame).collect()))
    assert got == by_sql(_frame(rows))
    found = {r[0]: r for r in got}
    assert found["peoplas"][1:3] == ("peopla", "people") and found[long + "z"][1] == long


def test_distance_of_arrays():
    from groundwire.llm.spelling import _codes, _one_apart, one_apart

    r = random.Random(4)
    some = ["".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(250)]
    pairs = [(a, b) for a in some for b in some if abs(len(a) - len(b)) <= 1]
    x, y = [a for a, _ in pairs], [b for _, b in pairs]
    near, same = one_apart(_codes(x), np.array([len(a) for a in x]), _codes(y), np.array([len(b) for b in y]))

    def brute(a, b):
        edits = {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in ("", "a", "b") for d in (0, 1)} - {a}
        return b in edits

    want = [brute(a, b) for a, b in pairs]
    assert near.tolist() == want == [_one_apart(a, b) for a, b in pairs]
    for a, b, n in zip(x, y, same.tolist()):
        if a != b:
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1]
