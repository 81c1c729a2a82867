"""What near_duplicates moves: texts and sets that nobody asks for stay where they are read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def mixed(spark):
    """300 texts of 400 words, 30 near copies and 10 copies of them, one without an id and one without words."""
    r = random.Random(5)
    texts = [[f"w{r.randint(0, 10**9)}" for _ in range(400)] for _ in range(300)]
    near = [[f"n{i}" if k == 200 else w for k, w in enumerate(texts[i])] for i in range(30)]
    rows = [(i - 100, " ".join(w)) for i, w in enumerate(texts + near + texts[40:50])]
    return spark.createDataFrame([*rows, (None, " ".join(texts[0])), (900, " ")], "doc_id long, text string")


def want(n=340):
    of = {i - 100: i - 100 for i in range(n)} | {300 + i - 100: i - 100 for i in range(30)} | {330 + i - 100: 40 + i - 100 for i in range(10)}
    return {**of, None: None, 900: 900}


def test_no_shuffle_of_texts(mixed, monkeypatch):
    from groundwire.llm import near_dup

    plans, saved = {}, near_dup.saved

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return saved(df, name)

    monkeypatch.setattr(near_dup, "saved", noted)
    assert {x.doc_id: x.component_id for x in near_dup.near_duplicates(mixed).collect()} == want()
    assert "Join" not in plans["sets"] and "Repartition" not in plans["sets"]


@pytest.mark.parametrize("bits", [1 << 6, 1 << 27])
def test_bitmap_decides_the_work_only(mixed, monkeypatch, bits):
    """With 64 bits nearly everything passes."""
    from groundwire.llm import near_dup

    monkeypatch.setattr(near_dup, "FILTER_BITS", bits)
    assert {x.doc_id: x.component_id for x in near_dup.near_duplicates(mixed).collect()} == want()


def test_bitmap_holds_all_given(spark):
    from groundwire.llm.near_dup import _passes, bitmap

    ids = spark.range(-500, 500)
    words = bitmap(ids.select(F.xxhash64("id").alias("hash"))).value
    hashes = spark.range(-500, 4000).select("id", F.xxhash64("id").alias("hash")).toArrow()
    got = _passes(words, hashes["hash"].to_numpy())
    given = hashes["id"].to_numpy() < 500
    assert got[given].all() and got[~given].mean() < 0.1
    assert not _passes(bitmap(ids.limit(0).select(F.col("id").alias("hash"))).value, np.arange(-5, 5)).any()
