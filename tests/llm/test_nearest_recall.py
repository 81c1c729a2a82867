"""Recall against brute force over several shards, on vectors far apart, close together and repeated."""

import numpy as np
import pytest

from groundwire.llm.hnsw import nearest, rows_of_shard


def _table(kind, rng):
    if kind == "gaussian":
        return rng.normal(size=(1500, 24))
    if kind == "clusters":
        return np.repeat(rng.normal(size=(8, 24)), 190, 0) + 1e-5 * rng.normal(size=(1520, 24))
    return np.repeat(rng.normal(size=(60, 24)), 25, 0)


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "repeated"])
def test_recall_over_shards(spark, kind):
    x = _table(kind, np.random.default_rng(4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(table, queries_mod=40, shard_rows=400).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 40))
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and len({r[1] for r in rows}) == 10
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert all(score == pytest.approx(d[v], rel=1e-12, abs=1e-15) for _, v, score in rows)
        d[q] = np.inf
        limit = np.sort(d)[9] * (1 + 1e-12)
        hit += sum(score <= limit for *_, score in rows)
        if kind == "repeated":
            assert [v for _, v, _ in rows] == np.lexsort((np.arange(len(x)), d))[:10].tolist()
    assert hit >= 0.9 * 10 * len(got)


def test_shards_grow_within_bounds():
    assert rows_of_shard(1000, 64) == 8192
    assert 8192 < rows_of_shard(10**6, 64) < rows_of_shard(3 * 10**6, 64)
    assert rows_of_shard(10**10, 64) == 1 << 15
    assert rows_of_shard(10**10, 4096) == (64 << 20) // (8 * 4096)


def test_beam_follows_the_shard(monkeypatch):
    """The largest shard scaled down, with the beam in the same proportion to it: a beam of one size finds too little."""
    from groundwire.llm import hnsw

    monkeypatch.setattr(hnsw, "SHARD_ROWS", 1024)
    monkeypatch.setattr(hnsw, "BEAM", 24)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4096, 128))
    graph = hnsw.Graph.build(np.arange(4096), x)
    asked = np.arange(0, 4096, 41)
    near = [set(np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[1:11].tolist()) for i in asked]

    def recall(beam):
        of, found, _ = graph.search(asked, x[asked], 10, beam)
        return np.mean([len(near[k] & set(found[of == i].tolist())) / 10 for k, i in enumerate(asked)])

    assert hnsw.beam_of(4096, 128) > 2 * 24
    assert recall(None) >= 0.9 > recall(24)
    assert hnsw.beam_of(10, 8) == 24


def test_nearest_of_several_vectors_under_one_id(spark):
    from groundwire.llm.hnsw import nearest

    rows = [(0, [1.0, 0.0]), (5, [9.0, 0.0]), (5, [1.5, 0.0]), (7, [3.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(5, 0.5), (7, 2.0)]
