"""Every query has as many rows as there are candidates, up to k."""

from collections import Counter

import numpy as np
import pytest


@pytest.mark.parametrize("n", [20, 40, 500])
def test_rows_of_each_query(spark, n):
    from groundwire.llm.hnsw import nearest

    x = np.random.default_rng(n).normal(size=(n, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for k in (10, 30, 120):
        got = Counter(q.query_id for q in nearest(df, queries_mod=1, k=k).collect())
        assert got == {i: min(k, n - 1) for i in range(n)}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 20, 40, 300, 500, 1100])
def test_found_once(n):
    """Whatever the size of the top level, no node takes two places, also from parts that no link leads to."""
    from groundwire.llm.hnsw import Graph

    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(n, 8))
        x[: n // 5] += 1000.0
        ids = np.arange(n)
        query, found, score = Graph.build(ids, x).search(ids, x, 10)
        assert len(set(zip(query.tolist(), found.tolist()))) == query.size == n * min(10, n - 1)
        if n <= 96:
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
            np.fill_diagonal(d, np.inf)
            assert np.allclose(score.reshape(n, -1), np.sort(d, axis=1)[:, : min(10, n - 1)])
