"""Nearest neighbours with a hierarchical navigable small-world graph per shard.

Rows are dealt to shards by hash; a shard's rows grow with the square root of the table, within bounds, so that
shards become larger, not only more.  A shard's distinct vectors get levels (each level keeps one in `M`) and are
inserted in random order: each searches the graph so far from the top level down, is linked to near nodes chosen for
diversity, and these link back, choosing anew where their places are full.  Insertions go in batches of at most the
nodes already there, whose members see each other by exact distances.  The links of a level are one flat array
of `width` places per node; a shard's index is one row of a written table.

Blocks of queries visit every shard: greedy descent through the upper levels, then a beam on the lowest, which grows with
the shard's rows and dimensions (`beam_of`), because a beam of one size finds less of larger shards.  All distances are sums of squared differences in double precision, so vectors that lie very close together keep
their order; shard results merge by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, saved, ship

QUERY_ROWS = 256
#: Least and most rows of a shard, and most bytes of its vectors.
SHARD_ROWS, MOST_ROWS, SHARD_BYTES = 8192, 1 << 15, 64 << 20
M, CANDIDATES, ABOVE = 16, 64, 24
#: Beam of a shard of SHARD_ROWS rows of BEAM_DIM dimensions; none is smaller.
BEAM, BEAM_DIM = 128, 64
#: Insertions of one batch, and nodes that a search opens in one step.
BATCH, STEP = 256, 4


def beam_of(rows: int, dim: int) -> int:
    """Width of the search on the lowest level: measured to keep ten nearest at 0.9 and more up to the largest shards."""
    return max(BEAM, math.ceil(BEAM * math.sqrt(rows / SHARD_ROWS) * (dim / BEAM_DIM) ** 0.4))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (len(a), len(b)) by differences."""
    return np.stack([((row - b) ** 2).sum(1) for row in a]) if len(a) else np.zeros((0, len(b)))


def diverse(x: np.ndarray, node: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates, -1 where fewer: first those that no chosen one is nearer to, then the nearest.

    `near` has distinct candidates of each node by ascending distance, -1 (at infinity) at the end.
    """
    out = np.full((len(node), most), -1, np.int32)
    for a in range(0, len(node), 64):
        some, d = near[a : a + 64], dist[a : a + 64]
        y = x[np.maximum(some, 0)] - x[node[a : a + 64]][:, None]
        norm = (y * y).sum(2)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
        keep, real = np.zeros(some.shape, bool), some >= 0
        for j in range(some.shape[1]):
            blocked = (keep[:, :j] & (between[:, j, :j] < d[:, j, None])).any(1)
            keep[:, j] = real[:, j] & ~blocked & (keep[:, :j].sum(1) < most)
        order = np.argsort(np.where(keep, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        got = np.take_along_axis(np.where(real, some, -1), order, 1)
        out[a : a + 64, : got.shape[1]] = got
    return out


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found on one level and their squared distances, for all queries in step.

    `start` has distinct nodes for each query, -1 where there are fewer; so has the result, at infinity.
    """
    rows, beam = np.arange(len(q)), max(beam, start.shape[1])
    seen = np.zeros((len(q), len(x)), bool)
    of, place = np.nonzero(start >= 0)
    seen[of, start[of, place]] = True
    at, dist = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), np.inf)
    at[:, : start.shape[1]] = start
    dist[of, place] = ((q[of] - x[start[of, place]]) ** 2).sum(1)
    done = np.zeros(at.shape, bool)
    live = rows
    while live.size:
        waiting = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(waiting, min(STEP, beam) - 1, axis=1)[:, :STEP]
        open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = open_.any(1)
        live, pick, open_ = live[some], pick[some], open_[some]
        if not live.size:
            break
        row, col = np.nonzero(open_)
        done[live[row], pick[row, col]] = True
        near = np.full((live.size, pick.shape[1], links.shape[1]), -1, np.int32)
        near[row, col] = links[at[live[row], pick[row, col]]]
        near = near.reshape(live.size, -1)
        row, col = np.nonzero(near >= 0)
        node = near[row, col]
        fresh = np.flatnonzero(~seen[live[row], node])
        # two of the nodes that are opened together may share a neighbour
        _, once = np.unique(row[fresh] * len(x) + node[fresh], return_index=True)
        row, col, node = row[fresh[once]], col[fresh[once]], node[fresh[once]]
        seen[live[row], node] = True
        gap = x[node] - q[live[row]]
        place = np.arange(row.size) - np.searchsorted(row, row)
        wide = int(place.max()) + 1 if place.size else 0
        d, found = np.full((live.size, wide), np.inf), np.full((live.size, wide), -1, np.int32)
        d[row, place], found[row, place] = np.einsum("nd,nd->n", gap, gap), node
        all_d, all_at, all_done = np.concatenate([dist[live], d], 1), np.concatenate([at[live], found], 1), np.concatenate([done[live], found < 0], 1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], at[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_d, all_at, all_done))
    return at, dist


def _nearest_first(at: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dist, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)


class Graph:
    """Index of a shard's distinct vectors; ids of equal vectors stand together, ascending.

    levels: for each the nodes it holds and the (nodes, width) array of their neighbours, -1 where none.
    """

    def __init__(self, ids, bounds, vectors, levels):
        self.ids, self.bounds, self.vectors, self.levels = ids, bounds, vectors, levels

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0  # -0 becomes 0
        _, first, which = np.unique(vectors.view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        by = np.lexsort((ids, which))
        ids, which = ids[by], which[by]
        fresh = np.ones(ids.size, bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (which[1:] != which[:-1])
        ids, which = ids[fresh], which[fresh]
        bounds = np.searchsorted(which, np.arange(first.size + 1))
        x = vectors[first]
        rng = np.random.default_rng(first.size)
        height = (-np.log(1 - rng.random(first.size)) / np.log(M)).astype(int)
        links = [np.full((len(x), 2 * M if level == 0 else M), -1, np.int32) for level in range(int(height.max()) + 1)]
        turn = rng.permutation(first.size)
        done = 0
        while done < turn.size:
            new = turn[done : done + min(BATCH, max(1, done))]
            cls._insert(x, height, links, turn[:done], new)
            done += new.size
        levels = [(np.flatnonzero(height >= level).astype(np.int32), own[height >= level]) for level, own in enumerate(links)]
        return cls(ids, bounds, x, levels)

    @staticmethod
    def _insert(x, height, links, old: np.ndarray, new: np.ndarray) -> None:
        among = _squared(x[new], x[new])
        np.fill_diagonal(among, np.inf)
        start = None
        for level in range(len(links) - 1, -1, -1):
            held = old[height[old] >= level]
            own = np.flatnonzero(height[new] >= level)
            if held.size:
                if start is None:
                    start = np.tile(held[: 2 * M].astype(np.int32), (new.size, 1))
                at, dist = _nearest_first(*beam_search(x, links[level], x[new], start, CANDIDATES if level == 0 else ABOVE), CANDIDATES)
                start = at[:, :4]
            else:
                at, dist = np.zeros((new.size, 0), np.int32), np.zeros((new.size, 0))
            if not own.size or held.size + own.size < 2:
                continue
            mates = np.broadcast_to(new[own].astype(np.int32), (own.size, own.size))
            near, d = _nearest_first(np.concatenate([at[own], mates], 1), np.concatenate([dist[own], among[np.ix_(own, own)]], 1), CANDIDATES)
            near = np.where(np.isfinite(d), near, -1)
            chosen = diverse(x, new[own], near, d, M)
            links[level][new[own], :M] = chosen
            Graph._link_back(x, links[level], new[own], chosen)

    @staticmethod
    def _link_back(x, links, new: np.ndarray, chosen: np.ndarray) -> None:
        row, col = np.nonzero(chosen >= 0)
        target, giver = chosen[row, col], new[row]
        have = (links[target] == giver[:, None]).any(1)
        target, giver = target[~have], giver[~have]
        order = np.argsort(target, kind="stable")
        target, giver = target[order], giver[order]
        node, first, count = np.unique(target, return_index=True, return_counts=True)
        width, free = links.shape[1], (links[node] < 0).sum(1)
        place = np.arange(target.size) - np.repeat(first, count)
        fits = np.repeat(count <= free, count)
        filled = np.repeat(width - free, count)
        links[target[fits], (filled + place)[fits]] = giver[fits]
        full = np.flatnonzero(count > free)
        if not full.size:
            return
        most = int(count.max())
        offered = np.full((node.size, most), -1, np.int32)
        offered[np.repeat(np.arange(node.size), count), place] = giver
        near = np.concatenate([links[node[full]], offered[full]], 1)
        d = np.full(near.shape, np.inf)
        r, c = np.nonzero(near >= 0)
        d[r, c] = ((x[near[r, c]] - x[node[full]][r]) ** 2).sum(1)
        near, d = _nearest_first(near, d, 2 * width)
        links[node[full]] = diverse(x, node[full], near, d, width)

    def dump(self) -> dict[str, bytes]:
        sizes = np.array([len(n) for n, _ in self.levels], "<i4")
        return {
            "ids": self.ids.astype("<i8").tobytes(), "bounds": self.bounds.astype("<i4").tobytes(), "vectors": self.vectors.astype("<f8").tobytes(),
            "sizes": sizes.tobytes(), "nodes": b"".join(n.astype("<i4").tobytes() for n, _ in self.levels), "neighbours": b"".join(x.astype("<i4").tobytes() for _, x in self.levels),
        }

    @classmethod
    def load(cls, raw: dict[str, bytes]) -> Graph:
        ids, bounds = np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["bounds"], "<i4")
        vectors = np.frombuffer(raw["vectors"], "<f8").reshape(bounds.size - 1, -1)
        nodes, flat, levels, at, done = np.frombuffer(raw["nodes"], "<i4"), np.frombuffer(raw["neighbours"], "<i4"), [], 0, 0
        for level, n in enumerate(np.frombuffer(raw["sizes"], "<i4").tolist()):
            width = 2 * M if level == 0 else M
            levels.append((nodes[at : at + n], flat[done : done + n * width].reshape(n, width)))
            at, done = at + n, done + n * width
        return cls(ids, bounds, vectors, levels)

    def links(self, level: int) -> np.ndarray:
        """The level's neighbours with a row for every node of the graph."""
        nodes, own = self.levels[level]
        if nodes.size == len(self.vectors):
            return own
        out = np.full((len(self.vectors), own.shape[1]), -1, np.int32)
        out[nodes] = own
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int | None = None):
        """(query id, vector id, distance) of the k nearest found for each query, without itself."""
        beam = beam or beam_of(*self.vectors.shape)
        start = np.tile(self.levels[-1][0][: 4 * M], (len(queries), 1))
        for level in range(len(self.levels) - 1, -1, -1):
            width = max(beam, k + 1) if level == 0 else ABOVE
            at, dist = beam_search(self.vectors, self.links(level), queries, start, width)
            start = _nearest_first(np.where(np.isfinite(dist), at, -1), dist, 4)[0]
        width = at.shape[1]
        # where the links lead to fewer nodes than the beam holds, all nodes are compared
        most = min(width, len(self.vectors))
        short = np.flatnonzero(np.isfinite(dist).sum(1) < most)
        for a in range(0, short.size, 64):
            rows = short[a : a + 64]
            d = _squared(queries[rows], self.vectors)
            best = np.argpartition(d, most - 1, axis=1)[:, :most]
            at[rows, :most], dist[rows, :most] = best, np.take_along_axis(d, best, 1)
            at[rows, most:], dist[rows, most:] = -1, np.inf
        found = np.flatnonzero(np.isfinite(dist).ravel())
        of, node = found // at.shape[1], at.ravel()[found]
        size = np.minimum(np.diff(self.bounds)[node], k + 1)
        of_all = np.repeat(of, size)
        ids = self.ids[np.repeat(self.bounds[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        exact = np.sqrt(((queries[of] - self.vectors[node]) ** 2).sum(1))
        score = np.repeat(exact, size)
        other = np.flatnonzero(ids != query_ids[of_all])
        of_all, ids, score = of_all[other], ids[other], score[other]
        order = np.lexsort((ids, score, of_all))
        of_all, ids, score = of_all[order], ids[order], score[order]
        place = np.arange(of_all.size) - np.searchsorted(of_all, of_all)
        keep = np.flatnonzero(place < k)
        return query_ids[of_all[keep]], ids[keep], score[keep]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = t["v"].combine_chunks()
    return t["vec_id"].to_numpy(), np.asarray(flat.flatten().to_numpy(), np.float64).reshape(len(flat), -1)


INDEX = ("ids", "bounds", "vectors", "sizes", "nodes", "neighbours")


def _build(t: pa.Table) -> pa.Table:
    raw = Graph.build(*_matrix(t)).dump()
    return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], **{x: pa.array([raw[x]], pa.binary()) for x in INDEX}})


def _pack(t: pa.Table) -> pa.Table:
    ids, x = _matrix(t)
    ids, first = np.unique(ids, return_index=True)
    return pa.table({"dim": t["dim"][:1], "block": t["block"][:1], "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "queries": pa.array([x[first].astype("<f8").tobytes()], pa.binary())})


def _search(k: int):
    def run(batches):
        key, graph = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch.column("dim")[i].as_py(), batch.column("shard")[i].as_py())
                if now != key:
                    key, graph = now, Graph.load({x: batch.column(x)[i].as_buffer() for x in INDEX})
                ids = np.frombuffer(batch.column("query_ids")[i].as_buffer(), "<i8")
                x = np.frombuffer(batch.column("queries")[i].as_buffer(), "<f8").reshape(ids.size, -1)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in graph.search(ids, x, k)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) and dim of the rows that take part: finite everywhere and not zero."""
    fine = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine).withColumn("dim", F.size("v"))


def rows_of_shard(rows: int, dim: int) -> int:
    """16 times the square root of the table, within the bounds."""
    return max(1, min(max(SHARD_ROWS, 16 * math.isqrt(rows)), MOST_ROWS, SHARD_BYTES // (8 * max(dim, 1))))


def nearest(vectors: DataFrame, queries_mod: int = 100, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose vec_id divides by `queries_mod`.

    Null ids take no part, nor do vectors that are null, empty, zero or hold a null or non-finite component;
    vectors of different lengths never meet; repeated rows count once, and of several vectors under one id the nearest;
    equal distances rank by vec_id; other columns are not read;
    an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    shards = max(1, -(-size["n"] // (shard_rows or rows_of_shard(size["n"], size["dim"] or 1))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)))
    index = saved(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard long, " + ", ".join(f"{x} binary" for x in INDEX)), "hnsw")
    asked = rows.where(F.col("vec_id") % queries_mod == 0)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block").applyInArrow(_pack, "dim int, block long, query_ids binary, queries binary")
    visits = packed.withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    found = arrow_map(index.join(visits, ["dim", "shard"]), _search(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
