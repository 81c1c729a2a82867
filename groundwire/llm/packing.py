"""Packing documents into fixed-length sequences with a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens (only longer ones are cut).  Full pieces are
sequences of their own; the others are dealt by hash to blocks of about `BLOCK_ITEMS`, which bounds every
task.  In each block, islands start from random groupings, and one of them from best-fit decreasing too, so that the
search never ends above that; they evolve: crossover injects well-filled bins of one parent into the other, drops the bins
that held the same documents, and best-fits the displaced ones.  After each epoch every island receives its neighbour's
elite; each epoch is a written table.  Fitness is the number of bins, then the mean of squared fills, so slack gathers in
few bins.

Only full bins stay as they are.  All others, of all blocks, are emptied into fewer blocks, where the same evolution packs
their documents once more, and so on until one block is left: what the dealing to blocks costs does not add up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, saved, slices, tokenizer_file
from .tokens import library_coder, with_end

CAPACITY, END_ID = 2048, 0
BLOCK_ITEMS = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 16, 3
WELL_FILLED = 0.995
#: A child has up to one in so many bins emptied at random.
MIXED = 50
#: Where full bins hold less than this share of the rows, the best-filled ones close, down to half of all rows.
FULL_ROWS = 0.1

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _pieces(file: str, end: int, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        coder, row = library_coder(file, True), TaskContext.get().partitionId() << 36
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                ids, at = with_end(*coder.ids(text[lo:hi]), end)
                n = np.diff(at)
                count = -(-n // capacity)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(np.repeat(n, count) - start, capacity)
                first = np.repeat(at[:-1], count) + start
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                who = np.repeat(np.arange(hi - lo), count)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi].take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(row + who)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])
                row += hi - lo

    return run


def best_fit(order: list[int], size: list[int], capacity: int, gaps: list[tuple[int, int]], bin_of: np.ndarray, bins: int) -> int:
    """Place items in this order, each where the least room stays; `gaps` is sorted (room, bin).

    Returns the number of bins; new ones are opened as needed.
    """
    for i in order:
        n = size[i]
        at = bisect_left(gaps, (n, -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
        else:
            room, b, bins = capacity, bins, bins + 1
        bin_of[i] = b
        if room > n:
            insort(gaps, (room - n, b))
    return bins


def decreasing(size: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: where one island starts, and the mark that no result may exceed."""
    bin_of = np.zeros(size.size, np.int32)
    best_fit(np.argsort(-size, kind="stable").tolist(), size.tolist(), capacity, [], bin_of, 0)
    return bin_of


def random_grouping(size: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Documents in random order, each where the least room stays."""
    bin_of = np.zeros(size.size, np.int32)
    best_fit(rng.permutation(size.size).tolist(), size.tolist(), capacity, [], bin_of, 0)
    return bin_of


def fitness(bin_of: np.ndarray, size: np.ndarray, capacity: int) -> tuple[int, float]:
    """(bins, -mean squared fill); less is better."""
    fill = np.bincount(bin_of, size)
    return fill.size, -float(np.mean((fill / capacity) ** 2))


def crossover(into: np.ndarray, giver: np.ndarray, size: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child of `into` with a run of the giver's well-filled bins."""
    fill = np.bincount(giver, size)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not good.size:
        good = np.flatnonzero(fill >= np.median(fill))
    take = max(1, good.size // 12)
    gift = rng.permutation(good)[:take]
    is_gift = np.zeros(fill.size, bool)
    is_gift[gift] = True
    given = is_gift[giver]
    bins = int(into.max()) + 1
    hit = np.zeros(bins, bool)
    hit[into[given]] = True
    own = np.bincount(into, size)
    # mutation: some of the bins that are not well filled and a few others are emptied, so that their documents find better places
    emptiest = np.argsort(own, kind="stable")[: max(1, int((own < WELL_FILLED * capacity).sum()))]
    hit[emptiest[: rng.integers(1, emptiest.size + 1)]] = True
    hit[rng.integers(0, bins, rng.integers(1, max(2, bins // MIXED) + 1))] = True
    keep = ~hit[into] & ~given
    new = np.full(size.size, -1, np.int32)
    number = np.full(fill.size, -1, np.int32)
    number[gift] = np.arange(take)
    new[given] = number[giver[given]]
    left = np.flatnonzero(~hit)
    renamed = np.full(bins, -1, np.int32)
    renamed[left] = take + np.arange(left.size)
    new[keep] = renamed[into[keep]]
    room = capacity - np.bincount(new[new >= 0], size[new >= 0], minlength=take + left.size).astype(np.int64)
    open_bins = np.flatnonzero(room > 0)
    gaps = sorted(zip(room[open_bins].tolist(), open_bins.tolist()))
    loose = np.flatnonzero(new < 0)
    order = loose[np.argsort(-size[loose], kind="stable")].tolist()
    best_fit(order, size.tolist(), capacity, gaps, new, take + left.size)
    return new


def finished(bin_of: np.ndarray, size: np.ndarray, capacity: int) -> bool:
    """No grouping has fewer bins, and at most one bin is less than well filled."""
    fill = np.bincount(bin_of, size)
    return fill.size <= -(-int(size.sum()) // capacity) and int((fill < WELL_FILLED * capacity).sum()) <= 1


def evolve(population: list[np.ndarray], size: np.ndarray, capacity: int, rng, generations: int) -> list[np.ndarray]:
    """Steady-state evolution, best first; ends early where nothing is left to gain."""
    scored = sorted(((fitness(x, size, capacity), i, x) for i, x in enumerate(population)), key=lambda x: x[:2])
    fresh = len(scored)
    for _ in range(generations):
        if finished(scored[0][2], size, capacity):
            break
        for _ in range(len(population)):
            a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
            child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], size, capacity, rng)
            scored.append((fitness(child, size, capacity), fresh, child))
            fresh += 1
        scored.sort(key=lambda x: x[:2])
        del scored[len(population) :]
    return [x for _, _, x in scored]


def _block(batch_table: pa.Table) -> pa.Table:
    """All items of one block as one row; their order fixes what a grouping's places mean."""
    t = batch_table.sort_by([(x, "ascending") for x in ("length", "doc_id", "piece", "row", "ids_crc32")])
    flat = {x: pa.array([t[x].fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()) for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
    nulls = pa.array([t["doc_id"].is_null().to_numpy().tobytes()], pa.binary())
    return pa.table({"block": t["block"][:1], **flat, "nulls": nulls})


def _evolve(capacity: int, epoch: int, generations: int, members: int):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"block": [], "island": [], "length": [], "population": [], "bins": [], "unfit": []}
            for block, island, raw, own, elite in zip(*(batch.column(x) for x in ("block", "island", "length", "population", "elite"))):
                size = np.frombuffer(raw.as_buffer(), "<i8")
                rng = np.random.default_rng([block.as_py(), island.as_py(), epoch])
                if own.is_valid:
                    people = list(np.frombuffer(own.as_buffer(), "<i4").reshape(-1, size.size))
                    people[-1] = np.frombuffer(elite.as_buffer(), "<i4")[: size.size]
                else:
                    people = [random_grouping(size, capacity, rng) for _ in range(members - (island.as_py() == 0))]
                    if island.as_py() == 0:
                        people.insert(0, decreasing(size, capacity))
                people = evolve(people, size, capacity, rng, generations)
                bins, unfit = fitness(people[0], size, capacity)
                for k, v in zip(out, (block.as_py(), island.as_py(), raw.as_py(), np.stack(people).astype("<i4").tobytes(), bins, unfit)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), pa.array(out["island"], pa.int32()), pa.array(out["length"], pa.binary()), pa.array(out["population"], pa.binary()), pa.array(out["bins"], pa.int32()), pa.array(out["unfit"], pa.float64())], names=list(out))

    return run


def _place(capacity: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                doc, piece, start, length, crc = (np.frombuffer(batch.column(x)[k].as_buffer(), "<i8") for x in ("doc_id", "piece", "start", "length", "ids_crc32"))
                nulls = np.frombuffer(batch.column("nulls")[k].as_buffer(), bool)
                bin_of = np.frombuffer(batch.column("population")[k].as_buffer(), "<i4")[: doc.size].astype(np.int64)
                order = np.argsort(bin_of, kind="stable")
                ends = np.cumsum(length[order])
                first = np.searchsorted(bin_of[order], bin_of[order])
                offset = np.empty(doc.size, np.int64)
                offset[order] = ends - length[order] - (ends - length[order])[first]
                sequence = (batch.column("block")[k].as_py() << 32) + bin_of
                fill = np.bincount(bin_of, length).astype(np.int64)[bin_of]
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=nulls), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(sequence), pa.array(offset), pa.array(fill)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"])

    return run


RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _evolved(small: DataFrame, blocks_n: int, first_block: int, capacity: int) -> DataFrame:
    """RESULT columns and each sequence's fill for pieces shorter than `capacity`, packed in `blocks_n` blocks."""
    held = small.withColumn("block", F.lit(first_block).cast("long") + F.pmod(F.xxhash64("doc_id", "piece", "row", "ids_crc32"), F.lit(blocks_n)))
    blocks = saved(held.groupBy("block").applyInArrow(_block, "block long, doc_id binary, piece binary, start binary, length binary, ids_crc32 binary, nulls binary"), "blocks")
    tasks = min(blocks_n * ISLANDS, max(96, blocks_n // 8))
    islands = blocks.select("block", "length", F.explode(F.expr(f"sequence(0, {ISLANDS - 1})")).alias("island")).withColumns({"population": F.lit(None).cast("binary"), "elite": F.lit(None).cast("binary")})
    schema = "block long, island int, length binary, population binary, bins int, unfit double"
    for epoch in range(EPOCHS):
        people = saved(arrow_map(islands.repartition(tasks, "block", "island"), _evolve(capacity, epoch, GENERATIONS, POPULATION), schema), "islands")
        elite = people.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population").alias("elite"))
        islands = people.drop("bins", "unfit").join(elite, ["block", "island"])
    first = Window.partitionBy("block").orderBy("bins", "unfit", "island")
    best = people.withColumn("place", F.row_number().over(first)).where("place = 1").select("block", "population")
    return arrow_map(blocks.join(best, "block"), _place(capacity), RESULT + ", fill long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Sequences for pieces (PIECE columns) of 1 to `capacity` tokens."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rest, parts, first = pieces.where(F.col("length") < capacity), [], 0
    n = rest.count()
    while True:
        blocks_n = max(1, -(-n // block_items))
        packed = _evolved(rest, blocks_n, first, capacity)
        if blocks_n == 1:
            parts.append(packed)
            break
        packed, first = saved(packed, "packed"), first + blocks_n
        # a row for each fill, `capacity` at most
        held = sorted(((r["fill"], r["count"]) for r in packed.groupBy("fill").count().collect()), reverse=True)
        limit, closed = capacity, held[0][1] if held[0][0] == capacity else 0
        if closed < FULL_ROWS * n:
            closed = 0
            for limit, rows in held:
                closed += rows
                if 2 * closed >= n:
                    break
        parts.append(packed.where(F.col("fill") >= limit))
        if closed == n:
            break
        rest = packed.where(F.col("fill") < limit).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_id") * F.lit(31) + F.col("offset")).alias("row"))
        n -= closed
    packed = reduce(DataFrame.unionByName, (x.select(names) for x in parts))
    full = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.select(names).unionByName(full)


def pack_documents(docs: DataFrame, file: str | None = None, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed each by itself; null ids stay null;
    of very long texts all tokens count; of equally good groupings the one of the first island stays; other columns are not
    read; an empty table gives an empty result.  sequence_id is the block's number
    with the bin's, or negative for a full piece.
    """
    from .common import ship

    ship(docs.sparkSession)
    file = file or tokenizer_file("word_bpe_49k.json")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = saved(arrow_map(text, _pieces(file, end, capacity), PIECE), "pieces")
    return pack_pieces(pieces, capacity)
