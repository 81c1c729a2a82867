"""Token shards as wavelet matrices: one compressed file per run of documents.

File (`.wm`): magic, then a zstandard frame holding a header of six longs (tokens, documents,
bit planes, rank block words, first ordinal, reserved), the documents' ids, null flags and lengths, the zero
count of each plane, and the planes from the highest bit down.  A plane keeps the bit of every token,
stably parted by the bits above it.  Rank counts over 64-bit words are rebuilt on reading.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, saved, slices, tokenizer_file
from .tokens import library_coder, with_end

MAGIC = b"GWWMAT01"
END_ID = 2
#: Tokens gathered for one file; a file ends with the document that reaches it.
FILE_TOKENS = 3 << 20
#: Text bytes meant for one range partition.
SHARD_BYTES = 16 << 20


class WaveletMatrix:
    """Succinct sequence of non-negative integers with access, rank, select, count and lookup."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        n = values.size
        bits = bits or max(1, int(values.max()).bit_length() if n else 1)
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-packed.size % 8 + 8, np.uint8)]).view("<u8"))
            low = now.take(np.flatnonzero(~one))  # several times as fast as a boolean index
            zeros.append(low.size)
            now = np.concatenate([low, now.take(np.flatnonzero(one))])
        return cls(n, planes, zeros)

    @property
    def bits(self) -> int:
        return len(self.planes)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        if self._ranks is None:
            self._ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in self.planes]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.planes[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self._ranks[level][word] + np.bitwise_count(below)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at the places `at`."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.size, np.uint32)
        for level, zero in enumerate(self.zeros):
            one = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            before = self._rank1(level, at)
            at = np.where(one == 1, zero + before, at - before)
            out = (out << np.uint32(1)) | one.astype(np.uint32)
        return out

    def values(self) -> np.ndarray:
        """Every value in order: the stable partings undone from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            out, zero = np.empty_like(now), self.zeros[level]
            out[np.flatnonzero(~one)] = now[:zero]
            out[np.flatnonzero(one)] = now[zero:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = out
        return now

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        ends = np.array([lo, hi], np.int64)
        for level, zero in enumerate(self.zeros):
            before = self._rank1(level, ends)
            ends = zero + before if value >> (self.bits - 1 - level) & 1 else ends - before
        return int(ends[0]), int(ends[1])

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Times `value` stands in places lo to hi - 1."""
        if value < 0 or value >> self.bits:
            return 0
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, value: int, at: int) -> int:
        return self.count(value, 0, at)

    def _select_bit(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) such bits of a plane."""
        self._rank1(level, np.zeros(1, np.int64))
        ones = self._ranks[level]
        upto = ones if bit else np.arange(ones.size, dtype=np.int64) * 64 - ones
        word = np.searchsorted(upto, k, side="right") - 1
        rest = k - upto[word]
        bits = np.unpackbits(self.planes[level][word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        return word * 64 + np.argmax(np.cumsum(bits, axis=1) > rest[:, None], axis=1)

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) occurrences of `value`."""
        first, _ = self._range(value, 0, 0)
        at = np.asarray(k, np.int64) + first
        for level in range(self.bits - 1, -1, -1):
            if value >> (self.bits - 1 - level) & 1:
                at = self._select_bit(level, 1, at - self.zeros[level])
            else:
                at = self._select_bit(level, 0, at)
        return at

    def occurrences(self, value: int) -> np.ndarray:
        """All places of `value`, in order."""
        n = self.count(value)
        return self.select(value, np.arange(n)) if n else np.zeros(0, np.int64)


def dump(matrix: WaveletMatrix, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, first: int) -> bytes:
    head = np.array([matrix.n, lengths.size, matrix.bits, 1, first, 0], "<i8")
    parts = [head, doc_ids.astype("<i8"), nulls.astype("<i8"), lengths.astype("<i8"), np.array(matrix.zeros, "<i8"), *matrix.planes]
    return MAGIC + zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def load(raw: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray, int]:
    """Matrix, document ids, null flags, lengths, first ordinal."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file of this format")
    data = zstandard.ZstdDecompressor().decompress(raw[8:])
    n, docs, bits, _, first, _ = np.frombuffer(data, "<i8", 6).tolist()
    longs = np.frombuffer(data, "<i8", 3 * docs + bits, 48)
    planes = np.frombuffer(data, "<u8", -1, 48 + 8 * longs.size).reshape(bits, -1)
    return WaveletMatrix(n, list(planes), longs[3 * docs :].tolist()), longs[:docs], longs[docs : 2 * docs], longs[2 * docs : 3 * docs], first


def put_file(folder: str, name: str, raw: bytes) -> None:
    """Write a file in the shared folder: whole or not at all, and again on a retry."""
    import os

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    part = f"{root}/_part-{os.getpid()}-{os.urandom(6).hex()}"
    with system.open_output_stream(part) as out:
        out.write(raw)
    system.move(part, f"{root}/{name}")


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id and text, range partitioned and sorted by doc_id (nulls first, ties by text)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return text.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")


def id_stream(batches, coder, end: int):
    """(doc_id array, ids, offsets) of each slice."""
    for batch in batches:
        text, ids = batch.column("text"), batch.column("doc_id")
        for lo, hi in slices(text):
            yield ids[lo:hi], *with_end(*coder.ids(text[lo:hi]), end)


def _write(folder: str, file: str, end: int, bits: int, limit: int):
    def run(batches):
        from pyspark import TaskContext

        shard, coder, part, first = TaskContext.get().partitionId(), library_coder(file, False), 0, 0
        held: list[tuple] = []

        def flush():
            ids = np.concatenate([x[1] for x in held])
            who = pa.concat_arrays([x[0] for x in held])
            lengths = np.concatenate([np.diff(x[2]) for x in held])
            nulls = who.is_null().to_numpy(zero_copy_only=False)
            put_file(folder, f"shard-{shard:07d}-{part:05d}.wm", dump(WaveletMatrix.build(ids, bits), who.fill_null(0).to_numpy(), nulls, lengths, first))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, part, lengths.size, ids.size)], names=["shard", "part", "docs", "tokens"])

        for who, ids, offsets in id_stream(batches, coder, end):
            held.append((who, ids, offsets))
            if sum(x[1].size for x in held) >= limit:
                yield flush()
                part, first, held[:] = part + 1, first + sum(len(x[0]) for x in held), []
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, file: str | None = None, end: int = END_ID, limit: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Encode and write all documents in ascending doc_id order; the folder and its manifest.

    Null texts are empty and give the end id alone; null ids come first; rows with equal ids follow in
    text order; an empty table gives no file.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    file = file or tokenizer_file("byte_bpe_50k.json")
    bits = max(Tokenizer.from_file(file).get_vocab_size() - 1, end).bit_length()
    folder = fresh_path(spark, "wavelet")
    manifest = saved(arrow_map(ordered(docs), _write(folder, file, end, bits, limit), "shard long, part long, docs long, tokens long"), "manifest")
    return folder, manifest


def _read(batches):
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
            matrix, who, nulls, lengths, _ = load(raw.as_buffer().to_pybytes())
            shard, part = (int(x) for x in path.rsplit("/", 1)[1][6:-3].split("-"))
            ids = matrix.values().astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(who.size, shard)), pa.array(np.full(who.size, part)), pa.array(who, mask=nulls.astype(bool)), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                names=["shard", "part", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    rows = arrow_map(files, _read, "shard long, part long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # one row for each file: a few million at 100 TB, so one task may run the prefix sum
    before = manifest.select("shard", "part", (F.sum("tokens").over(Window.orderBy("shard", "part")) - F.col("tokens")).alias("before"))
    return rows.join(before, ["shard", "part"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
