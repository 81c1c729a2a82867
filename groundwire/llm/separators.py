"""Document bounds in flat, unindexed token files: a separator scan.

Files hold ids as little-endian unsigned 16-bit integers (32-bit where the vocabulary has larger ids) and nothing
else; a document ends with the separator id and may reach over blocks and files.  Tasks read byte ranges of files of any
size; every block is searched by itself with one vector comparison; a prefix scan over block summaries then gives each separator its
place in the stream, its document's number and, from the last separator of earlier blocks, the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, saved, tokenizer_file
from .tokens import library_coder
from .wavelet import id_stream, put_file

SEPARATOR = 50256
FILE_TOKENS = 4 << 20
BLOCK_TOKENS = 1 << 18


def id_width(file: str, separator: int) -> int:
    """Bytes of an id: 2 where all ids of the vocabulary and the separator fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(file).get_vocab_size() - 1, separator) < 1 << 16 else 4


def _write(folder: str, file: str, separator: int, limit: int, kind: str):
    def run(batches):
        from pyspark import TaskContext

        shard, coder, part, at = TaskContext.get().partitionId(), library_coder(file, False), 0, 0
        held: list[np.ndarray] = []
        for who, ids, _ in id_stream(batches, coder, separator):
            held.append(ids.astype(kind))
            while sum(x.size for x in held) >= limit:
                flat = np.concatenate(held)
                put_file(folder, f"shard-{shard:07d}-{part:05d}.ids", flat[:limit].tobytes())
                held, part = [flat[limit:]], part + 1
            n = len(who)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(at, at + n)), who], names=["shard", "ordinal", "doc_id"])
            at += n
        if sum(x.size for x in held):
            put_file(folder, f"shard-{shard:07d}-{part:05d}.ids", np.concatenate(held).tobytes())

    return run


def write_flat(docs: DataFrame, file: str | None = None, separator: int = SEPARATOR, limit: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Encode all documents into flat files; the folder and (shard, ordinal, doc_id).

    Each partition of `docs` writes its rows as they come, without a shuffle; a file is cut after
    `limit` ids, wherever that falls in a document.
    """
    file, folder = file or tokenizer_file("byte_bpe_50k.json"), fresh_path(docs.sparkSession, "flat")
    kind = f"<u{id_width(file, separator)}"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return folder, saved(arrow_map(text, _write(folder, file, separator, limit, kind), "shard long, ordinal long, doc_id long"), "written")


def _scan(separator: int, kind: str):
    def run(batches):
        for batch in batches:
            size, last, ends = [], [], []
            for raw in batch.column("bytes"):
                ids = np.frombuffer(raw.as_buffer(), kind)
                hit = np.flatnonzero(ids == separator)
                size.append(ids.size)
                last.append(int(hit[-1]) if hit.size else None)
                ends.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(size, pa.int64()), pa.array(last, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "last", "ends"])

    return run


def _ranges(folder: str, step: int):
    """Bytes of each (file, block) of the folder, read by the task that searches them."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                with system.open_input_file(f"{root}/{file.rsplit('/', 1)[1]}") as source:
                    source.seek(block * step)
                    raw = source.read(step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int32()), pa.array([raw], pa.binary())], names=["file", "block", "bytes"])

    return run


def scan_separators(files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK_TOKENS, width: int | None = None, folder: str | None = None) -> DataFrame:
    """doc_index, start, n_tokens (separator included), closed: one row per document of the stream.

    `files`: path and content of the flat files, or path and length of files in `folder`, which are then read in byte
    ranges; their order is that of their paths.  `width`: bytes of an id (2, or 4 for a separator beyond 65,535).  Ids
    after the last separator make a last row with closed = false; adjacent separators make documents of one id; no
    file or only empty files give an empty result.
    """
    width = width or (2 if separator < 1 << 16 else 4)
    step = block * width
    number = "sequence(0, cast(({} - 1) div {} as int))"
    if folder is None:
        pieces = F.expr(f"transform({number.format('length(content)', step)}, i -> substring(content, i * {step} + 1, {step}))")
        blocks = files.where("length(content) > 0").select(F.col("path").alias("file"), F.posexplode(pieces).alias("block", "bytes"))
    else:
        listed = files.where("length > 0").select(F.col("path").alias("file"), F.explode(F.expr(number.format("length", step))).alias("block"))
        # a row for each range: without this a task would read all ranges of the files that one listing task got
        spread = listed.repartition(max(1, min(-(-listed.count() // 8), 1 << 16)), "file", "block")
        blocks = arrow_map(spread, _ranges(folder, step), "file string, block int, bytes binary")
    seen = saved(arrow_map(blocks, _scan(separator, f"<u{width}"), "file string, block int, size long, last long, ends array<long>"), "blocks")

    # prefix scan, first over files (one row each), then over the blocks of each file
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.select("file", "block", "size", "last", "ends", F.coalesce(F.sum("size").over(in_file), F.lit(0)).alias("at"), F.coalesce(F.sum(F.size("ends")).over(in_file), F.lit(0)).alias("n"))
    placed = placed.withColumn("carried", F.max(F.col("at") + F.col("last")).over(in_file))
    totals = placed.groupBy("file").agg(F.sum("size").alias("size"), F.sum(F.size("ends")).cast("long").alias("n"), F.max(F.col("at") + F.col("last")).alias("last"))
    files_before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "size", F.col("last").alias("own"), F.coalesce(F.sum("size").over(files_before), F.lit(0)).alias("file_at"), F.coalesce(F.sum("n").over(files_before), F.lit(0)).alias("file_n"))
    totals = totals.withColumn("file_last", F.coalesce(F.max(F.col("file_at") + F.col("own")).over(files_before), F.lit(-1)))
    stream = placed.join(totals.select("file", "file_at", "file_n", "file_last"), "file")
    stream = stream.select(F.col("ends"), (F.col("file_at") + F.col("at")).alias("base"), (F.col("file_n") + F.col("n")).alias("index"), F.coalesce(F.col("file_at") + F.col("carried"), "file_last").alias("before"))
    rows = stream.select("base", "index", "before", "ends", F.posexplode("ends").alias("k", "end")).select(
        (F.col("index") + F.col("k")).alias("doc_index"),
        (F.when(F.col("k") == 0, F.col("before")).otherwise(F.col("base") + F.expr("ends[k - 1]")) + 1).alias("start"),
        (F.col("base") + F.col("end")).alias("stop"),
    )
    closed = rows.select("doc_index", "start", (F.col("stop") - F.col("start") + 1).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = totals.agg(F.max(F.col("file_at") + F.col("size")).alias("total"), F.max(F.greatest("file_last", F.coalesce(F.col("file_at") + F.col("own"), F.lit(-1)))).alias("last"))
    count = seen.agg(F.sum(F.size("ends")).cast("long").alias("doc_index"))
    rest = whole.join(count, F.lit(True)).where("total > last + 1").select("doc_index", (F.col("last") + 1).alias("start"), (F.col("total") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def flat_files(spark, folder: str) -> DataFrame:
    """path and length of the folder's files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "length")


def document_tokens(docs: DataFrame, file: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, doc_index, start, n_tokens, closed of all documents, found by scanning their flat files.

    doc_index and start follow the stream of files, whose order is that of the input's partitions.  Null
    texts are empty documents (their separator alone); null ids stay null; repeated rows count each; other
    columns are not read; an empty table gives an empty result.
    """
    spark, file = docs.sparkSession, file or tokenizer_file("byte_bpe_50k.json")
    folder, written = write_flat(docs, file, separator)
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, doc_index long, start long, n_tokens long, closed boolean")
    found = scan_separators(flat_files(spark, folder), separator, width=id_width(file, separator), folder=folder)
    counts = written.groupBy("shard").agg(F.count("*").alias("n"))
    before = counts.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    names = written.join(before, "shard").select((F.col("before") + F.col("ordinal")).alias("doc_index"), "doc_id")
    return names.join(found, "doc_index", "full").select("doc_id", "doc_index", "start", "n_tokens", "closed")
