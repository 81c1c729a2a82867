"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire import runtime
from groundwire.runtime import fresh_path, ordered, saved  # noqa: F401

#: Text bytes handled by one round of array work; bounds a worker's memory beside its longest text.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 16 << 20
BATCH_KEY, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
#: Rows of such a round at most.
SLICE_ROWS = 4000


def tokenizer_file(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes another as a parameter."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark context."""
    runtime.ship(spark)
    # batches of 64 MB (the default) times the copies in both processes would be most of a small executor; a
    # session that has set a size of its own keeps it
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


_HELD: dict = {}


def hold(key, make):
    """A worker's large object under `key`, made on first use and kept over the tasks of one operator."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _tidied(function):
    """The function with a worker's memory put in order: workers outlive tasks and serve all operators."""
    name = f"{function.__module__}.{function.__qualname__}"

    def run(batches):
        from groundwire.llm import common

        if common._HELD.get("operator") != name:
            common._HELD.clear()
            common._HELD["operator"] = name
        yield from function(batches)
        common.trim()

    return run


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidied(function), schema)


def id_remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null ids have no remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of `docs` as one struct: names of a caller's columns cannot clash with an operator's own."""
    quoted = [F.col("`" + x.replace("`", "``") + "`") for x in docs.columns]
    return F.struct(*quoted).alias(name)


def slices(text: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of `text` with about `limit` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and (held + n > limit or i - lo >= SLICE_ROWS):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def with_columns(schema, **more):
    """Spark schema of `schema` with further named types."""
    from pyspark.sql.types import StructType

    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out
