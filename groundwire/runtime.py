"""Session helpers: intermediate tables in the shared folder, row numbers, Python parsers on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where the setting is missing, as in tests, a local master gets a temporary folder that goes
    at exit; a cluster without the setting is an error, because no local folder could serve.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="groundwire-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/groundwire/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str) -> DataFrame:
    """`saved` in files about as large as their rows: neither packed nor coded by dictionary.

    A join sends a table to the driver and to every task where its files are small, and those of paths and facts that repeat
    each other are by `saved` up to a hundredth of their rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by its keys over all shuffle partitions.

    A small file is one split and so one task, whatever is made of each of its rows; this comes before much is made of
    them, when a row is a few bytes.  The number is a fixed one, so that no step joins the small partitions again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def ordered(df: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """`df` with each row's place (from 1) in the order of `keys`.

    The order is range-partitioned and written; a place is the row's number within its partition and the rows of
    the partitions before, so that no task sees all rows.
    """
    spark = df.sparkSession
    at = F.col("__at")
    held = saved(df.orderBy(*keys).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    held = held.withColumns({"__part": F.shiftright(at, 33), "__row": at.bitwiseAND(F.lit((1 << 33) - 1))})
    # a row for each partition
    before, offsets = 0, []
    for part, n in sorted((r["__part"], r["count"]) for r in held.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets, "__part long, __before long")
    return held.join(F.broadcast(starts), "__part").withColumn(place, F.col("__before") + F.col("__row") + 1).select(*df.columns, place)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_groundwire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="groundwire-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/groundwire_package.zip", "w") as out:
        for file in root.rglob("*.py"):
            out.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(f"{folder}/groundwire_package.zip")
    sc._groundwire_shipped = True


def per_row(df: DataFrame, function, columns: list[str], schema: str) -> DataFrame:
    """Rows that a Python parser yields for each row's columns; for inputs that no built-in can read."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches):
        for batch in batches:
            out = [row for args in zip(*(batch.column(c).to_pylist() for c in columns)) for row in function(*args)]
            if out:
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)}, schema=None)

    return df.select(*columns).mapInArrow(run, schema)
