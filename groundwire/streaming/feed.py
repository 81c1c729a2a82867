"""The change log as a stream of files: the checkpoint is the cursor, and the last operation of each node is keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGE = "seq long, ts long, commit_hash string, node string, op string"
LATEST = "node string, op string, seq long"
#: State lives in the checkpoint, as changes to a local store that is uploaded with each batch.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """New change files as they come; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(CHANGE).json(folder)


class Latest(StatefulProcessor):
    """Holds a node's last operation, and gives it again whenever a later one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "op string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        best = None if held is None else (held[1], held[0])
        came = best
        for part in rows:
            for op, seq in zip(part["op"], part["seq"]):
                if came is None or (seq, op) > came:
                    came = (int(seq), op)
        if came is not None and came != best:
            self.last.update((came[1], came[0]))
            yield pd.DataFrame({"node": [key[0]], "op": [came[1]], "seq": [came[0]]})

    def close(self) -> None:
        pass


def latest(stream: DataFrame) -> DataFrame:
    """(node, op, seq) of each node whose last operation a batch moves on; late and repeated changes move nothing.

    The state of a batch's own nodes is read and written, not that of all nodes.  Rows without a node or a number are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where("node is not null and seq is not null").select("node", F.coalesce("op", F.lit("")).alias("op"), "seq")
    return rows.groupBy("node").transformWithStateInPandas(Latest(), outputStructType=LATEST, outputMode="update", timeMode="none")


def follow_latest(stream: DataFrame, target: str, checkpoint: str):
    """Writes what each batch moves on to `target`, from keyed state; ends when the input is read.

    A batch has a folder of its own, which it replaces when it is run again after a failure.  `read_latest` puts them together.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return latest(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """(node, op, seq): the last operation of each node that `follow_latest` has written."""
    held = spark.read.schema(f"{LATEST}, batch int").parquet(target)
    return held.groupBy("node").agg(F.max_by("op", F.struct("seq", "op")).alias("op"), F.max("seq").alias("seq"))


def keep_latest(stream: DataFrame, target: str, checkpoint: str):
    """Keep the last operation of each node in `target`, all nodes anew with every batch; for logs of few nodes.

    Each batch's state is a new folder under `target` and readers take the newest whole one, so a batch that is run
    again after a failure writes the same folder.
    """
    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.select("node", "op", "seq")
        if number > 0:
            now = now.unionByName(spark.read.parquet(f"{target}/batch={number - 1}"))
        now.groupBy("node").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
