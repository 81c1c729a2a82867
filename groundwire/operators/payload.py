"""Ranked items under a byte budget, counted with the envelope that tells of the count."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Estimated tokens of a payload by default, the bounds of what may be asked, and the bytes of one.
BUDGET, LEAST, MOST, BYTES_A_TOKEN = 1500, 256, 16000, 4
# The envelope's own fields, as they are written.
FIELDS = '"items":[],"usage":{"bytes":,"estimated_tokens":,"max_bytes":,"omitted":,"token_estimate":"ceil(UTF-8 bytes / 4); model dependent"}'


class Envelope:
    """Bytes of one payload so far: what is certain, and the fields that count it, whose digits are counted too."""

    def __init__(self, meta: int, items: int, budget: int):
        # the metadata's object gets the envelope's fields, behind a comma if it has some of its own
        self.plain = meta + len(FIELDS) + (1 if meta > 2 else 0) + len(str(budget * BYTES_A_TOKEN))
        self.limit, self.items, self.taken, self.held = budget * BYTES_A_TOKEN, items, 0, 0
        self.bytes = self.tokens = 0

    def settled(self, extra: int, taken: int) -> int:
        """The size with `extra` bytes of items, once it agrees with the number that it states."""
        fixed = self.plain + extra + max(0, taken - 1) + len(str(self.items - taken))
        size = fixed + len(str(self.bytes)) + len(str(self.tokens))
        for _ in range(8):
            told = (size, -(-size // BYTES_A_TOKEN))
            if told == (self.bytes, self.tokens):
                break
            self.bytes, self.tokens = told
            size = fixed + len(str(self.bytes)) + len(str(self.tokens))
        return size

    def offer(self, size: int) -> bool:
        """Whether an item of `size` bytes still fits; one that does stays."""
        if self.settled(self.held + size, self.taken + 1) > self.limit:
            return False
        self.held, self.taken = self.held + size, self.taken + 1
        return True


def _fold(budget: int):
    """Rows sorted by (group, first, order): a group's metadata row, then its items, one at a time; no group is held."""

    def run(batches):
        now, envelope, fits = None, None, False
        for batch in batches:
            rows = batch.to_pydict()
            out: dict = {"group": [], "order": [], "kept": [], "bytes": [], "tokens": [], "omitted": []}

            def say(order, kept, out=out):
                for name, value in zip(out, (now, order, kept, envelope.bytes, envelope.tokens, envelope.items - envelope.taken)):
                    out[name].append(value)

            for group, order, size, items in zip(rows["group"], rows["order"], rows["size"], rows["items"]):
                if items is not None:
                    if envelope is not None:
                        envelope.settled(envelope.held, envelope.taken)
                        say(None, fits)
                    now, envelope = group, Envelope(size, items, budget)
                    fits = envelope.settled(0, 0) <= envelope.limit
                elif fits:
                    say(order, envelope.offer(size))
                else:
                    say(order, False)
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)
        if envelope is not None:
            envelope.settled(envelope.held, envelope.taken)
            yield pa.RecordBatch.from_pydict({"group": [now], "order": [None], "kept": [fits], "bytes": [envelope.bytes], "tokens": [envelope.tokens], "omitted": [envelope.items - envelope.taken]}, schema=_OUT)

    return run


_OUT = pa.schema([("group", pa.string()), ("order", pa.int64()), ("kept", pa.bool_()), ("bytes", pa.int64()), ("tokens", pa.int64()), ("omitted", pa.int64())])


def bounded(items: DataFrame, groups: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Which items fit, and what each payload then says of itself.

    items: group, order (a number), text (JSON of one item); groups: group, meta (JSON of the metadata, `{}` at least).
    Gives (group, order, kept) for each item, and for each group one row with a null order: kept tells whether the
    metadata alone fit, bytes, tokens and omitted are the payload's own figures.  An item that does not fit is left out and later
    ones may still fit.  Groups without items have their row; items of unknown groups are left out.
    """
    if not LEAST <= budget <= MOST:
        raise ValueError(f"budget must be from {LEAST} to {MOST}")
    ship(items.sparkSession)
    bytes_of = lambda x: F.octet_length(x).cast("long")
    counted = items.groupBy("group").agg(F.count("*").alias("n"))
    heads = groups.join(counted, "group", "left").select(F.col("group").cast("string").alias("group"), F.lit(0).alias("first"), F.lit(None).cast("long").alias("order"), bytes_of("meta").alias("size"), F.coalesce("n", F.lit(0)).alias("items"))
    rows = items.join(groups.select("group"), "group", "left_semi").select(F.col("group").cast("string").alias("group"), F.lit(1).alias("first"), F.col("order").cast("long").alias("order"), bytes_of("text").alias("size"), F.lit(None).cast("long").alias("items"))
    # dealt by a hash of its own: by the group itself Spark could rely on how the joins before left the rows, and then
    # change these joins while they run
    dealt = heads.unionByName(rows).withColumn("dealt", F.xxhash64("group")).repartition("dealt").sortWithinPartitions("group", "first", "order")
    return dealt.drop("dealt").mapInArrow(_fold(budget), "group string, order long, kept boolean, bytes long, tokens long, omitted long")
