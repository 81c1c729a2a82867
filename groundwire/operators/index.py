"""The nodes of an index, what a synchronisation changed, and the change log that records it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ordered
from .relations import union_all

# Endings of files that an audit reads.
AUDIT_SUFFIXES = (".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".mts", ".cts", ".go", ".rs", ".java", ".kt", ".cs", ".php", ".rb", ".vue", ".svelte")


def snapshot(index) -> DataFrame:
    """(node, file, kind) of all nodes that an index (`change.Index`) holds: env, dist, route, symbol."""
    env = index.env.select(F.concat(F.lit("env:"), "name").alias("node"), "file", F.lit("env").alias("kind"))
    dist = index.dists.where("kind <> 'error' and dist <> ''").select(F.concat(F.lit("dist:"), "lang", F.lit(":"), "dist").alias("node"), "file", F.lit("dist").alias("kind"))
    route = index.routes.where("full is not null").select(F.concat(F.lit("route:"), "method", F.lit(" "), "full").alias("node"), "file", F.lit("route").alias("kind"))
    symbol = index.facts.where("tag = 'symbol'").select(F.concat(F.lit("symbol:"), "path", F.lit(":"), "name").alias("node"), F.col("path").alias("file"), F.lit("symbol").alias("kind"))
    return union_all([env, dist, route, symbol]).distinct()


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file): paths whose text differs between two trees (path, text), or that only one of them has."""
    b, a = (x.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias(n), F.lit(True).alias(f"in_{n}")) for x, n in ((before, "b"), (after, "a")))
    both = b.join(a, "path", "full")
    return both.where(~F.col("b").eqNullSafe(F.col("a")) | F.col("in_b").isNull() | F.col("in_a").isNull()).select(F.col("path").alias("file"))


def sync_changes(before: DataFrame, after: DataFrame, files: DataFrame) -> DataFrame:
    """(node, op) that one synchronisation records, given both snapshots and the changed files.

    Files are changed; nodes are added or removed; symbols of changed files are changed if they stay, as are environment
    names and distributions that a changed file declares, and all routes if a Python file changed.
    """
    f = files.select("file").distinct()
    b, a = (x.select("node", "kind").distinct().withColumn(n, F.lit(True)) for x, n in ((before, "was"), (after, "now")))
    moved = b.join(a, ["node", "kind"], "full").select("node", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").alias("op")).where("op is not null")
    touched = before.unionByName(after).where("kind <> 'route'").join(f, "file", "left_semi").select("node")
    python = f.where("file like '%.py'").limit(1).select(F.lit(True).alias("any"))
    routes = before.unionByName(after).where("kind = 'route'").select("node").distinct().join(F.broadcast(python), F.lit(True), "left_semi")
    stay = touched.unionByName(routes).distinct().join(moved, "node", "left_anti").select("node", F.lit("changed").alias("op"))
    return union_all([f.select(F.concat(F.lit("file:"), "file").alias("node"), F.lit("changed").alias("op")), moved, stay]).distinct()


def head_seq(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def record_changes(log: DataFrame, changed: DataFrame, commit: str = "", ts: int = 0) -> DataFrame:
    """Rows (seq, ts, commit_hash, node, op) to be appended to the log: distinct changes in order of node and op."""
    rows = ordered(changed.select("node", "op").distinct(), ["node", "op"], "place")
    return rows.select((F.col("place") + F.lit(head_seq(log))).alias("seq"), F.lit(ts).cast("long").alias("ts"), F.lit(commit).alias("commit_hash"), "node", "op")


def prune_changes(log: DataFrame, keep: int = 200_000) -> DataFrame:
    """The last `keep` sequence numbers of the log."""
    return log.where(F.col("seq") > F.lit(head_seq(log) - keep))


def changes_since(log: DataFrame, since: int, limit: int = 50_000) -> DataFrame:
    """One page, oldest first: last op of each node on it, with the page's cursor and has_more.

    A reader that goes on from the cursor (the last sequence number of the page, not of a node) skips nothing.
    """
    some = log.where(F.col("seq") > since).orderBy("seq").limit(limit + 1).select("seq", "node", "op", F.row_number().over(Window.orderBy("seq")).alias("n"))
    page = some.where(F.col("n") <= limit)
    state = some.agg(F.max(F.when(F.col("n") <= limit, F.col("seq"))).alias("cursor"), (F.max("n") > limit).alias("has_more"))  # one row
    return page.groupBy("node").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("last_seq")).crossJoin(F.broadcast(state))


def select_files(tree: DataFrame, prefix: str = "", limit: int = 2_000_000) -> DataFrame:
    """Files (path, text) that an audit reads: sources of at most `limit` bytes under a path prefix."""
    return tree.where(F.col("path").startswith(prefix) & F.col("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in AUDIT_SUFFIXES) + ")$") & (F.octet_length("text") <= limit))


def readable(text: Column, limit: int = 512_000) -> Column:
    """The text, or null where it holds a NUL or more than `limit` bytes."""
    return F.when((F.octet_length(text) <= limit) & ~text.contains("\0"), text)
