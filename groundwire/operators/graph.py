"""The context graph of a tree: files, symbols, names, distributions and routes with their relations."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import sized
from .change import Index, check_change
from .index import readable
from .relations import innermost, neighbours, union_all


def context_edges(tree: DataFrame, index: Index | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(a, b, relation, file, line) of a tree (path, text).

    A symbol is named with the definitions around it, so methods of two classes stand apart.  A reference that is accepted
    leads from the innermost symbol around it, or from its file, to what it names; a route leads to its handler where one
    symbol of its own file has that name.
    """
    index = index or Index(tree)
    none = F.lit(None).cast("long")
    file = lambda c: F.concat(F.lit("file:"), F.col(c))
    symbols = index.facts.where("tag = 'scope'").select(F.col("path").alias("file"), "name", "line", F.col("extra").cast("long").alias("end"))
    symbol = F.concat(F.lit("symbol:"), "file", F.lit(":"), "name")
    declares = symbols.select(file("file").alias("a"), symbol.alias("b"), F.lit("declares").alias("relation"), "file", "line")
    env = index.env.select(file("file").alias("a"), F.concat(F.lit("env:"), "name").alias("b"), F.lit("declares").alias("relation"), "file", none.alias("line"))
    listed = index.dists.where("kind <> 'error'")
    dists = listed.select(file("file").alias("a"), F.concat(F.lit("dist:"), "lang", F.lit(":"), "dist").alias("b"), F.lit("declares_dependency").alias("relation"), "file", none.alias("line"))
    if findings is None:
        from ..sources.files import region_lines

        findings = check_change(region_lines(tree.withColumn("text", readable(F.col("text")))), tree, index)
    findings = sized(findings, "findings")
    good = findings.where("level = 'accept'").select("kind", "subject", "file", "line")
    names = index.env.select(F.col("name").alias("subject")).distinct()
    reads = good.where("kind = 'env_var'").join(names, "subject", "left_semi").select(F.concat(F.lit("env:"), "subject").alias("b"), F.lit("reads_env").alias("relation"), "file", "line")
    top = F.lower(F.regexp_replace(F.substring_index("subject", ".", 1), "[-_.]+", "_"))
    provided = listed.select(F.lower(F.regexp_replace("dist", "[-_.]+", "_")).alias("top"), F.concat(F.lit("dist:"), "lang", F.lit(":"), "dist").alias("b")).distinct()
    imports = good.where("kind = 'import'").withColumn("top", top).join(provided, "top").select("b", F.lit("imports").alias("relation"), "file", "line")
    uses = sized(reads.unionByName(imports).distinct(), "uses")
    owners = innermost(uses.select("file", "line").distinct().withColumnRenamed("line", "at"), symbols.select("file", F.col("line").alias("start"), "end", "name"), ["file"], "at", "start", "end", "name").withColumnRenamed("at", "line")
    uses = uses.join(owners, ["file", "line"], "left").select(F.coalesce(F.concat(F.lit("symbol:"), "file", F.lit(":"), "scope"), file("file")).alias("a"), "b", "relation", "file", "line")
    routes = index.routes.where("full is not null and not full like '?%'").select(F.concat(F.lit("route:"), "method", F.lit(" "), "full").alias("route"), "handler", "file").distinct()
    registers = routes.select(file("file").alias("a"), F.col("route").alias("b"), F.lit("registers_route").alias("relation"), "file", none.alias("line"))
    only = symbols.groupBy("file", F.col("name").alias("handler")).count().where("count = 1").drop("count")
    handled = routes.join(only, ["file", "handler"]).select(F.col("route").alias("a"), F.concat(F.lit("symbol:"), "file", F.lit(":"), "handler").alias("b"), F.lit("declared_handler").alias("relation"), "file", none.alias("line"))
    return union_all([declares, env, dists, uses, registers, handled]).distinct()


def kind_of(node: Column) -> Column:
    """A node's kind: what stands before its first colon."""
    return F.substring_index(node, ":", 1)


def roots_of(edges: DataFrame, refs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(ref, node): the nodes that each reference (ref) may mean: its whole name, its name without the kind, or its last part."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    if kinds:
        nodes = nodes.where(kind_of(F.col("node")).isin(*kinds))
    keys = F.array_distinct(F.array("node", F.expr("substring(node, locate(':', node) + 1)"), F.element_at(F.split("node", ":"), -1)))
    return nodes.select("node", F.explode(keys).alias("ref")).join(refs.select(F.trim("ref").alias("ref")).distinct(), "ref")


def around(edges: DataFrame, roots: DataFrame, hops: int, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hop) within 0 to 5 `hops` of the roots (node), and the edges that touch a node nearer than that.

    kinds: those of the roots and of the nodes that are given; the way between them may lead over others, and edges
    are given whatever they join.
    """
    if not 0 <= hops <= 5:
        raise ValueError("hops must be 0 to 5")
    wanted = kind_of(F.col("node")).isin(*kinds) if kinds else F.lit(True)
    near = neighbours(edges, roots.where(wanted), hops)
    inner = near.where(F.col("hop") < hops).select("node")
    touched = edges.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(edges.join(inner.withColumnRenamed("node", "b"), "b", "left_semi")).distinct()
    return near.where(wanted), touched


def notes_near(notes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes (file, ...) about the files in which the nodes (node) are located."""
    where = edges.select(F.col("a").alias("node"), "file").unionByName(edges.select(F.col("b").alias("node"), "file"))
    return notes.join(where.join(nodes, "node", "left_semi").select("file").distinct(), "file", "left_semi")


def close_matches(refs: DataFrame, nodes: DataFrame, limit: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(ref, rank, node, ratio): for each of a few references the most similar nodes by matching blocks, best first.

    refs: ref, at most 1000 (they go to every task); nodes: node.  Ties rank the greater name first.
    """
    import pyarrow as pa

    from ..runtime import ship

    asked = sorted({r["ref"] for r in refs.where("ref is not null").select("ref").distinct().limit(1001).collect()})
    if len(asked) > 1000:
        raise ValueError("at most 1000 references")
    ship(nodes.sparkSession)

    def run(batches):
        for batch in batches:
            found = []
            for node in batch.column("node").to_pylist():
                match = difflib.SequenceMatcher()
                match.set_seq1(node)
                for ref in asked:
                    match.set_seq2(ref)
                    if match.real_quick_ratio() >= cutoff and match.quick_ratio() >= cutoff and match.ratio() >= cutoff:
                        found.append((ref, node, match.ratio()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))], names=["ref", "node", "ratio"])

    from pyspark.sql import Window

    scored = nodes.where("node is not null").select("node").distinct().mapInArrow(run, "ref string, node string, ratio double")
    best = Window.partitionBy("ref").orderBy(F.desc("ratio"), F.desc("node"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("ref", "rank", "node", "ratio")
