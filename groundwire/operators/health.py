"""Report on an index: what was declared, from where, and what cannot be proved for lack of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import sized
from ..sources.files import declared_dists, declared_env, python_facts
from .relations import union_all
from .routes import resolved_routes


def report(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(name, ok, detail) of a tree (path, text): ok is null where a line only informs.

    Lines: files, environment declarations by source, dependency sources, routes.  An empty tree gives all lines.
    """
    facts = sized(python_facts(files), "facts") if facts is None else facts

    def line(df, name, ok, detail):
        return df.select(F.lit(name).alias("name"), ok.alias("ok"), detail.alias("detail"))

    def told(what, name):
        n, first = F.col(f"{name}.n"), F.col(f"{name}.first")
        return F.when(n == 0, f"no {what}").otherwise(F.format_string(f"%d {what}, the first %s", n, first))

    unread = F.count_if(F.col("text").isNull())
    parsed = files.where("path like '%.py' and text is not null").select("path").join(facts.select("path").distinct().withColumn("has", F.lit(True)), "path", "left")
    held = files.agg(F.count("*").alias("n"), unread.alias("bad")).crossJoin(parsed.agg(F.count_if(F.col("has")).alias("facts")))  # one row each
    by = declared_env(files, facts).groupBy("source").agg(F.countDistinct("name").alias("n"))
    env = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "n"))), ", ").alias("by"))
    where = declared_dists(files).where("kind <> 'error'").select("file", "kind").distinct()
    several = lambda kind, name: F.struct(F.count_if(F.col("kind") == kind).alias("n"), F.min(F.when(F.col("kind") == kind, F.col("file"))).alias("first")).alias(name)
    deps = where.agg(F.count("*").alias("n"), several("lockfile", "locks"), several("manifest", "manifests"))
    routes = resolved_routes(files, facts).agg(F.count_if(F.col("method") != "?").alias("n"), F.count_if(F.col("full").isNull()).alias("open"))
    return union_all([
        line(held, "files", F.col("n") > 0, F.format_string("%d files, %d unreadable, %d Python files with facts", "n", "bad", "facts")),
        line(env, "environment", F.col("n") > 0, F.format_string("%d names: %s", "n", "by")),
        line(deps, "dependencies", F.col("n") > 0, F.concat_ws("; ", told("lockfiles", "locks"), told("manifests", "manifests"))),
        line(routes, "routes", F.lit(None).cast("boolean"), F.format_string("%d routes, %d unresolved", "n", "open")),
    ])
