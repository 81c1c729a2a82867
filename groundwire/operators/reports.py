"""What an index holds and what a check found, as tables to be shown: declarations, audits, annotations, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escaped
from .relations import union_all

#: Sources that are named for one entry; how many there are is told beside them.
NAMED = 20
APP_FILES = ("main.py", "app.py")


def _with_sources(rows: DataFrame, by: list[str], source: str, most: int) -> DataFrame:
    """(by, n, sources): how many distinct sources an entry has, and the first of them in order."""
    once = rows.select(*by, F.col(source).alias("source")).distinct()
    counted = once.groupBy(*by).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("source")
    first = once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return counted.join(first, by)


def declared_where(env: DataFrame, most: int = NAMED) -> DataFrame:
    """(name, n, sources): files that declare each name of the environment."""
    return _with_sources(env, ["name"], "file", most)


def listed_where(dists: DataFrame, most: int = NAMED) -> DataFrame:
    """(lang, dist, n, sources): manifests and lockfiles that list each distribution."""
    return _with_sources(dists.where("kind <> 'error' and dist <> ''"), ["lang", "dist"], "file", most)


def audit(findings: DataFrame) -> DataFrame:
    """(oracle, findings, accept, review, reject, unverifiable, files): distinct findings of each oracle by level, and files with a reject."""
    f = findings.distinct()
    levels = {x: F.count_if(F.col("level") == x).alias(x) for x in ("accept", "review", "reject", "unverifiable")}
    bad = f.where("level = 'reject'").select("oracle", "file").distinct().groupBy("oracle").agg(F.count("*").alias("files"))
    return f.groupBy("oracle").agg(F.count("*").alias("findings"), *levels.values()).join(bad, "oracle", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def _property(text: Column) -> Column:
    return F.replace(F.replace(escaped(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def annotations(findings: DataFrame, title: str = "groundwire") -> DataFrame:
    """(value): a workflow command for each finding that is not accepted, which a CI system shows beside its line."""
    kind = F.create_map(*(F.lit(x) for x in ("reject", "error", "review", "warning", "unverifiable", "notice")))[F.col("level")]
    where = F.concat(F.lit("file="), _property(F.col("file")), F.lit(",line="), F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)))
    said = escaped(F.concat_ws(": ", F.concat_ws(" ", "kind", "ref"), "reason"))
    shown = findings.where(kind.isNotNull())
    return shown.select(F.concat(F.lit("::"), kind, F.lit(" "), where, F.lit(f",title={title} "), _property(F.col("oracle")), F.lit("::"), said).alias("value"))


def status(store, manifest: dict | None = None) -> DataFrame:
    """(table, version, buckets, rows) of an index that is kept (`store.Store`)."""
    manifest = manifest or store.manifest()
    tables = [store.read(name, manifest=manifest).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(manifest["version"]).cast("long").alias("version"), F.lit(len(held["buckets"])).alias("buckets"), "rows") for name, held in sorted(manifest["tables"].items())]
    return union_all(tables) if tables else store.spark.createDataFrame([], "table string, version long, buckets int, rows long")


def find_apps(facts: DataFrame, by: Column) -> DataFrame:
    """(by, app): `module:variable` of the application of each group of files: in a main or app file first, then by path, line and name."""
    apps = facts.where("tag = 'router' and extra = 'app'").withColumn("by", by)
    base = F.element_at(F.split("path", "/"), -1)
    first = F.struct((~base.isin(*APP_FILES)).alias("other"), "path", "line", "name")
    best = apps.groupBy("by").agg(F.min(first).alias("x"))
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("x.path", r"^(src|lib)/", ""), r"(/__init__)?\.py$", ""), "/", ".")
    return best.select("by", F.concat(module, F.lit(":"), "x.name").alias("app"))
