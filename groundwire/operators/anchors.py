"""Anchors tie a note to what it cites: made against an index, checked against a later one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.text import scrub, top_level
from ..runtime import sized
from ..sources.files import region_lines
from .notes import redactions
from .relations import union_all
from .routes import check_route_claims, norm_path

# Kinds of anchors.
ANCHOR_KINDS = ("file", "env", "route", "import", "symbol")


def _state(level: Column) -> Column:
    return F.when(level == "accept", "valid").when(level == "reject", "invalid").otherwise("unverifiable")


def resolve_anchors(cited: DataFrame, index) -> DataFrame:
    """(kind, value, node, state, content_hash) of the distinct citations (kind, value), by an index (`change.Index`).

    A hash covers what the citation rests on: a file's text, a name's declarations, a symbol's lines, a route with
    its handler, or all distributions; it is null where the state is not valid.
    """
    c = cited.where("value is not null").select("kind", F.trim("value").alias("value")).distinct()
    of = lambda kind: c.where(F.col("kind") == kind).select("value")
    sha = lambda x: F.sha2(x, 256)

    path = F.regexp_replace("value", r"^(\./)+", "")
    files = of("file").withColumn("path", path).join(index.tree.select("path", sha(F.coalesce("text", F.lit(""))).alias("h")), "path", "left")
    outside = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    files = files.select(F.lit("file").alias("kind"), "value", F.concat(F.lit("file:"), "path").alias("node"), F.when(outside, "unverifiable").when(F.col("h").isNull(), "invalid").otherwise("valid").alias("state"), "h")

    declared = index.env.groupBy(F.col("name").alias("value")).agg(sha(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "file", "source"))), "\n")).alias("h"))
    env = index.environment(of("env").select(F.col("value").alias("subject"), F.lit(False).alias("dynamic"), F.lit(False).alias("has_default"))).select(F.col("subject").alias("value"), _state(F.col("level")).alias("state"))
    env = env.join(declared, "value", "left").select(F.lit("env").alias("kind"), "value", F.concat(F.lit("env:"), "value").alias("node"), "state", "h")

    contract = index.dists.where("kind <> 'error'").groupBy(F.lit(1)).agg(sha(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "lang", "dist", "file"))), "\n")).alias("h")).select("h")
    imports = index.imports(of("import").select(F.lit("").alias("file"), F.col("value").alias("subject"), F.lit(False).alias("optional"))).groupBy(F.col("subject").alias("value")).agg(F.first("level").alias("level"))
    imports = imports.join(F.broadcast(contract), F.lit(True), "left").select(F.lit("import").alias("kind"), "value", F.concat(F.lit("dist:python:"), top_level(F.col("value"))).alias("node"), _state(F.col("level")).alias("state"), "h")

    file, name = F.regexp_extract("value", r"^(.+):([^:]+)$", 1), F.regexp_extract("value", r"^(.+):([^:]+)$", 2)
    spans = index.facts.where("tag = 'symbol'").select(F.col("path").alias("file"), "name", "line", F.col("extra").cast("long").alias("end"))
    wanted = of("symbol").select("value", file.alias("file"), name.alias("name")).join(spans, ["file", "name"], "left")
    text = wanted.where("line is not null").join(region_lines(index.tree), "file").where("lineno between line and end").groupBy("value").agg(F.array_sort(F.collect_list(F.struct("line", "lineno", "text"))).alias("x"))
    hashed = text.select("value", sha(F.array_join("x.text", "\n")).alias("h"))
    there = wanted.groupBy("value", "file").agg(F.max("line").alias("line")).join(hashed, "value", "left")
    symbols = there.select(F.lit("symbol").alias("kind"), "value", F.concat(F.lit("symbol:"), "value").alias("node"), F.when(F.col("file") == "", "unverifiable").when(F.col("line").isNull(), "invalid").otherwise("valid").alias("state"), "h")

    method, rest = F.upper(F.substring_index("value", " ", 1)), F.regexp_replace("value", r"^\S+\s*", "")
    node = F.concat(F.lit("route:"), method, F.lit(" "), norm_path(rest))
    graded = check_route_claims(of("route").select(F.col("value").alias("subject"), F.lit(None).cast("string").alias("handler")), index.routes).select(F.col("subject").alias("value"), _state(F.col("level")).alias("state"))
    held = index.routes.where("full is not null").groupBy(F.concat(F.lit("route:"), "method", F.lit(" "), norm_path(F.col("full"))).alias("node")).agg(sha(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "full", "handler", "file"))), "\n")).alias("h"))
    routes = graded.withColumn("node", node).join(held, "node", "left").select(F.lit("route").alias("kind"), "value", "node", "state", "h")

    other = c.where(~F.col("kind").isin(*ANCHOR_KINDS)).select("kind", "value", F.lit(None).cast("string").alias("node"), F.lit("unverifiable").alias("state"), F.lit(None).cast("string").alias("h"))
    rows = sized(union_all([files, env, imports, symbols, routes, other]), "anchors")
    return rows.select("kind", "value", "node", "state", F.when(F.col("state") == "valid", F.col("h")).alias("content_hash"))


def anchors(declared: DataFrame, prose: DataFrame, index) -> DataFrame:
    """Anchors of notes: all that they declare, and what their prose names besides if it is valid now.

    declared, prose: id, kind, value.
    """
    both = declared.select("id", "kind", "value", F.lit(True).alias("declared")).distinct()
    guessed = prose.select("id", "kind", "value").distinct().join(both, ["id", "kind", "value"], "left_anti").withColumn("declared", F.lit(False))
    every = both.unionByName(guessed)
    return every.join(resolve_anchors(every.select("kind", "value"), index), ["kind", "value"]).where("declared or state = 'valid'").select("id", "kind", "value", "declared", "node", "state", "content_hash")


def check_anchors(stored: DataFrame, index) -> DataFrame:
    """(id, kind, value, node, state) of stored anchors (id, kind, value, content_hash) now: one whose hash differs, or has none, is stale."""
    now = resolve_anchors(stored.select("kind", "value"), index).withColumnRenamed("content_hash", "now")
    state = F.when((F.col("state") == "valid") & ~(F.col("now") == F.coalesce("content_hash", F.lit(""))), "stale").otherwise(F.col("state"))
    return stored.select("id", "kind", "value", "content_hash").join(now, ["kind", "value"]).select("id", "kind", "value", "node", state.alias("state"))


def note_states(notes: DataFrame, checked: DataFrame) -> DataFrame:
    """(id, state): unverified without anchors, anchored if all are valid, else invalid or stale."""
    by = checked.groupBy("id").agg(ladders.anchor_summary(F.col("state")).alias("summary"))
    state = F.when(F.col("summary").isNull(), "unverified").when(F.col("summary") == "valid", "anchored").otherwise(F.col("summary"))
    return notes.select("id").distinct().join(by, "id", "left").select("id", state.alias("state"))


def note_id(title: Column, text: Column, kind: Column, files: Column) -> Column:
    """20 hex digits of the SHA-256 of the JSON list of title, text, kind and sorted files."""
    head = F.to_json(F.array(title, text, kind))
    return F.left(F.sha2(F.concat(F.left(head, F.length(head) - 1), F.lit(","), F.to_json(F.array_sort(files)), F.lit("]")), 256), F.lit(20))


def remember(drafts: DataFrame, index) -> tuple[DataFrame, DataFrame]:
    """Notes to be stored and their anchors.

    drafts: title, text, kind, created, files (array).  Texts are scrubbed first.  A draft that cites a file which is
    not there is refused (stored is false) and has no anchors; of equal drafts one is kept.
    """
    title, text, files = scrub(F.trim("title")), scrub(F.trim("text")), F.coalesce("files", F.array().cast("array<string>"))
    rows = drafts.select(title.alias("title"), text.alias("text"), "kind", "created", files.alias("files"), (redactions(F.trim("title")) + redactions(F.trim("text"))).alias("redactions"))
    rows = rows.withColumn("id", note_id(F.col("title"), F.col("text"), F.col("kind"), F.col("files"))).groupBy("id", "title", "text", "kind", "files").agg(F.max("created").alias("created"), F.max("redactions").alias("redactions"))
    cited = rows.select("id", F.lit("file").alias("kind"), F.explode("files").alias("value"))
    made = anchors(cited, cited.limit(0), index)
    bad = made.groupBy("id").agg(F.bool_or(F.col("state") == "invalid").alias("bad"))
    rows = rows.join(bad, "id", "left").withColumn("stored", ~F.coalesce("bad", F.lit(False))).drop("bad")
    return rows, made.join(rows.where("stored").select("id"), "id", "left_semi")


def upserted(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Stored notes with new ones in the place of those of the same id; a note keeps when it was first created."""
    first = notes.select("id", F.col("created").alias("was"))
    new = new.join(first, "id", "left").withColumn("created", F.coalesce("was", "created")).drop("was").select(*notes.columns)
    return notes.join(new, "id", "left_anti").unionByName(new)


def forget(notes: DataFrame, handoffs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and handoffs (note_id) without those of the given ids (id)."""
    return notes.join(ids, "id", "left_anti"), handoffs.join(ids.withColumnRenamed("id", "note_id"), "note_id", "left_anti")
