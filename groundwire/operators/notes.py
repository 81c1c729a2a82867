"""Notes between stores: import, export pages, briefs and handoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SCRUB_RULES, content_id, scrub
from .relations import interleave, neighbours, recall

# Kinds of notes.
KINDS = ("decision", "convention", "task", "note", "gotcha", "howto", "command", "handoff", "preference", "todo")


def redactions(text: Column) -> Column:
    """Replacements that scrubbing makes, counted rule by rule; what a rule leaves as it was does not count."""
    def altered(pattern, replacement):
        return lambda x: F.regexp_replace(x, pattern, replacement) != x

    total = F.lit(0).cast("long")
    for _, pattern, replacement in SCRUB_RULES:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        total = total + F.size(F.filter(hits, altered(pattern, replacement))).cast("long")
        text = F.regexp_replace(text, pattern, replacement)
    return total


def import_notes(incoming: DataFrame, existing: DataFrame, prefix: str | None = None) -> DataFrame:
    """(record, id, title, text, kind, created, redactions, action, reason): what becomes of each incoming note.

    incoming: record, id, title, text, kind, created; existing: id.  action: skipped (with a reason), duplicate (the
    id came earlier among good records), kept_existing, or ready.  With a prefix, ids of another store are hashed
    under it.  Texts are scrubbed; nothing is written.
    """
    title, body = F.trim("title"), F.trim("text")
    source_ok = F.length("id").between(1, 200)
    final = content_id(F.col("id"), prefix=prefix, size=24) if prefix is not None else F.col("id")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    kind = F.coalesce("kind", F.lit("note"))
    reason = (
        F.when(no(source_ok), "id").when(no(F.length(title).between(1, 120)), "title").when(no(F.length(body).between(1, 4000)), "text").when(kind == "episode", "episode")
        .when(~kind.isin(*KINDS), "kind").when(~F.coalesce("created", F.lit(0)).between(0, 10**12), "created").when(no(final.rlike(r"^[a-zA-Z0-9_-]{1,80}$")), "destination id")
    )
    rows = incoming.select(
        "record", final.alias("id"), scrub(title).alias("title"), scrub(body).alias("text"), kind.alias("kind"), F.coalesce("created", F.lit(0)).cast("long").alias("created"), (redactions(title) + redactions(body)).alias("redactions"), reason.alias("reason")
    )
    good = Window.partitionBy("id").orderBy("record")
    nth = rows.where("reason is null").withColumn("nth", F.row_number().over(good)).join(existing.select("id").distinct().withColumn("there", F.lit(True)), "id", "left")
    action = F.when(F.col("nth") > 1, "duplicate").when(F.col("there"), "kept_existing").otherwise("ready")
    passed = nth.select(*rows.columns, action.alias("action"))
    return passed.unionByName(rows.where("reason is not null").withColumn("action", F.lit("skipped")))


def export_page(notes: DataFrame, limit: int, offset: int, budget: int, envelope: int = 0) -> DataFrame:
    """(place, id, json, has_more, next_offset): a page of scrubbed notes in order of id, as JSON with sorted keys.

    The page ends before the first note that would exceed four bytes a unit of the budget; none after it is taken,
    so that the next offset skips nothing.  notes: id, title, text, kind, created; `envelope` bytes are set aside.
    One page is at most `limit` notes, so its window is small.
    """
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("a page has 1 to 500 notes from an offset of 0 or more")
    rows = notes.orderBy("id").offset(offset).limit(limit + 1)
    note = F.to_json(F.struct(F.struct("created", "id", "kind", scrub(F.col("text")).alias("text"), scrub(F.col("title")).alias("title")).alias("note")))
    rows = rows.select("id", note.alias("json")).withColumn("place", F.row_number().over(Window.orderBy("id")).cast("long"))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.octet_length("json")).over(upto) + F.col("place") - 1 + envelope
    fits = rows.withColumn("fits", (size <= 4 * budget) & (F.col("place") <= limit)).withColumn("total", F.count("*").over(Window.partitionBy()))
    kept = fits.where("fits").withColumn("taken", F.count("*").over(Window.partitionBy()))
    return kept.select("place", "id", "json", (F.col("total") > F.col("taken")).alias("has_more"), (F.col("taken") + offset).alias("next_offset"))


def brief(words: list[str], notes: DataFrame, references: DataFrame, edges: DataFrame, limit: int = 8, hops: int = 3) -> DataFrame:
    """(place, side, name): the best notes for some words and the sources near given references, in turn.

    notes: id, title_words, body_words; references: node; edges: a, b.
    """
    asked = notes.sparkSession.createDataFrame([(0, words)], "query_id int, words array<string>")
    best = recall(asked, notes, limit).select(F.struct(F.col("rank").cast("long").alias("hop"), F.col("id").cast("string").alias("node")).alias("order"), F.col("id").cast("string").alias("name"))
    near = neighbours(edges, references, hops).select(F.struct(F.col("hop").cast("long").alias("hop"), F.col("node")).alias("order"), F.col("node").alias("name"))
    return interleave(best, near, "order", "name")


def handoff(drafts: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, action, state): whether a handoff note may be stored beside its checkpoint.

    drafts: id, anchors_valid; reports: id, state, before, after, fingerprints of the tree around the check.  An
    invalid anchor refuses the note; a tree that changed, or has no report, stores nothing.
    """
    rows = drafts.join(reports, "id", "left")
    same = F.coalesce(F.col("before") == F.col("after"), F.lit(False))
    action = F.when(~F.coalesce("anchors_valid", F.lit(False)), "refused").when(F.col("state").isNull(), "not_checked").when(~same, "changed").otherwise("stored")
    return rows.select("id", action.alias("action"), F.when(action == "stored", F.col("state")).alias("state"))


def beside_notes(notes: DataFrame, handoffs: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Notes (id, ...) with the checkpoint stored beside each (id, evidence, fingerprint), and current: whether the tree is still that one.

    fingerprint: one row, the fingerprint of the tree as it is.  Notes without a checkpoint have nulls in both columns.
    """
    held = handoffs.select("id", "evidence", F.col("fingerprint").alias("then"))
    now = fingerprint.select(F.col("fingerprint").alias("now"))  # one row
    rows = notes.join(held, "id", "left").crossJoin(F.broadcast(now))
    current = F.when(F.col("evidence").isNotNull(), F.col("then").eqNullSafe(F.col("now")))
    return rows.select(*notes.columns, "evidence", current.alias("current"))
