"""Ranked recall of notes: an inverted index in blocks with upper bounds, whose first notes are exact.

A note's score is two points for each word of the query in its title and one for each in its text or its sources.
Notes are numbered in the order of their ids.  Postings stand in blocks of `BLOCK` consecutive notes, and for each word
and block the most points of a note are known.  A query adds these bounds up by block and reads the postings of its best
blocks alone, as many as it wants notes; then those blocks that could still hold a better note, which for rare words is
few and for common ones is none once the first notes have all their points.  Of equal notes the smaller id comes first, so
a block whose bound only equals the last kept score counts only if it lies before that note.

How many notes match at all comes from bitmaps of the notes of a block, two longs each, of the words that are asked for
alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..runtime import ordered, saved, spread

BLOCK = 128
#: Columns of the bitmap of a block, 64 notes each.
HALVES = ("low", "high")
#: The word that all notes have and blank queries ask for; no text has it.
ANY = ""
HIDDEN = ("stale", "invalid")


def postings(notes: DataFrame) -> DataFrame:
    """(term, block, place, points, and other columns) of notes (place, title, body, and others), the last two their distinct words."""
    in_title = F.transform("title", lambda w: F.struct(w.alias("term"), F.when(F.array_contains("body", w), 3).otherwise(2).alias("points")))
    in_body = F.transform(F.array_except("body", "title"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("points")))
    others = [x for x in notes.columns if x not in ("id", "place", "title", "body")]
    rows = notes.select("place", *others, F.explode(F.concat(in_title, in_body)).alias("p"))
    return rows.select("p.term", F.floor(F.col("place") / BLOCK).alias("block"), "place", "p.points", *others)


def of_asked(asked: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(asked.select("term").distinct(), "term", "left_semi")


def first_notes(asked: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """(query_id, place, score, rank) of the first `limit` notes of each query, from its words (query_id, term) and postings."""
    asked = saved(asked, "asked")
    rows = saved(of_asked(asked, rows.select("term", "block", "place", "points")), "asked_postings")
    bounds = rows.groupBy("term", "block").agg(F.max("points").alias("most"))
    blocks = saved(asked.join(bounds, "term").groupBy("query_id", "block").agg(F.sum("most").alias("bound")), "blocks")
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = saved(blocks.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit).drop("nth"), "first")

    def scored(chosen: DataFrame) -> DataFrame:
        mine = asked.join(chosen.select("query_id", "block"), "query_id")
        return mine.join(rows, ["term", "block"]).groupBy("query_id", "place").agg(F.sum("points").alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    held = saved(scored(first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit), "held")
    # the last kept note of a query that has enough of them is what others must beat
    bar = held.where(F.col("rank") == limit).select("query_id", F.col("score").alias("bar"), F.col("place").alias("last"))
    open_ = blocks.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(bar, "query_id", "left")
    open_ = open_.where(F.col("bar").isNull() | (F.col("bound") > F.col("bar")) | ((F.col("bound") == F.col("bar")) & (F.col("block") * BLOCK < F.col("last"))))
    more = scored(open_).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return held.drop("rank").unionByName(more.drop("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


class Notebook:
    """The index of notes (id, title, body, and where known locators, an array of their sources, and state).

    Null parts count as empty.  Notes of one id are to be one row.  Tables: numbered (place, id, hidden), postings (term,
    block, place, points, hidden) in the order of places, so that they are written as they come.
    """

    def __init__(self, notes: DataFrame):
        given = {"locators": F.array().cast("array<string>"), "state": F.lit("unverified")}
        notes = notes.where("id is not null").select("id", *(F.coalesce(x, F.lit("")).alias(x) for x in ("title", "body")), *(F.coalesce(F.col(x), y).alias(x) if x in notes.columns else y.alias(x) for x, y in given.items()))
        notes = ordered(notes.withColumn("hidden", F.col("state").isin(*HIDDEN)), ["id"], "place")
        self.numbered = saved(notes.select("place", "id", "hidden"), "numbered")
        in_body = terms(F.concat_ws(" ", "body", F.array_join("locators", " ")))
        self.postings = saved(postings(notes.select("place", "hidden", terms(F.col("title")).alias("title"), in_body.alias("body"))), "postings")

    def found(self) -> DataFrame:
        """The postings, and one of no points in each note of the word that all notes have."""
        every = self.numbered.select(F.lit(ANY).alias("term"), F.floor(F.col("place") / BLOCK).alias("block"), "place", F.lit(0).alias("points"), "hidden")
        return self.postings.unionByName(every)

    def recall(self, queries: DataFrame, limit: int = 8, include_hidden: bool = False) -> DataFrame:
        """(query_id, rank, id, score) of the first `limit` notes of each query (query_id, query).

        A blank query asks for all notes, in the order of their ids; one without a word finds none.  Stale and invalid
        notes are left out unless they are asked for.
        """
        if not 1 <= limit <= 500:
            raise ValueError("limit must be from 1 to 500")
        rows = self.found() if include_hidden else self.found().where("not hidden")
        found = first_notes(wanted(queries), rows, limit)
        return found.join(self.numbered.select("place", "id"), "place").select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.col("score").cast("long").alias("score"))

    def matches(self, queries: DataFrame, limit: int = 8, include_hidden: bool = False) -> DataFrame:
        """(query_id, matches, hidden_stale, limit_omitted): how many notes a query finds, how many more are stale or invalid, and how many the limit leaves out."""
        asked = saved(wanted(queries), "asked")
        # a bitmap is as long as a block and stands in two longs, which aggregates hold in place and need not sort; blocks are
        # dealt out, so that the words of a block and then its queries are put together where it lies
        bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
        rows = of_asked(asked, self.found()).select("term", "hidden", "block", *(F.when(F.floor(F.col("place") % BLOCK / 64) == k, bit).otherwise(0).alias(x) for k, x in enumerate(HALVES)))
        either = [F.bit_or(x).alias(x) for x in HALVES]
        bits = spread(rows, "block").groupBy("term", "hidden", "block").agg(*either)
        met = asked.join(bits, "term").groupBy("query_id", "hidden", "block").agg(*either)
        parts = met.select("query_id", "hidden", sum((F.bit_count(x) for x in HALVES), F.lit(0)).alias("n"))
        shown = F.lit(True) if include_hidden else ~F.col("hidden")
        found = parts.groupBy("query_id").agg(F.coalesce(F.sum(F.when(shown, F.col("n"))), F.lit(0)).alias("matches"), F.coalesce(F.sum(F.when(~shown, F.col("n"))), F.lit(0)).alias("hidden_stale"))
        n = F.coalesce("matches", F.lit(0)).cast("long")
        return queries.select("query_id").distinct().join(found, "query_id", "left").select("query_id", n.alias("matches"), F.coalesce("hidden_stale", F.lit(0)).cast("long").alias("hidden_stale"), F.greatest(n - limit, F.lit(0)).cast("long").alias("limit_omitted"))


def wanted(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, query): their distinct words, or all notes for a blank one."""
    query = F.coalesce("query", F.lit(""))
    return queries.select("query_id", F.explode(F.when(query.rlike(r"(?U)^\s*$"), F.array(F.lit(ANY))).otherwise(terms(query))).alias("term"))
