"""Joins, rankings and set operations over claims, declarations, notes and change logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_tokens
from ..runtime import ordered, spread


def check_references(claims: DataFrame, declared: DataFrame, name: str, source: str) -> DataFrame:
    """Claims with the first declaring source, or null: a semi/anti join that tells both sides."""
    first = declared.groupBy(name).agg(F.min(source).alias("declared_in"))
    return claims.join(first, name, "left")


def did_you_mean(names: DataFrame, candidates: DataFrame, name: str, candidate: str, limit: int = 3, within: list[str] | None = None) -> DataFrame:
    """Up to `limit` candidates for each distinct name, ranked by (distance - shared tokens, distance, candidate).

    A candidate counts within 3 edits (4 from 16 letters on) or with two shared tokens, or all of either side's.
    Pairs come from equi joins, not from a cross join: on whole token sets of one token, on pairs of tokens, on the token
    that is all of one side, and on pieces, of which two names within four edits share one.  within: columns of both
    sides that must be equal, such as the pool that a name may be taken from.  Tokens, pairs and pieces are many times their
    names, which a plan's sizes do not show, so they are merged and never sent whole to the driver.
    """
    by = within or []
    n = names.select(*by, F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct().withColumn("name_tokens", F.array_sort(name_tokens(F.col("name"))))
    c = candidates.select(*by, F.col(candidate).alias("candidate")).where(F.col(candidate).isNotNull()).distinct().withColumn("cand_tokens", F.array_sort(name_tokens(F.col("candidate"))))
    if by:  # only pools that are asked for
        c = c.join(n.select(*by).distinct(), by, "left_semi")
    cap = F.when(F.length("name") >= 16, 4).otherwise(3)

    def twos(tokens):
        return F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))

    def keyed(df, who, keys):
        return df.select(*by, who, F.explode(keys).alias("key"))

    # two shared tokens; or one side has one token only, and the other has it too
    pairs = keyed(n, "name", twos(F.col("name_tokens"))).join(keyed(c, "candidate", twos(F.col("cand_tokens"))).hint("merge"), [*by, "key"]).select(*by, "name", "candidate")
    for one, other in ((n, c), (c, n)):
        who, them = ("name", "candidate") if one is n else ("candidate", "name")
        single = one.where(F.size(f"{who[:4]}_tokens") == 1).select(*by, who, F.col(f"{who[:4]}_tokens")[0].alias("key"))
        pairs = pairs.unionByName(single.join(other.select(*by, them, F.explode(f"{them[:4]}_tokens").alias("key")).hint("merge"), [*by, "key"]).select(*by, "name", "candidate"))
    # a name gives some hundred pieces, so names are dealt out before
    pairs = pairs.unionByName(_pieces(spread(n), "name", True, by=by).join(_pieces(c, "candidate", False, by=by).hint("merge"), [*by, "size", "place", "key"]).select(*by, "name", "candidate"))
    pairs = pairs.distinct().where(F.col("name") != F.col("candidate"))
    pairs = pairs.withColumns({"name_tokens": name_tokens(F.col("name")), "cand_tokens": name_tokens(F.col("candidate"))})
    distance = F.least(F.levenshtein(F.lower("name"), F.lower("candidate")), cap + 1)
    overlap = F.size(F.array_intersect("name_tokens", "cand_tokens"))
    scored = pairs.select(*by, "name", "candidate", distance.alias("d"), overlap.alias("o"), cap.alias("cap"), F.size("name_tokens").alias("nt"), F.size("cand_tokens").alias("ct"))
    near = scored.where((F.col("d") <= F.col("cap")) | (F.col("o") >= 2) | ((F.col("nt") > 0) & (F.col("o") == F.col("nt"))) | ((F.col("ct") > 0) & (F.col("o") == F.col("ct"))))
    best = Window.partitionBy(*by, "name").orderBy(F.col("d") - F.col("o"), "d", "candidate")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(*by, "name", "rank", "candidate", F.col("d").alias("distance"), F.col("o").alias("overlap"))


def _pieces(df: DataFrame, column: str, probe: bool, edits: int = 4, by: list[str] = ()) -> DataFrame:
    """Pigeonhole pieces: a name cut in edits + 1 parts keeps one part whole under that many edits.

    A candidate of length L gives its parts; a name looks for each part at places moved by up to `edits`,
    for every length that may match.
    """
    low = F.lower(F.col(column))
    parts = edits + 1
    if not probe:
        cut = F.expr(f"transform(sequence(0, {edits}), i -> struct(i as place, substring(lower({column}), 1 + (i * length({column})) div {parts}, ((i + 1) * length({column})) div {parts} - (i * length({column})) div {parts}) as key))")
        return df.select(*by, column, F.length(low).alias("size"), F.explode(cut).alias("x")).select(*by, column, "size", F.col("x.place").alias("place"), F.col("x.key").alias("key"))
    sizes = F.expr(f"sequence(greatest(0, length({column}) - {edits}), length({column}) + {edits})")
    rows = df.select(*by, column, F.explode(sizes).alias("size")).select(*by, column, "size", F.explode(F.expr(f"sequence(0, {edits})")).alias("place"))
    begin, width = f"(place * size) div {parts}", f"((place + 1) * size) div {parts} - (place * size) div {parts}"
    moved = f"filter(sequence({begin} - {edits}, {begin} + {edits}), p -> p >= 0 and p + {width} <= length({column}))"
    keys = F.expr(f"array_distinct(transform({moved}, p -> substring(lower({column}), p + 1, cast({width} as int))))")
    return rows.select(*by, column, "size", "place", F.explode(keys).alias("key"))


def latest_ops(changes: DataFrame, since: int, limit: int, seq: str = "seq", node: str = "node", op: str = "op") -> DataFrame:
    """Last operation of each node among the first `limit` changes after `since`."""
    page = changes.where(F.col(seq) > since).orderBy(seq).limit(limit)
    return page.groupBy(node).agg(F.max_by(op, seq).alias("op"), F.max(seq).alias("last_seq"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op): added, removed or changed, null-safe."""
    b, a = before.select(key, F.col(value).alias("old"), F.lit(True).alias("was")), after.select(key, F.col(value).alias("new"), F.lit(True).alias("now"))
    op = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return b.join(a, key, "full").select(key, op.alias("op")).where("op is not null")


def innermost(points: DataFrame, spans: DataFrame, group: list[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """Smallest span around each point of its group; ties by name.

    A span stands in the one or two cells that it touches of a grid as wide as the next power of two above its length,
    and a point looks into its own cell of every such grid, so points meet spans of about the size that may hold them.
    """
    length = F.col(end) - F.col(start) + 1
    level = F.greatest(F.ceil(F.log2(length.cast("double"))), F.lit(0)).cast("int")
    held = spans.where(length > 0).withColumn("__level", level)
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    held = held.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col(start)), cell(F.col(end))))))
    levels = held.select(*group, "__level").distinct()
    asked = points.join(levels, group).withColumn("__cell", cell(F.col(at)))
    inside = asked.join(held, [*group, "__level", "__cell"]).where(F.col(at).between(F.col(start), F.col(end)))
    return inside.groupBy(*points.columns).agg(F.min_by(name, F.struct((F.col(end) - F.col(start)), F.col(name))).alias("scope"))


def first_positions(lists: DataFrame, group: list[str], item: str, order: list[str], limit: int) -> DataFrame:
    """(group, rank, item): the distinct items of several lists as they first come, `limit` of each group.

    order: columns that place a row, such as the number of its list and its place there.  Repeats go by a partial
    aggregate, and of each group only the first rows are ordered.
    """
    once = lists.where(F.col(item).isNotNull()).groupBy(*group, item).agg(F.min(F.struct(*order)).alias("__first"))
    best = Window.partitionBy(*group).orderBy("__first", item)
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(*group, "rank", item)


def neighbours(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(node, hop) within `hops` undirected steps of the roots (node); a bounded breadth-first search."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
    seen = roots.select("node").distinct().withColumn("hop", F.lit(0))
    edge_of = seen
    for hop in range(1, hops + 1):
        step = edge_of.join(both, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        seen, edge_of = seen.union(step), step
    return seen


def resolve(nodes: DataFrame, ref: str) -> DataFrame:
    """Nodes (id, name) that a reference may mean, with resolved / ambiguous / not_found."""
    hit = nodes.where((F.col("id") == ref) | (F.col("name") == ref) | (F.element_at(F.split("id", ":"), -1) == ref))
    n = hit.agg(F.count("*").alias("n"))
    return n.select(F.lit(ref).alias("ref"), F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.col("n").cast("long").alias("matches"))


def recall(queries: DataFrame, notes: DataFrame, limit: int) -> DataFrame:
    """Best `limit` notes of each query: two points a query word in the title, one in the body; ties by id.

    queries: query_id, words; notes: id, title_words, body_words.  An inverted index, joined on words; the words that are
    asked for are dealt out by note, so that each task adds up the points of its own few notes.
    """
    asked = queries.select("query_id", F.explode("words").alias("word"))
    index = notes.select("id", F.explode("title_words").alias("word"), F.lit(2).alias("points")).union(notes.select("id", F.explode("body_words").alias("word"), F.lit(1).alias("points")))
    index = spread(index.join(asked.select("word").distinct(), "word", "left_semi"), "id")
    scored = asked.join(index, "word").groupBy("query_id", "id").agg(F.sum("points").cast("long").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def bounded(items: DataFrame, group: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Greedy choice under a byte budget, with skips: an item too large is left, later ones may still fit."""
    held = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("xs"))
    fold = F.aggregate("xs", F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken")), lambda a, x: F.when(a.used + x[size] <= budget, F.struct((a.used + x[size]).alias("used"), (a.taken + 1).alias("taken"))).otherwise(a))
    return held.select(*group, fold.alias("f"), F.size("xs").cast("long").alias("n")).select(*group, F.col("f.used").alias("used"), F.col("f.taken").alias("taken"), (F.col("n") - F.col("f.taken")).alias("omitted"))


def page(df: DataFrame, order: str, size: int, offset: int) -> DataFrame:
    """One page with has_more."""
    rows = df.orderBy(order).offset(offset).limit(size + 1)
    numbered = rows.withColumns({"rn": F.row_number().over(Window.orderBy(order)), "n": F.count("*").over(Window.partitionBy())})
    return numbered.where(F.col("rn") <= size).withColumn("has_more", F.col("n") > size).drop("rn", "n")


def interleave(left: DataFrame, right: DataFrame, order: str, name: str) -> DataFrame:
    """Rows of both sides in turn: place, side, name.

    A row's place follows from its place on its own side and the size of the other one, so that no task orders all rows.
    """
    def side(df, other, k):
        n = other.agg(F.count("*").alias("others"))  # one row
        own = ordered(df.select(F.col(order).alias("order"), F.col(name).alias("name")), ["order"], "nth").crossJoin(F.broadcast(n))
        return own.select((F.col("nth") + F.least(F.col("nth") - 1 + k, F.col("others"))).cast("long").alias("place"), F.lit(k).alias("side"), "name")

    return side(left, right, 0).union(side(right, left, 1))


def hash_sample(df: DataFrame, group: str, key: str, seed: str, n: int) -> DataFrame:
    """`n` rows of each group, by the SHA-256 of seed and key."""
    order = Window.partitionBy(group).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def stable_hash(parts: Column) -> Column:
    """SHA-256 of the sorted, line-joined strings of an array column."""
    return F.sha2(F.array_join(F.array_sort(parts), "\n"), 256)
