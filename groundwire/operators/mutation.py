"""A seeded run of broken references: accepted names are misspelt, checked again, and what was caught is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_norm, top_level
from ..runtime import sized
from ..sources.files import region_lines
from .change import CODE, Index, check_change, suggestions
from .extract import env_reads
from .index import select_files
from .relations import hash_sample

IDENTIFIER, PACKAGE = r"^[A-Za-z_][A-Za-z0-9_]*$", r"^[a-z0-9][a-z0-9._-]*$"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Spellings that are drawn before a letter is appended instead.
DRAWS = 20
#: A call may span lines: the name is looked for on the line of its finding and so many after it.
LINES_AHEAD = 7


def typo(name: Column, key: Column) -> Column:
    """The name with one letter doubled, exchanged, replaced or (from four letters on) dropped, drawn by a hash of the key.

    The result is another name of the same form, an identifier or the name of a package.
    """
    form = F.when(name.rlike(IDENTIFIER), F.lit(IDENTIFIER)).otherwise(F.lit(PACKAGE))

    def draw(i):
        def number(salt, below):
            return F.pmod(F.xxhash64(key, i, F.lit(salt)), below).cast("int")

        size = F.length(name)
        at = number("place", size) + 1
        here, after, rest = name.substr(at, F.lit(1)), name.substr(at + 1, F.lit(1)), name.substr(at + 1, size)
        before, letter = name.substr(F.lit(1), at - 1), F.lit(LETTERS).substr(number("letter", F.lit(26)) + 1, F.lit(1))
        letter = F.when(here.rlike("[A-Z]"), F.upper(letter)).otherwise(letter)
        kind = number("kind", F.when(size > 3, 4).otherwise(3))
        swapped = F.concat(before, after, here, name.substr(at + 2, size))
        return F.when(kind == 0, F.concat(before, here, here, rest)).when(kind == 1, swapped).when(kind == 2, F.concat(before, letter, rest)).otherwise(F.concat(before, rest))

    drawn = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), draw)
    good = F.filter(drawn, lambda x: (x != name) & F.rlike(x, form))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.concat(name, F.lit("x")))


def struck(text: Column, oracle: Column, name: Column, other: Column) -> Column:
    """The line with the first occurrence of a name replaced, or null where it has none.

    Names of the environment and of imports stand in quotes first; handlers and routers are never looked for in a string.
    """
    quoted = lambda end: (r"(?<=[\"'])", rf"(?=[\"'{end}])")
    env, imported = oracle == "env_vars", oracle == "imports_lockfile"
    forms = (
        (env, *quoted("")), (env, r"(?<=\.)", r"(?!\w)"), (env, r"(?<!\w)", r"(?!\w)"),
        (imported, *quoted("/")), (imported, r"(?<![\w.])", r"(?!\w)"),
        (~env & ~imported, r"(?<![\w./'\"])", r"(?![\w'\"])"),
    )
    tries = []
    for when, before, after in forms:
        pattern = F.concat(F.lit(rf"^(.*?){before}\Q"), name, F.lit(rf"\E{after}"))
        tries.append(F.when(when & F.rlike(text, pattern), F.regexp_replace(text, pattern, F.concat(F.lit("$1"), other))))
    return F.coalesce(*tries)


def candidates(lines: DataFrame, tree: DataFrame, index: Index) -> DataFrame:
    """(oracle, kind, file, line, name): accepted references whose misspelling would break something.

    Left out are reads with a fallback, optional imports, modules that come under another name or within a longer path,
    routes that a decorator defines, and handlers and routers that are parts of another object.
    """
    good = sized(check_change(lines, tree, index).where("level = 'accept'"), "accepted")
    fallback = index.facts.where("tag = 'env' and extra = 'default'").select(F.col("path").alias("file"), "line", F.col("name").alias("ref"))
    fallback = fallback.unionByName(env_reads(lines.where(F.col("file").rlike(CODE))).where("has_default").select("file", F.col("lineno").cast("long").alias("line"), F.col("name").alias("ref")))
    optional = index.facts.where("tag = 'import' and extra = 'optional'").select(F.col("path").alias("file"), F.col("name").alias("ref"))
    env = good.where("oracle = 'env_vars' and reason = 'declared'").join(fallback.distinct(), ["file", "line", "ref"], "left_anti").withColumn("name", F.col("ref"))
    imported = good.where("oracle = 'imports_lockfile' and reason = 'provided'").join(optional.distinct(), ["file", "ref"], "left_anti").withColumn("name", F.when(F.col("ref").startswith("@") | F.col("ref").contains("/"), None).otherwise(top_level(F.col("ref"))))
    dotted = index.facts.where("tag in ('edge', 'include') and value like '%.%'").select(F.col("path").alias("file"), "line", F.substring_index("value", ".", 1).alias("ref"))
    routed = good.where("oracle = 'routes' and reason in ('bound in this file', 'bound in its module')").join(dotted.distinct(), ["file", "line", "ref"], "left_anti").withColumn("name", F.col("ref"))
    columns = ["oracle", "kind", "file", "line", "name"]
    rows = env.select(*columns).unionByName(imported.select(*columns)).unionByName(routed.select(*columns))
    return rows.where(F.col("name").rlike(IDENTIFIER) | ((F.col("oracle") == "imports_lockfile") & F.col("name").rlike(PACKAGE))).dropDuplicates(["oracle", "file", "line", "name"])


def mutations(tree: DataFrame, seed: int = 13, count: int = 5, index: Index | None = None) -> DataFrame:
    """(oracle, kind, file, line, name, mutated, struck, detected, blocked, suggested): `count` references an oracle, each misspelt.

    Every misspelling is checked in a copy of its file, beside the file, all copies as one change; the tree stays as it is.
    detected: reviewed or rejected; blocked: rejected; suggested: rejected, with the right name among the suggestions.
    A name that is not found near its line is not struck, and so not detected.  The draw depends on seed and reference alone.
    """
    index = index or Index(tree)
    lines = region_lines(select_files(tree).select("path", "text"))
    rows = candidates(lines, tree, index).withColumn("key", F.sha2(F.concat_ws("\0", "oracle", "file", F.col("line").cast("string"), "name"), 256))
    chosen = hash_sample(rows, "oracle", "key", str(seed), count)
    drawn = chosen.withColumn("mutated", typo(F.col("name"), F.concat(F.lit(f"{seed} "), F.col("key"))))
    copy = F.regexp_replace("file", F.lit(r"(\.[^./]+)$"), F.concat(F.lit("__"), F.substring("key", 1, 16), F.lit("$1")))
    chosen = sized(drawn.withColumn("copy", copy), "mutations")

    # at most `count` an oracle are chosen, so few files are copied, whatever the size of the tree
    held = chosen.join(lines.select("file", F.col("lineno").cast("long").alias("lineno"), "text"), "file")
    near = F.col("lineno").between(F.col("line"), F.col("line") + LINES_AHEAD)
    changed = F.when(near, struck(F.col("text"), F.col("oracle"), F.col("name"), F.col("mutated")))
    held = sized(held.withColumn("changed", changed), "copies")
    at = held.where("changed is not null").groupBy("key").agg(F.min("lineno").alias("at"))
    copies = held.join(at, "key").select(F.col("copy").alias("file"), "lineno", F.when(F.col("lineno") == F.col("at"), F.col("changed")).otherwise(F.col("text")).alias("text"))
    checked = sized(check_change(copies, tree, index).where("level in ('review', 'reject')").withColumnsRenamed({"file": "copy", "line": "found_at"}), "checked")

    name = lambda x: (F.col("ref") == x) | F.col("ref").startswith(F.concat(x, F.lit("."))) | F.col("ref").startswith(F.concat(x, F.lit("/")))
    related = sized(chosen.join(checked.select("copy", "oracle", "kind", "ref", "level"), ["copy", "oracle", "kind"]).where(name(F.col("mutated"))), "related")
    wanted = related.where("level = 'reject'")
    near_names = suggestions(wanted.select("kind", "ref", "file", "level"), index).select("kind", "ref", "file", "candidate")
    right = wanted.join(near_names, ["kind", "ref", "file"]).where(module_norm(F.col("candidate")) == module_norm(F.col("name"))).select("key", F.lit(True).alias("suggested")).distinct()
    caught = related.groupBy("key").agg(F.lit(True).alias("detected"), F.bool_or(F.col("level") == "reject").alias("blocked"))
    out = chosen.join(at.select("key", F.lit(True).alias("struck")), "key", "left").join(caught, "key", "left").join(right, "key", "left")
    flags = (F.coalesce(F.col(x), F.lit(False)).alias(x) for x in ("struck", "detected", "blocked", "suggested"))
    return out.select("oracle", "kind", "file", "line", "name", "mutated", *flags)


def tally(run: DataFrame) -> DataFrame:
    """(oracle, total, detected, blocked, suggested, misses) of a run."""
    counts = (F.count_if(x).cast("long").alias(x) for x in ("detected", "blocked", "suggested"))
    return run.groupBy("oracle").agg(F.count("*").cast("long").alias("total"), *counts, F.count_if(~F.col("detected")).cast("long").alias("misses"))
