"""An index that is kept: a synchronisation reads the files that changed and replaces what they said, in one commit."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import saved
from ..sources.files import MANIFEST, declared_dists, declared_env, python_facts
from ..sources.projects import own_names, project_facts
from .change import Index
from .index import sync_changes, head_seq, record_changes, snapshot
from .routes import resolved_routes
from .store import Store, retried

#: Raised when the tables of an index change their meaning; an older index is then built anew.
VERSION = "1"
#: Tables by file, with the column that holds the file.
BY_FILE = {"files": "path", "facts": "path", "env": "file", "dists": "file", "projects": "file"}


def digests(tree: DataFrame) -> DataFrame:
    """(path, digest) of a tree (path, text); a text that could not be read has the digest of an empty one."""
    return tree.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def facts_by_content(tree: DataFrame, known: DataFrame | None = None, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`python_facts` of a tree (path, text, digest), and the digests that were parsed: equal texts once, known ones never.

    known: digests of texts that have been parsed before; facts: what they said, by digest.
    """
    py = tree.where("path like '%.py' and text is not null")
    columns = ("line", "tag", "name", "value", "extra")
    fresh = py if known is None else py.join(known, "digest", "left_anti")
    once = fresh.select("digest", "text").dropDuplicates(["digest"])
    said = python_facts(once.select(F.concat("digest", F.lit(".py")).alias("path"), "text")).select(F.regexp_replace("path", r"\.py$", "").alias("digest"), *columns)
    found = said if facts is None else said.unionByName(facts.select("digest", *columns))
    return py.select("path", "digest").join(found, "digest").select("path", *columns), fresh.select("digest").distinct()


def _said(tree: DataFrame, known: tuple, configured: tuple[str, ...]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables by file of some files (path, text, digest), and the digests that were parsed."""
    facts, parsed = facts_by_content(tree, *known)
    facts = saved(facts, "facts")
    plain = tree.select("path", "text")
    return {"files": tree.select("path", "digest"), "facts": facts, "env": declared_env(plain, facts, configured), "dists": declared_dists(plain), "projects": project_facts(plain)}, parsed


def open_index(store: Store, tree: DataFrame, installed: DataFrame | None = None, manifest: dict | None = None) -> Index:
    """The index that the store's last version, or one manifest, holds of a tree."""
    manifest = manifest or store.manifest()
    tables = {x: store.read(x, manifest=manifest) for x in ("facts", "env", "dists", "projects", "routes", "names")}
    return Index(tree, installed, tables=tables)


def synchronise(store: Store, tree: DataFrame, configured: tuple[str, ...] = (), force: bool = False, commit: str = "", ts: int = 0) -> dict:
    """Brings the index up to the tree (path, text), and says what was done: action, version, changed and parsed files.

    A file counts as changed by its text alone.  What it said before is replaced, in the buckets of the changed files only; routes and
    own names follow from all files and are derived anew where the change can touch them.  The change log gets the nodes that
    came, went or changed, but for a first build.  All tables become visible at once, or none.  Other configured files or another
    version of this library build everything anew.
    """
    return retried(store, lambda base: _synchronise(store, base, tree, configured, force, commit, ts))


def _synchronise(store: Store, base: dict, tree: DataFrame, configured, force: bool, commit: str, ts: int) -> dict:
    key = json.dumps({"version": VERSION, "configured": list(configured)})
    first = not base["version"]
    anew = first or force or base["meta"].get("key") != key
    seen = tree.select("path", "text").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = None if first else store.read("files", manifest=base)
    bucket = store.bucket_of(F.col("path"))
    if first:
        changed = seen.select("path", F.lit(True).alias("came"), F.lit(False).alias("went"), bucket.alias("bucket"))
    else:
        both = seen.select("path", "digest").join(held.withColumnRenamed("digest", "was"), "path", "full")
        some = both if anew else both.where(~F.col("digest").eqNullSafe(F.col("was")))
        changed = some.select("path", F.col("was").isNull().alias("came"), F.col("digest").isNull().alias("went"), bucket.alias("bucket"), (~F.col("digest").eqNullSafe(F.col("was"))).alias("differs"))
    base_name = F.element_at(F.split("path", "/"), -1)
    # one row for each bucket, with three flags
    seen_in = changed.groupBy("bucket").agg(F.count("*").alias("n"), F.bool_or(F.col("came") | F.col("went")).alias("listing"), F.bool_or(F.col("path").endswith(".py")).alias("python"), F.bool_or(base_name.rlike(MANIFEST)).alias("manifest")).collect()
    if not seen_in and not anew:
        return {"action": "none", "version": base["version"], "changed": 0, "parsed": 0}
    changed = saved(changed, "changed")
    buckets = [r["bucket"] for r in seen_in]
    touched = {x: anew or any(r[x] for r in seen_in) for x in ("listing", "python", "manifest")}

    mine = seen.join(changed.where("not went").select("path"), "path", "left_semi")
    known: tuple = ()
    if not anew:  # texts that moved or were copied are known by their digest
        seen_before = mine.select("digest").distinct().join(held.where("path like '%.py'"), "digest").select("digest", "path")
        before = store.read("facts", manifest=base).join(seen_before, "path").select("digest", "line", "tag", "name", "value", "extra").distinct()
        known = (seen_before.select("digest").distinct(), before)
    said, parsed = _said(mine, known, configured)

    def staged(name: str) -> dict:
        rows, file = said[name], BY_FILE[name]
        if not anew:
            rows = store.read(name, buckets=buckets, manifest=base).join(changed.select(F.col("path").alias(file)), file, "left_anti").unionByName(rows)
        return store.staged(name, rows, file)

    # what no changed file can say anything in stays as it is; the others are written side by side
    wanted = [x for x in BY_FILE if anew or x not in ("dists", "projects") or touched["manifest"]]
    with ThreadPoolExecutor(len(wanted)) as pool:
        made = dict(zip(wanted, pool.map(staged, wanted)))
    tables = {}
    for name in BY_FILE:
        if name not in made:
            tables[name] = store.read(name, manifest=base)
        elif anew:
            tables[name] = store.read_staged(made[name])
        else:
            others = [int(b) for b in base["tables"][name]["buckets"] if int(b) not in set(buckets)]
            tables[name] = store.read_staged(made[name]).unionByName(store.read(name, buckets=others, manifest=base))
    paths = tables["files"].select("path")
    routed = F.col("tag").isin("router", "route", "include")
    if not anew and touched["python"] and not touched["listing"]:
        of = changed.select("path")
        was, now = store.read("facts", buckets=buckets, manifest=base), store.read_staged(made["facts"])
        touched["python"] = not was.unionByName(now).where(routed).join(of, "path", "left_semi").isEmpty()
    derived: dict[str, dict] = {}
    if touched["python"] or touched["listing"]:
        derived["routes"] = store.staged("routes", resolved_routes(paths, tables["facts"]), "file")
    if touched["listing"] or touched["manifest"]:
        derived["names"] = store.staged("names", own_names(paths, tables["projects"]), "name")
    more = {}
    if not first:
        now = Index(tree, tables=tables | {x: store.read_staged(derived[x]) if x in derived else store.read(x, manifest=base) for x in ("routes", "names")})
        # written before it is put in order, which reads it twice
        nodes = saved(sync_changes(snapshot(open_index(store, tree, manifest=base)), snapshot(now), changed.where("differs").select(F.col("path").alias("file"))), "nodes")
        log = store.read("changes", manifest=base)
        last = 0 if log is None else head_seq(log)
        more["changes"] = record_changes(tree.sparkSession.createDataFrame([(last,)], "seq long"), nodes, commit, ts)
    whole = derived | (made if anew else {})
    part = {} if anew else {x: (made[x], BY_FILE[x], buckets) for x in made}
    done = store.commit(base, whole, part, more, {"key": key})
    return {"action": "build" if anew else "sync", "version": done["version"], "changed": sum(r["n"] for r in seen_in), "parsed": parsed.count()}
