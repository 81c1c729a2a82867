"""A change, or a list of claims, checked against a tree: references, ladders and one verdict as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.text import mask_comments
from ..runtime import sized
from ..sources.aliases import script_aliases
from ..sources.files import declared_dists, declared_env, in_docs, is_ambient, python_facts, text_lines
from ..sources.projects import own_names, project_facts
from .evidence import test_reports
from .extract import env_reads, script_imports
from .imports import check_python_imports, check_script_imports
from .relations import check_references, did_you_mean, union_all
from .routes import check_route_claims, check_route_edges, resolved_routes

FINDING = ("kind", "subject", "ref", "file", "line", "level", "reason", "oracle")
#: Files whose lines are read for environment names by pattern, and those whose comments are blanked first.
CODE = r"\.(py|rb|go|rs|java|kt|cs|php|vue|svelte|[cm]?[jt]sx?)$"
CLIKE = r"\.(go|rs|java|kt|cs|php|vue|svelte|[cm]?[jt]sx?)$"
INSTALLED = "lang string, name string, dist string"


def file_facts(tree: DataFrame, configured: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What each file of a tree (path, text) says by itself, whatever the others say: the tables of an index."""
    facts = sized(python_facts(tree), "facts")
    return {"facts": facts, "env": sized(declared_env(tree, facts, configured), "env"), "dists": sized(declared_dists(tree), "dists"), "projects": sized(project_facts(tree), "projects")}


class Index:
    """What a tree (path, text) declares, each part read once: facts, environment, distributions, own names, routes.

    installed: (lang, name, dist) of packages that a machine has, which soften absence; none without it.  configured:
    files that are read like dotenv files.  tables: `file_facts` of the tree, where they are at hand.
    """

    def __init__(self, tree: DataFrame, installed: DataFrame | None = None, configured: tuple[str, ...] = (), tables: dict[str, DataFrame] | None = None):
        self.tree = tree
        # written tables: every part is read many times, and a lost executor costs no parsing again
        tables = tables or file_facts(tree, configured)
        self.facts, self.env, self.manifests, self.projects = (tables[x] for x in ("facts", "env", "dists", "projects"))
        self.dists = self.manifests.where("dist <> '' or kind = 'error'")
        paths = tree.select("path")
        self.routes = tables["routes"] if "routes" in tables else sized(resolved_routes(paths, self.facts), "routes")
        self.names = tables["names"] if "names" in tables else sized(own_names(paths, self.projects), "names")
        self.modules, self.nested, self.packages = (self.names.where(F.col("kind") == x).select("name") for x in ("module", "nested", "package"))
        self.installed = installed if installed is not None else tree.sparkSession.createDataFrame([], INSTALLED)

    def python(self) -> DataFrame:
        return self.manifests.where("lang = 'python'")

    def node(self) -> DataFrame:
        return self.manifests.where("lang = 'node'")

    def environment(self, claims: DataFrame) -> DataFrame:
        """Claims (subject, dynamic, has_default, ...) with level and reason of the environment ladder."""
        known = self.env.agg((F.count("*") > 0).alias("any_declared"))  # one row
        graded = check_references(claims.withColumnRenamed("subject", "name"), self.env, "name", "file").withColumnRenamed("name", "subject").crossJoin(F.broadcast(known))
        declared, ambient = F.col("declared_in").isNotNull(), is_ambient(F.col("subject"))
        level = ladders.env_level(F.lit(True), F.col("dynamic"), declared, ambient, F.col("has_default"), F.col("any_declared"))
        why = F.when(F.col("dynamic"), "dynamic").when(declared, "declared").when(ambient, "ambient").when(F.col("has_default"), "has a default").when(~F.col("any_declared"), "nothing declares names").otherwise("not declared")
        return graded.withColumns({"level": level, "reason": why})

    def imports(self, claims: DataFrame) -> DataFrame:
        """Claims (file, subject, optional) of Python imports with level and reason."""
        here = self.installed.where("lang = 'python'").select("name", "dist")
        return check_python_imports(claims, self.python(), self.modules, here, self.nested)

    def scripts(self, claims: DataFrame) -> DataFrame:
        """Claims (file, subject, optional) of script imports with level and reason."""
        here = self.installed.where("lang = 'node'").select("name")
        return check_script_imports(claims, self.node(), self.packages, script_aliases(self.tree), self.tree.select("path"), here)


def added_facts(added: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """Python facts on added lines (path, line, ...), and files (file, whole, body) among them.

    Where all added lines of a file stand in the tree as they are (whole; body is its text), its facts are those of
    the whole file on these lines; else the added lines are read as a text of their own.
    """
    # only files of the change are read from the tree; a file's added lines are a part of one file, so one row holds them
    by_file = added.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("lineno", "text"))).alias("x"))
    held = index.tree.select(F.col("path").alias("file"), F.col("text").alias("body")).join(by_file.select("file"), "file", "left_semi")
    lines = text_lines(F.col("body"))
    same = F.forall("x", lambda r: F.coalesce((r["lineno"] > 0) & (F.get(F.col("lines"), (r["lineno"] - 1).cast("int")) == r["text"]), F.lit(False)))
    files = by_file.join(held.withColumn("lines", lines), "file", "left").select("file", "x", "body", F.coalesce(same, F.lit(False)).alias("whole"))
    files = sized(files, "changed")
    at = added.select(F.col("file").alias("path"), F.col("lineno").alias("line")).distinct()
    # lines are many times what a plan takes them for, so they are merged and never sent whole to the driver
    mine = index.facts.join(files.where("whole").select(F.col("file").alias("path")), "path", "left_semi").join(at.hint("merge"), ["path", "line"], "left_semi")
    rest = files.where("file like '%.py' and not whole").select(F.col("file").alias("path"), F.array_join("x.text", "\n").alias("text"), F.col("x.lineno").alias("lines"))
    read = python_facts(rest.select("path", "text")).join(rest.select("path", "lines"), "path")
    read = read.withColumn("line", F.when(F.col("line") > 0, F.element_at("lines", F.col("line").cast("int"))).otherwise(F.col("line"))).drop("lines")
    return mine.unionByName(read), files


def scanned_lines(files: DataFrame) -> DataFrame:
    """(file, lineno, text) of added lines as patterns read them: comments of whole files are blank, of others as they came."""
    style = F.when(F.col("file").rlike(CLIKE), mask_comments(F.col("body"))).when(F.col("file").rlike(r"\.rb$"), mask_comments(F.col("body"), "hash"))
    rows = files.withColumn("shown", text_lines(F.when(F.col("whole"), style))).select("file", "shown", F.explode("x").alias("r"))
    return rows.select("file", F.col("r.lineno").alias("lineno"), F.coalesce(F.get("shown", (F.col("r.lineno") - 1).cast("int")), "r.text").alias("text"))


def environment_findings(facts: DataFrame, lines: DataFrame, parsed: DataFrame, index: Index) -> DataFrame:
    """Findings of reads of the environment: of Python that parses from its facts, of other code by pattern."""
    env = facts.where("tag = 'env'").select(F.col("path").alias("file"), "line", F.col("name").alias("subject"), (F.col("extra") == "dynamic").alias("dynamic"), (F.col("extra") == "default").alias("has_default"))
    code = lines.where(F.col("file").rlike(CODE)).join(parsed, "file", "left_anti")
    env = env.unionByName(env_reads(code).select("file", F.col("lineno").alias("line"), F.col("name").alias("subject"), "dynamic", "has_default"))
    return index.environment(env.distinct()).select(F.lit("env_var").alias("kind"), "subject", F.col("subject").alias("ref"), "file", "line", "level", "reason", "dynamic")


def import_findings(facts: DataFrame, lines: DataFrame, parsed: DataFrame, index: Index) -> DataFrame:
    """Findings of imports of Python and of scripts."""
    imports = facts.where("tag = 'import'").select(F.col("path").alias("file"), "line", F.col("name").alias("subject"), (F.col("extra") == "optional").alias("optional"))
    graded = index.imports(imports.groupBy("file", "subject").agg(F.bool_or("optional").alias("optional")))
    named = imports.select("file", "line", "subject").distinct()
    scripts = sized(script_imports(lines).select("file", F.col("lineno").alias("line"), "subject"), "scripts")
    if not scripts.isEmpty():
        graded = graded.unionByName(index.scripts(scripts.select("file", "subject", F.lit(False).alias("optional")).distinct()).select(*graded.columns))
        named = named.unionByName(scripts).distinct()
    return named.join(graded, ["file", "subject"]).select(F.lit("import").alias("kind"), "subject", F.col("subject").alias("ref"), "file", "line", "level", "reason", (F.col("subject") == "<dynamic>").alias("dynamic"))


def route_findings(facts: DataFrame, lines: DataFrame, parsed: DataFrame, index: Index) -> DataFrame | None:
    """Findings of routes and includes; None where the change has none."""
    edge = F.col("tag").isin("edge", "include")
    if facts.where(edge).isEmpty():
        return None
    # a file that the tree does not hold binds its names in the change itself
    fresh = facts.where(~edge).join(index.facts.select("path").distinct(), "path", "left_anti").select(*facts.columns)
    around = index.facts.where(~edge).unionByName(fresh).unionByName(facts.where(edge))
    edges = check_route_edges(around, index.tree.select("path"))
    return edges.select("kind", "subject", F.col("name").alias("ref"), "file", "line", "level", "reason", F.lit(False).alias("dynamic"))


def check_change(added: DataFrame, tree: DataFrame, index: Index | None = None, oracles: dict | None = None) -> DataFrame:
    """Findings (kind, subject, ref, file, line, level, reason, oracle) of the references on added lines (file, lineno, text).

    ref is the name that was looked up: the subject, or the handler or router of a route.

    Soft references (computed ones, and all in folders of documentation) are reviewed at most.  A corrupt manifest
    makes import claims unverifiable.  Equal findings appear once; null texts add nothing.  oracles: name and function of
    each check, as `plugins.oracles` gives them; one that fails gives one unverifiable finding and stops no other.
    """
    from .plugins import BUILT_IN, guarded

    index = index or Index(tree)
    added = added.where("file is not null and text is not null").select("file", F.col("lineno").cast("long").alias("lineno"), "text")
    facts, files = added_facts(added, index)
    facts = sized(facts, "added")
    parsed = index.facts.where("tag = 'parsed'").select(F.col("path").alias("file")).join(files.where("whole"), "file", "left_semi").unionByName(facts.where("tag = 'parsed'").select(F.col("path").alias("file"))).distinct()
    lines = scanned_lines(files)
    found = guarded(oracles or BUILT_IN, facts, lines, parsed, index)
    return found.withColumn("level", ladders.capped(F.col("level"), ~F.col("dynamic") & ~in_docs(F.col("file")))).select(*FINDING).distinct()


def check_change_with(settings: dict, added: DataFrame, tree: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    """`check_change` as a repository's settings have it (`settings.settings_of`): its oracles, its files of names, without its excluded folders."""
    from .plugins import oracles

    away = set(settings["exclude"])
    if away:
        tree, added = (x.where(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, sorted(away))))) for x, path in ((tree, "path"), (added, "file")))
    return check_change(added, tree, Index(tree, installed, tuple(settings["env_declared_in"])), oracles(settings["oracles"]))


def suggestions(findings: DataFrame, index: Index, limit: int = 3) -> DataFrame:
    """(kind, ref, file, rank, candidate) for rejected findings: declared names, listed distributions and the tree's own
    modules, or names that the finding's file binds."""
    bad = sized(findings.where("level = 'reject'").select("kind", "ref", "file").distinct(), "rejected")
    any_file = F.lit("")
    pools = [
        index.env.select(F.lit("env_var").alias("kind"), any_file.alias("at"), F.col("name").alias("candidate")),
        index.dists.where("kind <> 'error'").select(F.lit("import").alias("kind"), any_file.alias("at"), F.col("dist").alias("candidate")),
        index.modules.select(F.lit("import").alias("kind"), any_file.alias("at"), F.col("name").alias("candidate")),
        index.facts.where("tag = 'binding' and name <> '*'").select(F.explode(F.array(F.lit("route_handler"), F.lit("router_include"))).alias("kind"), F.col("path").alias("at"), F.col("name").alias("candidate")),
    ]
    pool = union_all(pools).distinct()
    wanted = bad.withColumn("at", F.when(F.col("kind").isin("env_var", "import"), any_file).otherwise(F.col("file")))
    near = did_you_mean(wanted, pool, "ref", "candidate", limit, within=["kind", "at"])
    return near.withColumnRenamed("name", "ref").join(wanted, ["kind", "at", "ref"]).select("kind", "ref", "file", "rank", "candidate")


def claimed_reports(claims: DataFrame, tree: DataFrame) -> DataFrame:
    """(claim, named, tests, failures, errors): the JUnit report that each claim (claim, attrs) names, counts null where the tree has no such report."""
    given = lambda path: F.nullif(path, F.lit(""))
    evidence = F.col("attrs")["evidence"]
    path = F.coalesce(given(F.col("attrs")["report"]), given(F.get_json_object(evidence, "$.report")), given(F.get_json_object(evidence, "$.junit")))
    named = claims.select("claim", F.regexp_replace(path, r"^\./", "").alias("path")).where("path is not null")
    texts = tree.select("path", "text").join(named.select("path").distinct(), "path", "left_semi")
    return named.join(test_reports(texts), "path", "left").select("claim", F.lit(True).alias("named"), "tests", "failures", "errors")


def check_claims(claims: DataFrame, tree: DataFrame, index: Index | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Claims as `claims_from_json` gives them (nth, kind, subject, file, hard, attrs, error, and other columns), each with level and reason.

    Malformed claims and kinds that nothing here checks are unverifiable, never lost; soft claims are reviewed at most.
    Outcomes are graded by observed runs first (runs: command, exit_code; several of one command by the worst), then by
    the JUnit report that a claim names in the tree, then by what the claim says itself.
    """
    index = index or Index(tree)
    c = sized(claims.withColumn("claim", F.monotonically_increasing_id()), "claims")
    good = c.where("error is null")
    attr = lambda name: F.col("attrs")[name]
    env = index.environment(good.where("kind = 'env_var'").select("claim", "subject", F.lit(False).alias("dynamic"), F.lit(False).alias("has_default"))).select("claim", "level", "reason")
    script = F.coalesce(attr("lang").isin("js", "node") | F.col("file").rlike(r"\.[cm]?[jt]sx?$"), F.lit(False))
    named = good.where("kind = 'import'").select("claim", "file", "subject", script.alias("script"), F.lit(False).alias("optional"))
    parts = []
    for is_script, check in ((False, index.imports), (True, index.scripts)):
        mine = named.where(F.col("script") == is_script)
        if is_script and mine.isEmpty():
            continue
        parts.append(mine.join(check(mine.select("file", "subject", "optional").distinct()), ["file", "subject"]).select("claim", "level", "reason"))
    routes = good.where("kind = 'route_handler'").select("claim", "subject", F.element_at(F.split(attr("handler"), r"\."), -1).alias("handler"))
    graded = check_route_claims(routes.select("subject", "handler").distinct(), index.routes).select(F.col("subject").alias("s"), F.col("handler").alias("h"), "level", "reason")
    parts.append(routes.join(graded, (F.col("subject") == F.col("s")) & F.col("handler").eqNullSafe(F.col("h"))).select("claim", "level", "reason"))
    evidence = lambda name: F.get_json_object(attr("evidence"), f"$.{name}")
    none = F.lit(None).cast("int")
    outcomes = good.where("kind in ('tests_pass', 'endpoint_status', 'bug_fixed')")
    seen = runs if runs is not None else claims.sparkSession.createDataFrame([], "command string, exit_code int")
    command = F.array_join(F.split(F.trim(F.coalesce(attr("command"), evidence("command"))), r"\s+"), " ")
    seen = seen.select(F.array_join(F.split(F.trim("command"), r"\s+"), " ").alias("ran"), "exit_code").groupBy("ran").agg(F.max(F.abs("exit_code")).alias("observed"))
    outcomes = outcomes.withColumn("ran", command).join(seen, "ran", "left").join(claimed_reports(outcomes, index.tree), "claim", "left")
    tests = ladders.tests_honesty(F.coalesce("named", F.lit(False)), F.col("tests"), F.col("failures"), F.col("errors"), evidence("exit_code").cast("int"), evidence("output"), F.col("observed"))
    endpoint = ladders.endpoint_honesty(attr("status").cast("int"), none, evidence("observed_status").cast("int"))
    bug = ladders.bug_honesty(attr("signature"), evidence("before"), evidence("after"))
    honesty = F.when(F.col("kind") == "tests_pass", tests).when(F.col("kind") == "endpoint_status", endpoint).otherwise(bug)
    parts.append(outcomes.select("claim", honesty.alias("reason")).select("claim", ladders.honesty_level(F.col("reason")).alias("level"), "reason"))
    found = c.join(union_all([env, *parts]).groupBy("claim").agg(F.max_by(F.struct("level", "reason"), F.coalesce(ladders.rank(F.col("level")), F.lit(-1))).alias("f")), "claim", "left")
    level = F.when(F.col("error").isNotNull() | F.col("f").isNull(), "unverifiable").otherwise(ladders.capped(F.col("f.level"), F.col("hard")))
    reason = F.coalesce("error", "f.reason", F.lit("nothing checks this kind"))
    return found.select(*claims.columns, level.alias("level"), reason.alias("reason"))


def verdict(findings: DataFrame, block_on: str = "reject") -> DataFrame:
    """One row: verdict, blocking, and the number of findings of each level."""
    counts = {x: F.count_if(F.col("level") == x).cast("long").alias(x) for x in ("accept", "review", "reject", "unverifiable")}
    row = findings.agg(ladders.worst(F.col("level")).alias("verdict"), *counts.values())
    return row.select("verdict", ladders.blocks(F.col("verdict"), F.lit(block_on)).alias("blocking"), *counts)
