"""Route tables of web services and the ladder of route claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import sized
from ..sources.files import python_facts
from ..sources.projects import module_homes

#: Includes above a router that are followed; deeper chains are unresolved.
DEPTH = 4


def _includes(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """(in_file, parent, file, var, inc_prefix): what each include adds; file is null where no module is found."""
    child = F.split("value", r"\.")
    raw = facts.where("tag = 'include'").select(F.col("path").alias("in_file"), "line", F.col("name").alias("parent"), F.element_at(child, -1).alias("child"), F.when(F.size(child) > 1, F.element_at(child, -2)).alias("owner"), F.col("extra").alias("inc_prefix"))
    names = facts.where("tag = 'imported'").select(F.col("path").alias("in_file"), F.col("name").alias("local"), F.col("value").alias("module"), F.col("extra").alias("original"))
    seen = raw.withColumn("local", F.coalesce("owner", "child")).join(names, ["in_file", "local"], "left")
    inner = F.concat("module", F.when(F.col("module").endswith("."), "").otherwise("."), "original")
    module = F.when(F.col("owner").isNotNull(), inner).otherwise(F.col("module"))
    seen = seen.withColumn("var", F.when(F.col("owner").isNull() & F.col("module").isNotNull(), F.col("original")).otherwise(F.col("child")))
    seen = seen.withColumn("inner", module)
    homes = module_homes(seen.select(F.col("in_file").alias("file"), F.col("inner").alias("module")), paths).select(F.col("file").alias("in_file"), F.col("module").alias("inner"), F.col("home").alias("file"))
    placed = seen.join(homes, ["in_file", "inner"], "left").withColumn("file", F.when(F.col("inner").isNull(), F.col("in_file")).otherwise(F.col("file")))
    return placed.select("in_file", "parent", "var", "inc_prefix", "file").distinct()


def _chains(routers: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, var, base): every prefix under which a router hangs below an application, null where it cannot be told.

    A router that nothing includes stands by itself; one whose parent leads to no application is unresolved, as is
    one below a computed prefix or more than DEPTH includes down.  A parent's own prefix counts if it is a router.
    """
    kinds = routers.select(F.col("file").alias("at_file"), F.col("var").alias("at_var"), "kind", "prefix")
    up = edges.select(F.col("file").alias("at_file"), F.col("var").alias("at_var"), F.col("in_file").alias("up_file"), F.col("parent").alias("up_var"), "inc_prefix").distinct()
    at = routers.select("file", "var", F.col("file").alias("at_file"), F.col("var").alias("at_var"), F.lit("").alias("base"))
    found = None
    for depth in range(DEPTH + 1):
        known = at.join(kinds, ["at_file", "at_var"], "left")
        if depth:  # what was added so far lies below this one's own prefix
            known = known.withColumn("base", F.concat(F.when(F.col("kind") == "router", F.col("prefix")).otherwise(""), "base"))
        here = known.join(up, ["at_file", "at_var"], "left")
        app, alone = F.coalesce(F.col("kind") == "app", F.lit(False)), F.col("up_file").isNull()
        stuck = alone | F.col("inc_prefix").contains("?") | F.lit(depth >= DEPTH)
        base = F.when(app, F.col("base"))
        if depth == 0:
            base = base.when(alone, F.lit(""))
        done = here.where(app | stuck).select("file", "var", base.alias("base"))
        found = done if found is None else found.unionByName(done)
        # a written table, so that no step is planned and computed again within the next ones; most chains are short
        at = sized(here.where(~app & ~stuck).select("file", "var", F.col("up_file").alias("at_file"), F.col("up_var").alias("at_var"), F.concat("inc_prefix", "base").alias("base")), "chains")
        if at.isEmpty():
            break
    return found.distinct()


def resolved_routes(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(method, full, tail, handler, dynamic, file): all routes of a tree (path, text).

    full: null if the prefix cannot be told, `?` stands for a computed part; tail: router's prefix and path.  An
    include that leads to no router of the tree gives one row of method `?`, which keeps absence from being proved.
    """
    facts = sized(python_facts(files), "facts") if facts is None else facts
    routers = facts.where("tag = 'router'").select(F.col("path").alias("file"), F.col("name").alias("var"), F.col("value").alias("prefix"), F.col("extra").alias("kind"))
    routers = sized(routers.groupBy("file", "var").agg(F.max("kind").alias("kind"), F.max("prefix").alias("prefix")), "routers")
    where = F.split("extra", " ", 2)
    routes = facts.where("tag = 'route'").select(F.col("path").alias("file"), F.col("name").alias("method"), F.col("value").alias("path"), where.getItem(0).alias("var"), where.getItem(1).alias("handler"))
    edges = sized(_includes(facts, files), "includes")
    placed = routes.join(routers, ["file", "var"], "left").join(_chains(routers, edges), ["file", "var"], "left")
    own = F.when(F.col("kind") == "router", F.col("prefix")).otherwise("")
    full = F.when((F.col("kind") == "app") | (F.col("kind").isNull() & F.col("var").isin("app", "application")), F.col("path")).when(F.col("kind") == "router", F.concat("base", own, "path"))
    rows = placed.select("method", full.alias("full"), F.concat(own, "path").alias("tail"), "handler", (~F.col("handler").rlike(r"^[\w.]+$")).alias("dynamic"), "file")
    lost = edges.join(routers, ["file", "var"], "left_anti").select(F.lit("?").alias("method"), F.lit(None).cast("string").alias("full"), F.col("inc_prefix").alias("tail"), F.col("var").alias("handler"), F.lit(True).alias("dynamic"), F.col("in_file").alias("file"))
    return rows.unionByName(lost).distinct()


def route_table(files: DataFrame) -> DataFrame:
    """(method, full, handler, file) of `resolved_routes`."""
    return resolved_routes(files).select("method", "full", "handler", "file").distinct()


def norm_path(path: Column) -> Column:
    path = F.trim(path)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)


def shape(path: Column) -> Column:
    """A path with all parameters alike: two paths match in their parameters if their shapes are equal."""
    return F.regexp_replace(path, r"(?<=/|^)\{[^/]*", "{}")


def check_route_claims(claims: DataFrame, routes: DataFrame) -> DataFrame:
    """Claims (subject, handler) with level and reason, first rung that holds.

    subject: `METHOD /path`, or a path alone for any method; handler may be null.  Routes as `resolved_routes` gives
    them; none at all is unverifiable.  Matches are equi joins: on method and path shape, and for routes under an
    unknown prefix on method and every suffix of the claimed path.  Null subjects are left out.
    """
    cut = F.regexp_extract(F.trim("subject"), r"^(\S+)\s+(.*)$", 1)
    rest = F.regexp_extract(F.trim("subject"), r"^(\S+)\s+(.*)$", 2)
    c = claims.where("subject is not null").select("subject", F.element_at(F.split("handler", r"\."), -1).alias("wanted")).distinct()
    c = c.withColumn("method", F.when(cut.isin("", "*"), "ANY").otherwise(F.upper(cut))).withColumn("want", norm_path(F.when(cut == "", F.col("subject")).otherwise(rest)))
    routes = sized(routes, "routes")  # used three times, and each would resolve them again
    either = routes.select("*", F.explode(F.array_distinct(F.array("method", F.lit("ANY")))).alias("key"))
    known = either.where("full is not null").select(F.col("key").alias("method"), norm_path(F.col("full")).alias("at"), F.element_at(F.split("handler", r"\."), -1).alias("found"), "dynamic").withColumn("shape", shape(F.col("at")))
    hits = c.withColumn("shape", shape(F.col("want"))).join(known, ["method", "shape"])
    same = Window.partitionBy("subject", "wanted")
    hits = hits.withColumn("exact", F.max(F.col("at") == F.col("want")).over(same)).where("not exact or at = want")
    hits = hits.groupBy("subject", "wanted").agg(F.max(F.coalesce(F.col("found") == F.col("wanted"), F.lit(False)) | F.col("dynamic")).alias("handled"))
    parts = F.split(F.regexp_replace(shape(F.col("want")), "^/|/$", ""), "/")
    ends = c.select("subject", "wanted", "method", parts.alias("p")).select("subject", "wanted", "method", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice(F.col("p"), i, F.size("p")), "/"))).alias("end"))
    tails = either.where("full is null").select(F.col("key").alias("method"), F.regexp_replace(shape(norm_path(F.col("tail"))), "^/", "").alias("end")).distinct()
    loose = ends.join(tails, ["method", "end"], "left_semi").select("subject", "wanted").distinct()
    table = routes.agg(F.count("*").alias("n"), F.max((F.col("method") == "?") | F.col("full").isNull() | F.col("full").contains("?")).alias("open")).first()  # two values

    def beside(df, k):
        renamed = df.withColumnsRenamed({"subject": f"subject{k}", "wanted": f"wanted{k}"})
        return renamed, F.col("subject").eqNullSafe(F.col(f"subject{k}")) & F.col("wanted").eqNullSafe(F.col(f"wanted{k}"))

    graded = c.join(*beside(hits, 1), "left").join(*beside(loose.withColumn("loose", F.lit(True)), 2), "left")
    rungs = (
        (F.lit(table["n"] == 0), "unverifiable", "no routes"), (F.col("handled").isNotNull() & F.col("wanted").isNotNull() & ~F.col("handled"), "reject", "handled by another"), (F.col("handled").isNotNull(), "accept", "registered"),
        (F.col("loose").isNotNull(), "review", "under an unresolved prefix"), (F.lit(bool(table["open"])), "review", "dynamic registration"),
    )
    level, reason = F.when(rungs[0][0], rungs[0][1]), F.when(rungs[0][0], rungs[0][2])
    for test, grade, why in rungs[1:]:
        level, reason = level.when(test, grade), reason.when(test, why)
    return graded.select("subject", F.col("wanted").alias("handler"), level.otherwise("reject").alias("level"), reason.otherwise("absent").alias("reason"))


def check_route_edges(facts: DataFrame, tree: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """(kind, subject, file, line, level, reason): routes and includes of code against what their files bind.

    facts: `python_facts`; tree: path, of all files; added: file, lineno, of the lines to be judged (all without it).
    Names lead one hop through imports into the tree's own modules; every lookup is an equi join.
    """
    edges = facts.where("tag in ('edge', 'include')").select(
        F.when(F.col("tag") == "edge", "route_handler").otherwise("router_include").alias("kind"), F.when(F.col("tag") == "edge", F.col("name")).otherwise(F.col("value")).alias("subject"), F.col("path").alias("file"), "line",
        F.col("value").alias("ref"), F.when(F.col("tag") == "edge", F.substring_index("extra", " ", 1)).otherwise("call").alias("style"), F.when(F.col("tag") == "edge", F.substring_index("extra", " ", -1)).alias("router"),
    ).distinct()
    if added is not None:
        edges = edges.join(added.select("file", F.col("lineno").alias("line")).distinct(), ["file", "line"], "left_semi")
    # of several bindings of a name the last one counts
    bound = facts.where("tag = 'binding'").select(F.col("path").alias("at"), F.col("name").alias("bound"), F.col("value").alias("how"), F.col("extra").alias("target"), "line")
    bound = bound.groupBy("at", "bound").agg(F.max_by(F.struct("how", "target"), F.struct("line", "how", "target")).alias("b")).select("at", "bound", "b.how", "b.target")
    starred = bound.where("how = 'star'").select("at").distinct()
    open_ = bound.where("bound = '__getattr__'").select("at").distinct()
    indexed = facts.where("tag = 'parsed'").select(F.col("path").alias("at")).distinct()
    name = F.when(F.col("style") == "decorator", F.col("router")).otherwise(F.substring_index("ref", ".", 1))
    e = edges.withColumns({"name": name, "rest": F.when(F.col("ref").contains("."), F.regexp_replace("ref", r"^[^.]*\.", "")), "dynamic": ~F.col("ref").rlike(r"^[\w.]+$")})

    def flag(df, key, name):
        return df.select(F.col("at").alias(key)).withColumn(name, F.lit(True))

    e = e.join(bound.withColumnsRenamed({"at": "file", "bound": "name"}), ["file", "name"], "left").join(flag(starred, "file", "star"), "file", "left")
    module, member = F.substring_index("target", ":", 1), F.when(F.col("target").contains(":"), F.substring_index("target", ":", -1))
    inner = F.concat(module, F.when(module.endswith("."), "").otherwise("."), member)
    e = e.withColumns({"module": F.when(member.isNotNull() & F.col("rest").isNotNull(), inner).otherwise(module), "wanted": F.when(member.isNotNull() & F.col("rest").isNull(), member).otherwise(F.col("rest"))})
    found = module_homes(e.where("how = 'import'"), tree)
    e = e.join(found, ["file", "module"], "left").withColumn("head", F.substring_index("wanted", ".", 1))
    there = bound.select(F.col("at").alias("home"), F.col("bound").alias("head"), F.lit(True).alias("has"))
    e = e.join(there, ["home", "head"], "left").join(flag(starred, "home", "home_star"), "home", "left").join(flag(open_, "home", "home_open"), "home", "left").join(flag(indexed, "home", "home_known"), "home", "left")
    yes, none = (lambda x: F.coalesce(F.col(x), F.lit(False))), F.col("how").isNull()
    decorator, local = F.col("style") == "decorator", F.col("how").isin("def", "class", "assign")
    rungs = (
        (decorator & none & yes("star"), "review", "router may come from a star import"), (decorator & none, "reject", "router is not bound in this file"), (decorator, "accept", "defined by the decorator"),
        (F.col("dynamic"), "review", "computed at runtime"), (none & yes("star"), "review", "may come from a star import"), (none, "reject", "not bound in this file"), (F.col("how") == "param", "accept", "parameter"),
        (local & F.col("rest").isNull(), "accept", "bound in this file"), (local, "review", "attribute of a local object"), (F.col("how") == "star", "review", "may come from a star import"),
        (F.col("wanted").isNull(), "review", "a module"), (F.col("home").isNull() & F.col("target").contains(":") & F.col("rest").isNotNull(), "review", "attribute of an imported object"), (F.col("home").isNull(), "review", "outside the tree"),
        (~yes("home_known"), "unverifiable", "its module does not parse"), (yes("has") & F.col("wanted").contains("."), "review", "nested below a binding"), (yes("has"), "accept", "bound in its module"),
        (yes("home_star"), "review", "its module has a star import"), (yes("home_open"), "review", "its module supplies names at runtime"),
    )
    level, reason = F.when(rungs[0][0], rungs[0][1]), F.when(rungs[0][0], rungs[0][2])
    for test, grade, why in rungs[1:]:
        level, reason = level.when(test, grade), reason.when(test, why)
    return e.select("kind", "subject", "file", "line", level.otherwise("reject").alias("level"), reason.otherwise("its module does not bind it").alias("reason"), "name").distinct()
