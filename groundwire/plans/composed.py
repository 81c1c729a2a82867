"""Queries over composed operators, on source trees that are generated from the tables; each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import anchors, change, claims, evidence, graph, imports, index, mutation, notes
from ..runtime import ordered, saved, sized, spread
from ..sources import files, stack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LIB = "concat('lib', translate(lower(n_name), '_0123456789 ', 'xabcdefghij'))"


def service_tree(spark: SparkSession, sf_dir: str, listed: str = "n_regionkey <= 2", declared: str = "n_regionkey <> 4") -> DataFrame:
    """(path, text): one module a supplier, which imports a library of its nation and reads a name of its nation; nations
    of some regions are locked and declared."""
    nation = t(spark, sf_dir, "nation").withColumn("lib", F.expr(LIB))

    def listing(path, where, line):
        return nation.where(where).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")).select(F.lit(path).alias("path"), "text")

    names = listing(".env.example", declared, F.concat(F.lit("NATION_"), "n_nationkey", F.lit("=")))
    locks = listing("requirements.txt", listed, F.concat("lib", F.lit("==1.0")))
    code = spread(t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.format_string('import os\nimport %s\n\n\ndef load():\n    return os.environ["NATION_%d"]\n', "lib", F.col("n_nationkey").cast("long"))
    return sized(names.unionByName(locks).unionByName(code.select(F.format_string("svc/s%d.py", "s_suppkey").alias("path"), text.alias("text"))), "tree")


SERVICES = f"(select 'svc/s' || s_suppkey || '.py' as file, {LIB} as lib, 'NATION_' || n_nationkey as env, n_regionkey as region from supplier join nation on s_nationkey = n_nationkey)"
FINDINGS = f"""
select 'import' as kind, 'os' as subject, 'os' as ref, file, 1::bigint as line, 'accept' as level, 'standard library' as reason, 'imports_lockfile' as oracle from {SERVICES}
union all select 'import', lib, lib, file, 2, case when region <= 2 then 'accept' else 'reject' end, case when region <= 2 then 'provided' else 'absent' end, 'imports_lockfile' from {SERVICES}
union all select 'env_var', env, env, file, 6, case when region <> 4 then 'accept' else 'reject' end, case when region <> 4 then 'declared' else 'not declared' end, 'env_vars' from {SERVICES}"""


@query(FINDINGS)
def gate_change(spark, sf_dir):
    """Every line of every module as a change of the tree that holds it."""
    tree = service_tree(spark, sf_dir)
    return change.check_change(files.region_lines(tree.where("path like '%.py'")), tree)


@query(f"select max(level) as verdict, true as blocking, count(*) filter (level = 'accept') as accept, 0::bigint as review, count(*) filter (level = 'reject') as reject, 0::bigint as unverifiable from ({FINDINGS})")
def gate_change_verdict(spark, sf_dir):
    return change.verdict(gate_change(spark, sf_dir))


@query(f"""
with c as (select env, lib, region, file from {SERVICES})
select nth::bigint as nth, kind, subject, level, reason, count(*) as n from (
    select 0 as nth, 'env_var' as kind, env as subject, case when region <> 4 then 'accept' else 'reject' end as level, case when region <> 4 then 'declared' else 'not declared' end as reason from c
    union all select 1, 'import', lib, case when region <= 2 then 'accept' else 'review' end, case when region <= 2 then 'provided' else 'absent' end from c
    union all select 2, 'tests_pass', 'make', case when region = 0 then 'reject' else 'review' end, case when region = 0 then 'contradicted' else 'plausible' end from c
    union all select 3, 'song', file, 'unverifiable', 'nothing checks this kind' from c) group by all""")
def gate_claims(spark, sf_dir):
    """Four claims a supplier, as JSON: a name, a soft import, an outcome with its exit code, and one of no known kind."""
    s = t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation").withColumn("lib", F.expr(LIB))), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.format_string(
        '[{"kind": "env", "subject": "NATION_%d"}, {"kind": "import", "subject": "%s", "hard": false}, {"kind": "tests", "command": "make", "evidence": {"exit_code": %d}}, {"kind": "song", "subject": "svc/s%d.py"}]',
        F.col("n_nationkey").cast("long"), "lib", (F.col("n_regionkey") == 0).cast("long"), "s_suppkey",
    )
    asked = claims.claims_from_json(s.select("s_suppkey", text.alias("j")), "j")
    return change.check_claims(asked, service_tree(spark, sf_dir)).groupBy("nth", "kind", "subject", "level", "reason").agg(F.count("*").cast("long").alias("n"))


@query(f"""
select 'file:' || file as a, 'symbol:' || file || ':load' as b, 'declares' as relation, file, 5::bigint as line from {SERVICES}
union all select distinct 'file:.env.example', 'env:NATION_' || n_nationkey, 'declares', '.env.example', 0 from nation where n_regionkey <> 4
union all select distinct 'file:requirements.txt', 'dist:python:' || {LIB}, 'declares_dependency', 'requirements.txt', 0 from nation where n_regionkey <= 2
union all select 'symbol:' || file || ':load', 'env:' || env, 'reads_env', file, 6 from {SERVICES} where region <> 4
union all select 'file:' || file, 'dist:python:' || lib, 'imports', file, 2 from {SERVICES} where region <= 2""")
def gr_context_edges(spark, sf_dir):
    return graph.context_edges(service_tree(spark, sf_dir)).withColumn("line", F.coalesce("line", F.lit(0).cast("long")))


AFTER = ("n_regionkey <= 1", "n_regionkey <> 3")
CHANGES = f"""
select 'file:.env.example' as node, 'changed' as op union all select 'file:requirements.txt', 'changed'
union all select 'dist:python:' || {LIB}, case when n_regionkey = 2 then 'removed' else 'changed' end from nation where n_regionkey <= 2
union all select 'env:NATION_' || n_nationkey, case n_regionkey when 3 then 'removed' when 4 then 'added' else 'changed' end from nation"""


def sync_of_trees(spark, sf_dir):
    before, after = service_tree(spark, sf_dir), service_tree(spark, sf_dir, *AFTER)
    return index.sync_changes(index.snapshot(change.Index(before)), index.snapshot(change.Index(after)), index.changed_files(before, after))


@query(CHANGES)
def idx_sync_changes(spark, sf_dir):
    """What one synchronisation records when a lockfile and a declaration file change."""
    return sync_of_trees(spark, sf_dir)


@query(f"select row_number() over (order by node collate c, op) + (select max(event_id) from events) as seq, 7::bigint as ts, 'abc' as commit_hash, node, op from ({CHANGES})".replace(" collate c", ""))
def snk_record_changes(spark, sf_dir):
    log = t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return index.record_changes(log, sync_of_trees(spark, sf_dir), "abc", 7)


@query("select event_id as seq, event_type as node from events where event_id > (select max(event_id) from events) - 777")
def snk_prune_changes(spark, sf_dir):
    return index.prune_changes(t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("node")), 777)


@query("""
with page as (select * from events where event_id > 100 order by event_id limit 600)
select user_id as node, arg_max(event_type, event_id) as op, max(event_id) as last_seq, (select max(event_id) from page) as cursor, (select count(*) from events where event_id > 100) > 600 as has_more from page group by 1""")
def mem_changes_page(spark, sf_dir):
    """A page of the change log whose cursor is the page's own last row."""
    log = t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("node"), F.col("event_type").alias("op"))
    return index.changes_since(log, 100, 600)


CITED = f"""
select file as id, 'env' as kind, env as value, 'env:' || env as node, case when region = 4 then 'invalid' else 'valid' end as was from {SERVICES}
union all select file, 'import', lib, 'dist:python:' || lib, case when region <= 2 then 'valid' else 'invalid' end from {SERVICES}
union all select file, 'file', file, 'file:' || file, 'valid' from {SERVICES}
union all select file, 'symbol', file || ':load', 'symbol:' || file || ':load', 'valid' from {SERVICES}"""


def cited_anchors(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation").withColumn("lib", F.expr(LIB))), F.col("s_nationkey") == F.col("n_nationkey"))
    path = F.format_string("svc/s%d.py", "s_suppkey")
    rows = s.select(path.alias("id"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("env", F.concat(F.lit("NATION_"), "n_nationkey")), ("import", F.col("lib")), ("file", path), ("symbol", F.concat(path, F.lit(":load"))))))).alias("c"))
    cited = rows.select("id", "c.kind", "c.value")
    return anchors.anchors(cited, cited.limit(0), change.Index(service_tree(spark, sf_dir)))


@query(f"select id, kind, value, node, was as state, was = 'valid' as hashed from ({CITED})")
def mem_anchors(spark, sf_dir):
    return cited_anchors(spark, sf_dir).select("id", "kind", "value", "node", "state", F.col("content_hash").isNotNull().alias("hashed"))


@query(f"select id, kind, value, state from (select id, kind, value, case when kind in ('file', 'symbol') then 'valid' when kind = 'import' then case when region <= 1 then 'stale' else 'invalid' end when region = 3 then 'invalid' when region = 4 then 'stale' else 'valid' end as state from ({CITED}) c join (select file, region from {SERVICES}) s on s.file = c.id)")
def mem_check_anchors(spark, sf_dir):
    """Anchors of one tree checked against a later one."""
    return anchors.check_anchors(cited_anchors(spark, sf_dir), change.Index(service_tree(spark, sf_dir, *AFTER))).select("id", "kind", "value", "state")


@query("select doc_id as id, case when doc_id % 3 = 0 then 'unverified' when doc_id % 3 = 1 then case when coalesce(quality, 1) = 1 then 'anchored' else 'stale' end else 'invalid' end as state from documents left join labels using (doc_id)")
def mem_note_states(spark, sf_dir):
    held = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    made = held.select("id", F.explode(F.when(F.col("id") % 3 == 1, F.array(F.lit("valid"), F.when(F.col("quality") == 0, "stale").otherwise("valid"))).when(F.col("id") % 3 == 2, F.array(F.lit("valid"), F.lit("invalid"))).otherwise(F.array().cast("array<string>"))).alias("state"))
    return anchors.note_states(held, made)


@query("select doc_id as id, case when l.doc_id is not null then 'new' else 'old' end as title, doc_id * 2 as created from documents d left join labels l using (doc_id)")
def mem_upsert(spark, sf_dir):
    held = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("old").alias("title"), (F.col("doc_id") * 2).alias("created"))
    return anchors.upserted(held, t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("new").alias("title"), F.lit(0).cast("long").alias("created")))


@query("select 'note' as part, doc_id as id from documents where doc_id not in (select doc_id from labels) union all select 'handoff', doc_id from documents where doc_id % 2 = 0 and doc_id not in (select doc_id from labels)")
def mem_forget(spark, sf_dir):
    held = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    left, beside = anchors.forget(held, held.where("id % 2 = 0").select(F.col("id").alias("note_id")), t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return left.select(F.lit("note").alias("part"), "id").unionByName(beside.select(F.lit("handoff").alias("part"), F.col("note_id").alias("id")))


@query("""
select 'o' || l_orderkey as path, greatest(count(*) - count(*) filter (l_returnflag = 'N'), 0) as tests, greatest(count(*) filter (l_returnflag = 'R'), any_value(l_orderkey % 4)) as failures, 0::bigint as errors
from lineitem group by l_orderkey""")
def ev_test_reports(spark, sf_dir):
    """A report for each order: a test a line, returned ones failed, others skipped; the suite's own count of failures differs."""
    case = F.format_string('<testcase name="%d">%s</testcase>', "l_linenumber", F.when(F.col("l_returnflag") == "R", "<failure/>").when(F.col("l_returnflag") == "N", "<skipped/>").otherwise(""))
    by = t(spark, sf_dir, "lineitem").withColumn("case", case).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("case")), "").alias("cases"))
    text = F.format_string('<testsuites><testsuite failures="%d">%s</testsuite></testsuites>', F.col("l_orderkey") % 4, "cases")
    return evidence.test_reports(by.select(F.concat(F.lit("o"), "l_orderkey").alias("path"), text.alias("text")))


@query("""
with e as (select event_id as ts, event_type as repo, event_id % 3 as rejects, user_id % 2 = 0 as ctx from events)
select count(*) filter (not ctx) as blocks, coalesce(sum(rejects) filter (not ctx), 0)::bigint as broken, count(*) filter (ctx) as context_requests, coalesce(sum(10) filter (ctx), 0)::bigint as context_bytes, min(ts) as first, max(ts) as last from e""")
def agg_ledger_report(spark, sf_dir):
    """Events as JSON lines, with lines that are none between them, read and summed."""
    e = t(spark, sf_dir, "events")
    text = F.format_string('{"ts": %d, "repo": "%s", "surface": "cli", "rejects": %d, "oracles": ["env"], "event": %s, "bytes": 10}', "event_id", "event_type", F.col("event_id") % 3, F.when(F.col("user_id") % 2 == 0, '"context"').otherwise("null"))
    lines = e.select(text.alias("value")).unionByName(e.select(F.lit("{not json").alias("value"))).unionByName(e.select(F.lit("[1]").alias("value")))
    return evidence.ledger_summary(evidence.read_ledger(lines)).select("blocks", "broken", "context_requests", "context_bytes", "first", "last")


@query(f"select count(*) filter (level = 'reject') as rejects, array_to_string(array_sort(list(distinct oracle) filter (level = 'reject')), ',') as oracles, least(20, count(distinct file) filter (level = 'reject')) as n from ({FINDINGS})")
def snk_blocked_event(spark, sf_dir):
    row = evidence.blocked_event(gate_change(spark, sf_dir), "r", "cli", "diff", 5)
    return row.select(F.from_json("value", "rejects long, oracles array<string>, files array<string>").alias("e")).select("e.rejects", F.array_join("e.oracles", ",").alias("oracles"), F.size("e.files").cast("long").alias("n"))


@query("select event_id, event_type from events order by event_id desc limit 250")
def win_ledger_last(spark, sf_dir):
    return evidence.last_events(t(spark, sf_dir, "events"), "event_id", 250).select("event_id", "event_type")


# a table of cases, joined with what is asked: module, distribution that provides it
CASES = [("dotenv", "python-dotenv"), ("google.protobuf", "protobuf"), ("PIL.Image", "pillow"), ("cv2", "opencv-python-headless"), ("jwt", "PyJWT"), ("azure.identity", "azure_identity"), ("win32con", "pywin32"), ("git", "GitPython"), ("requests", "requests"), ("nothing_like_it", "zzz")]


@query(f"""
with c(module, dist) as (values {', '.join(map(str, CASES))})
select c.module as subject, case when c.dist = 'zzz' or p.p_partkey % 2 = 1 then 'reject' else 'accept' end as level, count(*) as n from c cross join part p group by 1, 2""")
def jn_import_aliases(spark, sf_dir):
    """Modules under other names in many projects: locked in every second one (a distribution of each case), absent in the others."""
    cases = spark.createDataFrame(CASES, "subject string, dist string")
    out = None
    for odd in (0, 1):
        names = cases.where("dist <> 'zzz'").select("dist") if not odd else spark.createDataFrame([("other",)], "dist string")
        none = spark.createDataFrame([], "name string, dist string")
        graded = imports.check_python_imports(cases.select("subject", F.lit(False).alias("optional")), names.withColumn("kind", F.lit("lockfile")), none.select("name"), none, none.select("name"))
        rows = graded.join(F.broadcast(t(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == odd).agg(F.count("*").cast("long").alias("n"))), F.lit(True)).select("subject", "level", "n")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("subject", "level").agg(F.sum("n").alias("n"))


@query("select 'p' || p_partkey as file, line::bigint as line, subject from part, (values (1, 'os'), (1, 'sys'), (2, 'a.b'), (4, 'late.mod'), (5, '<dynamic>')) v(line, subject)")
def ext_broken_python_imports(spark, sf_dir):
    """Imports of Python that does not parse, line by line."""
    text = F.lit("import os, sys as s\nfrom a.b import c\n# import not_this\nx = importlib.import_module('late.mod')\ny = __import__(name)\ndef broken(:\n")
    rows = spread(t(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.format_string("p%d.py", "p_partkey").alias("path"), text.alias("text"))
    return files.python_facts(rows).where("tag = 'import'").select(F.regexp_replace("path", r"\.py$", "").alias("file"), "line", F.col("name").alias("subject"))


@query("""
select 'svc/c' || c_custkey || '.py' as file, name, source from customer, lateral (values
    ('X' || c_custkey || '_URL', 'settings_class'), ('x' || c_custkey || '_url', 'settings_class'), ('SET_' || c_custkey, 'code_assign'), ('KEPT_' || c_custkey, 'code_default'), ('GOT_' || c_custkey, 'code_default')) v(name, source)
union all select 'web/c' || c_custkey || '.ts', 'JS_' || c_custkey, 'code_default' from customer""")
def src_code_declarations(spark, sf_dir):
    """Names that code declares: settings fields under their prefix, assignments, defaults of Python and of scripts."""
    c = spread(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    text = F.expr("""concat('class S(BaseSettings):\\n    model_config = SettingsConfigDict(env_prefix="x', k, '_")\\n    url: str\\n    _hidden = 1\\n\\n\\nos.environ["SET_', k, '"] = "1"\\nos.environ.setdefault("KEPT_', k, '", "1")\\nos.getenv("GOT_', k, '", "d")\\nos.getenv("READ_', k, '")\\n')""")
    script = F.expr("concat('const a = process.env.JS_', k, ' ?? 1;\\nconst b = process.env.OTHER_', k, ';\\n')")
    tree = c.select(F.expr("concat('svc/c', k, '.py')").alias("path"), text.alias("text")).unionByName(c.select(F.expr("concat('web/c', k, '.ts')").alias("path"), script.alias("text")))
    return files.declared_env(tree)


@query("""
select p_partkey, name, ambient from part, lateral (values ('CI', true), ('PORT', true), ('JAVA_HOME', true), ('AWS_REGION', true), ('XDG_' || p_size, true), ('GITHUB_' || p_size, true), ('CI_' || p_size, false), ('npm_package_name', true), ('NPM_PACKAGE_NAME', false), ('PATHS', false)) v(name, ambient)""")
def flt_ambient_names(spark, sf_dir):
    names = F.array(*map(F.lit, ("CI", "PORT", "JAVA_HOME", "AWS_REGION", "npm_package_name", "NPM_PACKAGE_NAME", "PATHS")), *(F.concat(F.lit(x), "p_size") for x in ("XDG_", "GITHUB_", "CI_")))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.explode(names).alias("name"))
    return rows.withColumn("ambient", files.is_ambient(F.col("name")))


@query("""
select p_partkey, path, docs, audited from part, lateral (values ('docs/a.py', true, true), ('src/docs.py', false, true), ('a/Snippets/b.ts', true, true), ('a/b.md', false, false), ('examples-docs/x/y.go', true, true), ('lib/big.rs', false, false)) v(path, docs, audited)""")
def ext_docs_paths(spark, sf_dir):
    """Which paths are documentation, and which an audit would read."""
    paths = F.array(*map(F.lit, ("docs/a.py", "src/docs.py", "a/Snippets/b.ts", "a/b.md", "examples-docs/x/y.go", "lib/big.rs")))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.explode(paths).alias("path"))
    texts = rows.select("path").distinct().withColumn("text", F.when(F.col("path") == "lib/big.rs", F.repeat(F.lit("x"), 2_000_001)).otherwise("x"))
    read = index.select_files(texts).select("path", F.lit(True).alias("audited"))
    return rows.withColumn("docs", files.in_docs(F.col("path"))).join(read, "path", "left").withColumn("audited", F.coalesce("audited", F.lit(False)))


@query()
def gr_close_matches(spark, sf_dir):
    """Similar names of parts for the names of nations; tests hold it against the plain library."""
    refs = t(spark, sf_dir, "nation").select(F.col("n_name").alias("ref"))
    return graph.close_matches(refs, t(spark, sf_dir, "customer").select(F.col("c_name").alias("node")).unionByName(t(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("x")).alias("node"))))


@query(f"""
with e as (select 'symbol:' || file || ':load' as a, 'env:' || env as b from {SERVICES} where region <> 4), root as (select min(a) as a from e)
select a as node, 0::bigint as hop from root union all select b, 1 from e join root using (a) union all select a, 2 from e where b in (select b from e join root using (a)) and a <> (select a from root)""")
def gr_around(spark, sf_dir):
    """What one function reads, and what else reads it: two hops in the context graph."""
    edges = saved(graph.context_edges(service_tree(spark, sf_dir)).where("relation = 'reads_env'"), "edges")
    near, _ = graph.around(edges, edges.agg(F.min("a").alias("node")), 2)
    return near.select("node", F.col("hop").cast("long").alias("hop"))


FAR = "translate(md5(n_name), '0123456789', 'ghijklmnop')"
FAR_SERVICES = f"(select 'svc/s' || s_suppkey || '.py' as file, n_regionkey as region from supplier join nation on s_nationkey = n_nationkey)"
RUN = f"""
select 'env_vars' as oracle, count(*) as n from {FAR_SERVICES} where region <> 4
union all select 'imports_lockfile', count(*) from {FAR_SERVICES} where region <= 2
union all select 'routes', count(*) from {FAR_SERVICES}"""


def far_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module a supplier, whose names stand so far apart that no single slip makes one of another."""
    nation = t(spark, sf_dir, "nation").withColumn("far", F.expr(FAR))

    def listing(path, where, line):
        return nation.where(where).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")).select(F.lit(path).alias("path"), "text")

    names = listing(".env.example", "n_regionkey <> 4", F.concat(F.upper("far"), F.lit("=")))
    locks = listing("requirements.txt", "n_regionkey <= 2", F.concat(F.lit("lib"), "far", F.lit("==1.0")))
    code = spread(t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.format_string(
        'import os\nfrom lib%s import thing\n\n\ndef handle():\n    return os.environ["%s"], os.getenv("OTHER", "1")\n\n\ndef setup(app):\n    app.add_api_route(\n        "/handle",\n        handle,\n    )\n',
        "far", F.upper("far"),
    )
    return sized(names.unionByName(locks).unionByName(code.select(F.format_string("svc/s%d.py", "s_suppkey").alias("path"), text.alias("text"))), "tree")


@query(f"select oracle, least(n, 25) as total, least(n, 25) as detected, least(n, 25) as blocked, least(n, 25) as suggested, 0::bigint as misses from ({RUN}) where n > 0")
def orc_mutation_run(spark, sf_dir):
    """Accepted references misspelt, 25 an oracle, each checked in a copy of its file; every one is caught and put right."""
    return mutation.tally(mutation.mutations(far_tree(spark, sf_dir), count=25))


@query("""
with e as (select doc_id, case when position('a' in text) > 0 then overlay_at(text) else text end as x from documents)
select doc_id, sha256(replace(x, 'e', '33') || chr(10) || '# end') as edited_sha from e""".replace("overlay_at(text)", "substr(text, 1, position('a' in text) - 1) || '[A]' || substr(text, position('a' in text) + 1)"))
def fn_edited_documents(spark, sf_dir):
    """Four edits of every document in order: the first a, every e, nothing that occurs, and a line at the end."""
    edits = F.array(*(F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit(every).alias("all")) for old, new, every in (("a", "[A]", False), ("e", "33", True), ("\0none\0", "x", False), ("", "\n# end", False))))
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(texts.edited(F.col("text"), edits), 256).alias("edited_sha"))


@query("""
select p_partkey, tag from part, lateral (values
    (p_size % 5 <> 0, 'python'), (p_size % 5 = 1, 'fastapi'), (p_size % 5 = 2, 'django'), (p_size % 4 = 0, 'node'), (p_size % 4 = 0, 'nextjs'), (p_size % 3 = 0, 'go')) v(has, tag) where has""")
def src_detect_stack(spark, sf_dir):
    """A small tree for each part: languages and frameworks at its root; names within longer words and files below do not count."""
    size = F.col("p_size")
    listed = F.when(size % 5 == 1, "FastAPI[all]==1\n").when(size % 5 == 2, "django>=4\nroutes_fastapi\n").when(size % 5 != 0, "flask-cors\n")
    file = lambda path, text: F.when(text.isNotNull(), F.struct(F.lit(path).alias("path"), text.alias("text")))
    there = F.array(file("requirements.txt", listed), file("package.json", F.when(size % 4 == 0, '{"dependencies": {"next": "1", "express-x": "1"}}')), file("go.mod", F.when(size % 3 == 0, "module x")), file("sub/Cargo.toml", F.lit("")))
    tree = t(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(there, lambda x: x.isNotNull())).alias("f")).select("p_partkey", "f.*")
    return stack.detect_stack(tree, ["p_partkey"])


@query("select doc_id as id, lang, 'seen ' || quality as evidence, case when quality is not null then quality = 1 end as current from documents left join labels using (doc_id)")
def mem_beside_notes(spark, sf_dir):
    held = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    handoffs = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("seen "), "quality").alias("evidence"), F.col("quality").cast("string").alias("fingerprint"))
    return notes.beside_notes(held, handoffs, spark.createDataFrame([("1",)], "fingerprint string"))


@query("select row_number() over (order by array_position(['reject', 'review', 'accept'], level), file collate c, line, kind, ref, oracle) as place, file, line, kind, ref, level from (FINDINGS)".replace(" collate c", "").replace("FINDINGS", FINDINGS))
def win_gate_order(spark, sf_dir):
    """All findings of a change in one order: worst level first, then by file, line, kind, name and oracle."""
    worst = F.array_position(F.array(F.lit("reject"), F.lit("review"), F.lit("accept")), F.col("level"))
    rows = ordered(gate_change(spark, sf_dir).withColumn("worst", worst), ["worst", "file", "line", "kind", "ref", "oracle"])
    return rows.select("place", "file", "line", "kind", "ref", "level")


@query("select p_partkey, case when p_size % 3 = 0 then 'conf/names' when p_size % 2 = 0 then '.env.sample' when p_size % 5 = 0 then 'env.example' else '.env.example' end as file from part")
def src_where_to_declare(spark, sf_dir):
    """A small tree for each part, with some of the files that may declare names; one configured, one below the root."""
    size = F.col("p_size")
    there = F.array(F.lit("sub/.env.example"), F.when(size % 5 == 0, "env.example"), F.when(size % 2 == 0, ".env.sample"), F.when(size % 3 == 0, "conf/names"))
    tree = t(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(there, lambda x: x.isNotNull())).alias("path"))
    return files.where_to_declare(tree, ("p_partkey",), ("conf/names",))
