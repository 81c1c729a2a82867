"""Cases of parsing, grading and checking, given to every supplier of the table: each has a service, lines and claims of its own.

Paths, routes and keys carry the supplier's number, and SQL makes the expected rows from the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders, text
from ..operators import change, claims, extract, health, imports, routes
from ..runtime import sized, spread
from ..sources import aliases, files, sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def each(values: str, *, file: str | None = None, key: str | None = None) -> str:
    """SQL: all rows of `values` for every supplier; a file's path lies below the supplier, a key has its number before it."""
    if file:
        return f"select v.* replace ('s' || s_suppkey || '/' || {file} as {file}) from supplier, ({values}) v"
    if key:
        return f"select v.* replace (cast(s_suppkey * 10 + {key} as bigint) as {key}) from supplier, ({values}) v"
    return f"select cast(s_suppkey as bigint) as k, v.* from supplier, ({values}) v"


def suppliers(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """k, the supplier's number, and each of the rows."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    made = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields))) for row in rows))
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    return spread(keys, "k").select("k", F.explode(made).alias("v")).select("k", "v.*")


def below(name: str = "path") -> F.Column:
    return F.concat(F.lit("s"), "k", F.lit("/"), name).alias(name)


def services(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """(path, text): the sample service of every supplier, with routes that carry its number; written, as a tree is read many times."""
    tree = suppliers(spark, sf_dir, list((sample.CLEAN | (sample.BROKEN if broken else {})).items()), "path string, text string")
    own = F.col("text")
    for route in ("/api", "/health", "/metrics"):
        own = F.replace(own, F.lit(f'"{route}"'), F.concat(F.lit(f'"{route}'), "k", F.lit('"')))
    return sized(tree.select(below(), own.alias("text")), "services")


@query(each("select * from (values (0, 'proven'), (1, 'contradicted'), (2, 'plausible'), (3, 'contradicted'), (4, 'contradicted'), (5, 'plausible'), (6, 'not_observed'), (7, 'not_observed')) v(i, honesty)"))
def hon_grade_tests(spark, sf_dir):
    rows = [(0, True, 3, 0, 0, 1, ""), (1, True, 3, 1, 0, 0, ""), (2, False, None, None, None, 0, "1 failed"), (3, False, None, None, None, 2, "3 passed"), (4, False, None, None, None, None, "3 passed, 1 error"), (5, False, None, None, None, None, "3 passed"), (6, False, None, None, None, None, ""), (7, True, 0, 0, 0, 0, "")]
    names = ("has_report", "tests", "failures", "errors", "exit_code", "output")
    df = suppliers(spark, sf_dir, rows, "i int, has_report boolean, tests int, failures int, errors int, exit_code int, output string")
    return df.select("k", "i", ladders.tests_honesty(*map(F.col, names)).alias("honesty"))


@query(each("select * from (values (0, 'proven', 'accept'), (1, 'contradicted', 'reject'), (2, 'plausible', 'review'), (3, 'contradicted', 'reject'), (4, 'not_observed', 'review')) v(i, honesty, level)"))
def hon_grade_endpoint(spark, sf_dir):
    df = suppliers(spark, sf_dir, [(0, 200, 200, None), (1, 200, 500, 200), (2, 200, None, 200), (3, 200, None, 404), (4, 200, None, None)], "i int, wanted int, probed int, reported int")
    got = ladders.endpoint_honesty(F.col("wanted"), F.col("probed"), F.col("reported"))
    return df.select("k", "i", got.alias("honesty"), ladders.honesty_level(got).alias("level"))


@query(each("select * from (values (0, 'contradicted'), (1, 'plausible'), (2, 'not_observed')) v(i, honesty)"))
def hon_grade_bug(spark, sf_dir):
    df = suppliers(spark, sf_dir, [(0, "KeyError", "KeyError: x", "KeyError: y"), (1, "KeyError", "KeyError: x", "ok"), (2, "KeyError", "other", "ok")], "i int, signature string, b string, a string")
    return df.select("k", "i", ladders.bug_honesty(F.col("signature"), F.col("b"), F.col("a")).alias("honesty"))


@query(each("select * from (values ('.env.example', 'DATABASE_URL', 'dotenv'), ('.env.example', 'API_KEY', 'dotenv'), ('.env.example', 'REDIS_URL', 'dotenv'), ('.env.example', 'SMTP_HOST', 'dotenv'), ('Dockerfile', 'WORKERS', 'dockerfile'), ('Dockerfile', 'STAGE', 'dockerfile'), ('docker-compose.yml', 'QUEUE_URL', 'compose'), ('docker-compose.yml', 'CACHE_URL', 'compose'), ('app/config.py', 'LOG_LEVEL', 'code_default')) v(file, name, source)", file="file"))
def fx_env_decls(spark, sf_dir):
    return files.declared_env(services(spark, sf_dir))


@query(each("select * from (values ('requirements.txt', 'python', 'fastapi', 'lockfile'), ('requirements.txt', 'python', 'uvicorn', 'lockfile'), ('requirements.txt', 'python', 'requests', 'lockfile'), ('requirements.txt', 'python', 'PyYAML', 'lockfile'), ('requirements.txt', 'python', 'sqlalchemy', 'lockfile')) v(file, lang, dist, kind)", file="file"))
def fx_manifests(spark, sf_dir):
    return files.declared_dists(services(spark, sf_dir))


@query("""
select method, path as "full", handler, 's' || s_suppkey || '/' || file as file from supplier, lateral (values ('GET', '/api' || s_suppkey || '/users/{user_id}', 'get_user', 'app/users.py'), ('POST', '/api' || s_suppkey || '/users', 'create_user', 'app/users.py'), ('GET', '/health' || s_suppkey, 'health', 'app/main.py'), ('GET', '/', 'index', 'app/main.py'),
    ('GET', '/metrics' || s_suppkey, 'metrics', 'app/main.py'), ('HEAD', '/metrics' || s_suppkey, 'metrics', 'app/main.py'), ('POST', '/api' || s_suppkey || '/orders', 'create_order', 'app/orders.py'), ('GET', '/api' || s_suppkey || '/orders/{order_id}', 'get_order', 'app/orders.py')) v(method, path, handler, file)""")
def fx_route_table(spark, sf_dir):
    return routes.route_table(services(spark, sf_dir))


@query(each("select file, cast(lineno as bigint) as lineno, text from (values ('a.py', 2, 'two'), ('a.py', 3, 'four'), ('new.py', 1, 'renamed')) v(file, lineno, text)", file="file"))
def fx_diff_regions(spark, sf_dir):
    diff = F.lit(sample.DIFF)
    for name in ("a.py", "new.py", "old.py", "gone.py"):
        diff = F.regexp_replace(diff, F.lit(rf"\b([ab])/{name}"), F.concat(F.lit("$1/s"), "k", F.lit(f"/{name}")))
    return files.diff_regions(suppliers(spark, sf_dir, [(0,)], "i int").select(diff.alias("diff")))


@query("select 's' || s_suppkey || '/app/broken.py' as file, v.* from supplier, (values ('env_var', 'DATABSE_URL', 'DATABASE_URL'), ('import', 'requestz', 'requests'), ('route_handler', 'helth', 'health')) v(kind, ref, suggestion)")
def fx_gate_broken(spark, sf_dir):
    """Rejects of all services with their broken files, one of each kind, each with its first suggestion."""
    tree = services(spark, sf_dir, broken=True)
    held = change.Index(tree)
    found = change.check_change(files.region_lines(tree.where("path like '%.py'")), tree, held).where("level = 'reject'")
    found = sized(found, "found")  # used twice
    first = change.suggestions(found, held).where("rank = 1").select("kind", "ref", "file", F.col("candidate").alias("suggestion"))
    return found.select("kind", "ref", "file").join(first, ["kind", "ref", "file"], "left")


LINES = [
    ("a.py", 1, 'x = os.environ["A_ONE"] or os.getenv("A_TWO", "z")'),
    ("a.py", 2, "y = os.getenv(name)"),
    ("a.py", 3, '# os.getenv("NOT_READ")'),
    ("b.ts", 1, "const k = process.env.B_ONE ?? 'd'; import x from '@s/p/q'"),
    ("b.ts", 2, "import y from './local'; const z = require('left-pad/lib')"),
    ("b.ts", 3, "import fs from 'node:fs'"),
    ("c.go", 1, 'v := os.Getenv("C_ONE")'),
    ("d.rb", 1, "ENV.fetch('D_ONE', 'x')"),
]


def _lines(spark, sf_dir) -> DataFrame:
    return suppliers(spark, sf_dir, LINES, "file string, lineno long, text string").select(below("file"), "lineno", "text")


@query(each("select file, cast(lineno as bigint) as lineno, name, has_default, dynamic from (values ('a.py', 1, 'A_ONE', false, false), ('a.py', 1, 'A_TWO', true, false), ('a.py', 2, '<dynamic>', false, true), ('b.ts', 1, 'B_ONE', true, false), ('c.go', 1, 'C_ONE', false, false), ('d.rb', 1, 'D_ONE', true, false)) v(file, lineno, name, has_default, dynamic)", file="file"))
def fx_env_reads(spark, sf_dir):
    return extract.env_reads(_lines(spark, sf_dir))


@query(each("select file, cast(lineno as bigint) as lineno, subject, package from (values ('b.ts', 1, '@s/p/q', '@s/p'), ('b.ts', 2, 'left-pad/lib', 'left-pad'), ('b.ts', 3, 'node:fs', 'node:fs')) v(file, lineno, subject, package)", file="file"))
def fx_script_imports(spark, sf_dir):
    return extract.script_imports(_lines(spark, sf_dir))


@query(each("select i, kind, subject from (values (1, 'env', 'API_KEY'), (1, 'route', 'GET /users/{id}'), (1, 'file', 'app/main.py'), (2, 'import', 'requests'), (2, 'import', 'yaml')) v(i, kind, subject)", key="i"))
def fx_prose_claims(spark, sf_dir):
    notes = suppliers(spark, sf_dir, [(1, "Set API_KEY before GET /users/{id} in app/main.py."), (2, "We import requests and use `yaml` here")], "i long, x string")
    return extract.prose_claims(notes.select((F.col("k") * 10 + F.col("i")).alias("i"), "x"), "i", "x")


@query(each("select 'x.py' as file, * from (values ('os.path', 'accept', 'standard library'), ('app.x', 'accept', 'own package'), ('requests', 'accept', 'provided'), ('yaml', 'accept', 'provided under another name'), ('lockd', 'accept', 'installed and listed'), ('loose', 'review', 'installed only'), ('uvicorn_extra', 'reject', 'absent'), ('dotenv', 'accept', 'provided under another name'), ('maybe', 'review', 'optional'), ('inner', 'review', 'nested'), ('<dynamic>', 'review', 'dynamic'), ('requestz', 'reject', 'absent')) v(subject, level, reason)", file="file"))
def fx_import_findings(spark, sf_dir):
    asked = [("x.py", x, x == "maybe") for x in ("os.path", "app.x", "requests", "yaml", "lockd", "loose", "uvicorn_extra", "dotenv", "maybe", "inner", "<dynamic>", "requestz")]
    held = [("a.lock", "requests", "lockfile"), ("a.lock", "PyYAML", "lockfile"), ("b.txt", "uvicorn", "manifest"), ("b.txt", "python-dotenv", "manifest"), ("a.lock", "locked-dist", "lockfile")]
    names = lambda rows, schema: suppliers(spark, sf_dir, rows, schema).drop("k").distinct()
    rows = suppliers(spark, sf_dir, asked, "file string, subject string, optional boolean").select(below("file"), "subject", "optional")
    dists = suppliers(spark, sf_dir, held, "file string, dist string, kind string").select(below("file"), "dist", "kind")
    return imports.check_python_imports(rows, dists, names([("app",)], "name string"), names([("lockd", "locked_dist"), ("loose", "other")], "name string, dist string"), names([("inner",)], "name string"))


SCRIPT_TREE = {
    "package.json": '{"dependencies": {"react": "1", "next": "1", "@scope/one": "1"}}',
    "package-lock.json": '{"packages": {"node_modules/react": {}, "node_modules/@scope/one": {}}}',
    "web/package.json": '{"dependencies": {"vue": "1"}}',
    "tsconfig.json": '{"extends": "./base", /* note */ "compilerOptions": {"paths": {"@app/*": ["./app/*"], "exact": ["./x"],},}}',
    "base.json": '{"compilerOptions": {"baseUrl": "./lib"} // end\n}',
    "lib/util.ts": "",
    "lib/deep/a.ts": "",
    "src/parts/b.ts": "",
}


@query("""
select case when starts_with(file, 'web/') then 'web/s' || s_suppkey || '/b.ts' else 's' || s_suppkey || '/a.ts' end as file, subject, level, reason from supplier, (values ('a.ts', 'fs', 'accept', 'built in'), ('a.ts', 'node:fs/promises', 'accept', 'built in'), ('a.ts', 'react/jsx', 'accept', 'provided'), ('a.ts', '@app/x', 'accept', 'path alias'), ('a.ts', 'exact', 'accept', 'path alias'), ('a.ts', 'exactly', 'reject', 'absent'), ('a.ts', 'next/image', 'accept', 'provided'),
    ('a.ts', 'deep/a', 'accept', 'base folder'), ('a.ts', 'parts/b', 'review', 'folder of the tree'), ('a.ts', '@scope/two', 'review', 'same scope'), ('a.ts', 'reactt', 'reject', 'absent'), ('web/b.ts', 'reactt', 'review', 'no lockfile'), ('a.ts', 'maybe', 'review', 'optional'), ('a.ts', 'here', 'review', 'installed only'), ('a.ts', '<dynamic>', 'review', 'dynamic')) v(file, subject, level, reason)""")
def fx_script_findings(spark, sf_dir):
    """Imports of a script of every supplier, within one project; one more below a project without a lockfile."""
    tree = suppliers(spark, sf_dir, list(SCRIPT_TREE.items()), "path string, text string").drop("k").distinct()
    asked = [("a.ts", x) for x in ("fs", "node:fs/promises", "react/jsx", "@app/x", "exact", "exactly", "next/image", "deep/a", "parts/b", "@scope/two", "reactt", "maybe", "here", "<dynamic>")] + [("web/b.ts", "reactt")]
    rows = suppliers(spark, sf_dir, [(*x, x[1] == "maybe") for x in asked], "file string, subject string, optional boolean")
    own = F.when(F.col("file") == "a.ts", F.concat(F.lit("s"), "k", F.lit("/a.ts"))).otherwise(F.concat(F.lit("web/s"), "k", F.lit("/b.ts")))
    here = suppliers(spark, sf_dir, [("here",)], "name string").select("name").distinct()
    dists = files.declared_dists(tree).where("lang = 'node'")
    return imports.check_script_imports(rows.select(own.alias("file"), "subject", "optional"), dists, here.limit(0), aliases.script_aliases(tree), tree, here)


@query("select 's' || s_suppkey || '/tsconfig.json' as file, pattern, 's' || s_suppkey || '/' || base as base from supplier, (values ('@app/*', null), ('exact', null), (null, 'lib')) v(pattern, base)")
def fx_script_aliases(spark, sf_dir):
    return aliases.script_aliases(suppliers(spark, sf_dir, list(SCRIPT_TREE.items()), "path string, text string").select(below(), "text"))


@query("""
select replace(subject, '#', s_suppkey::varchar) as subject, handler, level, reason from supplier, (values ('GET /api#/users/{id}', null, 'accept', 'registered'), ('/health#/', null, 'accept', 'registered'), ('GET /health#', 'health', 'accept', 'registered'), ('GET /health#', 'other', 'reject', 'handled by another'), ('POST /health#', null, 'reject', 'absent'), ('GET /api#/users/7', null, 'reject', 'absent')) v(subject, handler, level, reason)""")
def fx_route_claims(spark, sf_dir):
    asked = suppliers(spark, sf_dir, [("GET /api#/users/{id}", None), ("/health#/", None), ("GET /health#", "mod.health"), ("GET /health#", "other"), ("POST /health#", None), ("GET /api#/users/7", None)], "subject string, handler string")
    own = F.replace("subject", F.lit("#"), F.col("k").cast("string")).alias("subject")
    return routes.check_route_claims(asked.select(own, "handler"), routes.resolved_routes(services(spark, sf_dir)))


CLAIM_TEXTS = [
    (1, '[{"kind": "env", "subject": "API_KEY", "line": 3}, {"kind": "route", "method": "post", "path": "/x", "hard": true}, {"kind": "tests", "command": "pytest"}, {"subject": "x"}, 5]'),
    (2, '{"claims": [{"kind": "package", "subject": "yaml", "source": "prose"}, {"kind": "import", "subject": "a", "hard": "yes"}, {"kind": "import", "subject": "a", "line": -1}, {"kind": "route"}]}'),
    (3, "not json"),
    (4, "{}"),
]


@query(each("select k, cast(coalesce(nth, -1) as bigint) as nth, kind, subject, hard, error from (values (1, 0, 'env_var', 'API_KEY', true, null), (1, 1, 'route_handler', 'POST /x', true, null), (1, 2, 'tests_pass', 'pytest', true, null), (1, 3, '', 'x', true, 'missing kind'), (1, 4, '', null, true, 'must be an object'), (2, 0, 'import', 'yaml', false, null), (2, 1, 'import', 'a', true, 'hard must be a boolean'), (2, 2, 'import', 'a', true, 'line and col must be nonnegative integers'), (2, 3, 'route_handler', null, true, 'a route needs a subject or a path'), (3, null, null, null, null, 'claims must be a list or an object with a list')) v(k, nth, kind, subject, hard, error)", key="k"))
def fx_json_claims(spark, sf_dir):
    rows = suppliers(spark, sf_dir, CLAIM_TEXTS, "i long, x string").select((F.col("k") * 10 + F.col("i")).alias("k"), "x")
    return claims.claims_from_json(rows, "x").select("k", F.coalesce("nth", F.lit(-1).cast("long")).alias("nth"), "kind", "subject", "hard", "error")


@query("""
select name, ok, detail from (select count(*) as n, min(s_suppkey::varchar || '/') as least from supplier), lateral (values ('files', true, 12 * n || ' files, 0 unreadable, ' || 7 * n || ' Python files with facts'), ('environment', true, '9 names: code_default 1, compose 2, dockerfile 2, dotenv 4'),
    ('dependencies', true, n || ' lockfiles, the first s' || least || 'requirements.txt; no manifests'), ('routes', null, 8 * n || ' routes, 0 unresolved')) v(name, ok, detail)""")
def fx_health(spark, sf_dir):
    return health.report(services(spark, sf_dir))


INLINE = ["-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "Authorization: Bearer abcdefghijklmnop==", 'api_key = "12345678"', "postgres://user:hunter2@db/x", "nothing here"]
OUTPUTS = ["12 passed, 1 failed", "3 passed", "2 errors in 0.1s", "no tests ran", "1 failed, 2 passed, 1 error"]
COUNTED = r"coalesce((select sum(cast(regexp_extract(m, '[0-9]+') as bigint)) from unnest(regexp_extract_all(x, '{0}')) u(m)), 0)::bigint"


def _values(rows: list[str]) -> str:
    quoted = ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in rows)
    return "(values " + ", ".join(f"({i}, {x} || ' ' || s_suppkey)" for i, x in enumerate(quoted)) + ") v(i, x)"


def scrub_cases(scrub_sql: str) -> str:
    return f"select s_suppkey::bigint as k, i, {scrub_sql} as clean from supplier, lateral {_values(INLINE)}"


def _numbered(spark, sf_dir, rows: list[str]) -> DataFrame:
    return suppliers(spark, sf_dir, list(enumerate(rows)), "i int, x string").withColumn("x", F.concat_ws(" ", "x", "k"))


def fn_scrub_inline(spark, sf_dir):
    return _numbered(spark, sf_dir, INLINE).select("k", "i", text.scrub(F.col("x")).alias("clean"))


@query(f"select s_suppkey::bigint as k, i, {COUNTED.format(r'\b[0-9]+ passed\b')} as passed, {COUNTED.format(r'\b[0-9]+ (?:failed|errors?)\b')} as failed from supplier, lateral {_values(OUTPUTS)}")
def fn_test_output_counts(spark, sf_dir):
    x = F.col("x")
    return _numbered(spark, sf_dir, OUTPUTS).select("k", "i", text.counted(x, ladders.PASSED).alias("passed"), text.counted(x, ladders.FAILED).alias("failed"))


@query("select 'r' || p_partkey || '/requirements.txt' as file, 'left' as dist, 'lockfile' as kind from part union all select 'r' || p_partkey || '/pyproject.toml', '', 'error' from part where p_partkey % 3 = 0 union all select 'r' || p_partkey || '/Pipfile', '', 'manifest' from part where p_partkey % 3 = 1")
def jn_corrupt_manifest(spark, sf_dir):
    """A lockfile of each part, alone, beside a manifest that cannot be read, or beside an empty one."""
    k = F.col("p_partkey")
    file = lambda name, body, where: F.when(where, F.struct(F.concat(F.lit("r"), k, F.lit(f"/{name}")).alias("path"), F.lit(body).alias("text")))
    there = F.array(file("requirements.txt", "left==1.0\n", F.lit(True)), file("pyproject.toml", "[project\n", k % 3 == 0), file("Pipfile", "", k % 3 == 1))
    tree = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.filter(there, lambda x: x.isNotNull())).alias("f")).select("f.*")
    return files.declared_dists(tree).select("file", "dist", "kind")
