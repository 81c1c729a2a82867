"""Queries over projects, kept indexes, evidence, recall and budgets, on trees and notes made from the tables; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import change, claims, index, payload, recall, sync
from ..operators.store import Store
from ..runtime import fresh_path, sized, spread
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(path: str, text: str, where: str = "true") -> F.Column:
    """A file of each row, both as SQL expressions, where a condition holds."""
    return F.when(F.expr(where), F.struct(F.expr(path).alias("path"), F.expr(text).alias("text")))


def _tree(rows: DataFrame, *made: F.Column) -> DataFrame:
    return rows.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f")).select("f.*")


MAIN = r"""concat('import app', k, '.core\nimport util', k, '\nimport blog', k, '\nimport requests\nimport ghost', k, '\nimport extra', k, '\nimport here', k, '\n')"""


def monorepo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a project a supplier, with packages beside its lockfile, under `src`, in a folder that packaging declares, and deeper."""
    k = spread(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")), "k")
    at = "concat('services/s', k, '/"
    return _tree(
        k, _file(at + "requirements.txt')", r"'requests==2.0\n'"), _file(at + "app', k, '/__init__.py')", "''"), _file(at + "app', k, '/main.py')", MAIN), _file(at + "src/util', k, '.py')", "''"), _file(at + "apps/blog', k, '/__init__.py')", "''"),
        _file(at + "pyproject.toml')", r"""'[tool.setuptools.package-dir]\n"" = "python"\n'""", "k % 3 = 0"), _file(at + "python/extra', k, '.py')", "''"),
    )


@query("""
select 'services/s' || s_suppkey || '/app' || s_suppkey || '/main.py' as file, line::bigint as line, subject, level, reason from supplier, lateral (values
    (1, 'app' || s_suppkey || '.core', 'accept', 'own package'), (2, 'util' || s_suppkey, 'accept', 'own package'), (3, 'blog' || s_suppkey, 'review', 'nested'), (4, 'requests', 'accept', 'provided'),
    (5, 'ghost' || s_suppkey, 'reject', 'absent'),
    (6, 'extra' || s_suppkey, case when s_suppkey % 3 = 0 then 'accept' else 'reject' end, case when s_suppkey % 3 = 0 then 'own package' else 'absent' end),
    (7, 'here' || s_suppkey, case when s_suppkey % 2 = 0 then 'review' else 'reject' end, case when s_suppkey % 2 = 0 then 'installed only' else 'absent' end)) v(line, subject, level, reason)""")
def gate_monorepo(spark, sf_dir):
    """Imports of every project of a monorepo: of its own packages wherever its manifests let them lie, of nested, installed and absent ones."""
    tree = monorepo(spark, sf_dir)
    here = t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.lit("python").alias("lang"), F.concat(F.lit("here"), "s_suppkey").alias("name"), F.lit("another").alias("dist"))
    found = change.check_change(files.region_lines(tree.where("path like '%/main.py'")), tree, change.Index(tree, here))
    return found.select("file", "line", "subject", "level", "reason")


@query("""
select 'services/s' || s_suppkey || '/app' || s_suppkey || '/web.py' as file, line::bigint as line, ref, level, reason from supplier, lateral (values
    (2, 'handle', case when s_suppkey % 2 = 0 then 'accept' else 'review' end, case when s_suppkey % 2 = 0 then 'bound in its module' else 'outside the tree' end),
    (3, 'missing', case when s_suppkey % 2 = 0 then 'reject' else 'review' end, case when s_suppkey % 2 = 0 then 'its module does not bind it' else 'outside the tree' end)) v(line, ref, level, reason)""")
def gate_nested_routes(spark, sf_dir):
    """Handlers that a service imports from its own package: found where a manifest makes its folder a project."""
    k = spread(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")), "k")
    at = "concat('services/s', k, '/"
    web = r"""concat('from app', k, '.handlers import handle, missing\napp.add_api_route("/a", handle)\napp.add_api_route("/b", missing)\n')"""
    tree = _tree(k, _file(at + "setup.py')", "''", "k % 2 = 0"), _file(at + "app', k, '/handlers.py')", r"'def handle():\n    pass\n'"), _file(at + "app', k, '/web.py')", web))
    found = change.check_change(files.region_lines(tree.where("path like '%/web.py'")), tree).where("oracle = 'routes'")
    return found.select("file", "line", F.col("ref"), "level", "reason")


EDITED = r"""concat('import os\n\n\ndef load():\n    return os.environ["NAME_', k % 7, '"]\n', if(k % 5 = 0 and {later}, '\n\ndef more():\n    pass\n', ''))"""


def _growing(spark, sf_dir, later: bool) -> DataFrame:
    """A module a customer; later, every fifth has one more function, every seventh is gone, and one name is declared no more."""
    k = spread(t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")), "k")
    code = _tree(k, _file("concat('m/c', k, '.py')", EDITED.format(later=str(later).lower()), "k % 7 <> 0" if later else "true"))
    names = k.where("k < 7" if not later else "k < 6").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("NAME_"), "k", F.lit("=")))), "\n").alias("text"))
    return code.unionByName(names.select(F.lit(".env.example").alias("path"), "text"))


@query("""
select 'symbol:m/c' || c_custkey || '.py:load' as node, 'm/c' || c_custkey || '.py' as file, 'symbol' as kind from customer where c_custkey % 7 <> 0
union all select 'symbol:m/c' || c_custkey || '.py:more', 'm/c' || c_custkey || '.py', 'symbol' from customer where c_custkey % 7 <> 0 and c_custkey % 5 = 0
union all select 'env:NAME_' || c_custkey, '.env.example', 'env' from customer where c_custkey < 6""")
def idx_kept_index(spark, sf_dir):
    """The nodes of an index that was built of one tree and brought up to another: those of the later tree, though only changed files were read."""
    store = Store(spark, fresh_path(spark, "store"))
    sync.synchronise(store, _growing(spark, sf_dir, False))
    later = _growing(spark, sf_dir, True)
    sync.synchronise(store, later)
    return index.snapshot(sync.open_index(store, later))


@query("""
with f as (select 'm/c' || c_custkey || '.py' as file, c_custkey % 7 = 0 as gone, c_custkey % 5 = 0 as grown from customer)
select 'file:' || file as node, 'changed' as op from f where gone or grown
union all select 'symbol:' || file || ':load', case when gone then 'removed' else 'changed' end from f where gone or grown
union all select 'symbol:' || file || ':more', 'added' from f where grown and not gone
union all select 'file:.env.example', 'changed' union all select 'env:NAME_6', 'removed' union all select 'env:NAME_' || c_custkey, 'changed' from customer where c_custkey < 6""")
def idx_kept_log(spark, sf_dir):
    """The change log of two synchronisations, of which the first builds and records nothing."""
    store = Store(spark, fresh_path(spark, "store"))
    for later in (False, True):
        sync.synchronise(store, _growing(spark, sf_dir, later))
    return store.read("changes").select("node", "op")


@query("""
select c_custkey, case when c_custkey % 7 = 0 then case when c_custkey % 2 = 0 then 'proven' else 'contradicted' end when c_custkey % 5 = 0 then 'not_observed'
    when c_custkey % 3 = 0 then 'contradicted' when c_custkey % 4 = 0 then 'not_observed' else 'proven' end as reason from customer""")
def hon_reports_and_runs(spark, sf_dir):
    """Claims that tests pass, a customer each, which name a report: with a failure, without tests, broken, or good; every seventh command was seen to run."""
    k = spread(t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")), "k")
    case = """concat('<testsuite>', if(k % 3 = 0, '<testcase name="a"><failure/></testcase>', if(k % 4 = 0, '', '<testcase name="b"/>')), '</testsuite>')"""
    tree = _tree(k, _file("concat('out/r', k, '.xml')", f"if(k % 5 = 0, '<testsuite', {case})"))
    asked = claims.claims_from_json(k.select("k", F.expr("""concat('[{"kind": "tests", "command": "make  c', k, '", "evidence": {"junit": "out/r', k, '.xml", "exit_code": 0}}]')""").alias("j")), "j")
    runs = k.where("k % 7 = 0").select(F.concat(F.lit("make c"), "k").alias("command"), (F.col("k") % 2).cast("int").alias("exit_code"))
    return change.check_claims(asked, tree, runs=runs).select(F.col("k").alias("c_custkey"), "reason")


@query("""
select 'web/p' || p_partkey || '.ts' as file, line::bigint as line, subject, case when p_size % 2 = 0 then 'accept' else 'reject' end as level
from part, lateral (values (3, 'READ_' || p_partkey), (4, 'TOLD_' || p_partkey)) v(line, subject)
union all select 'web/p' || p_partkey || '.rb', 1, 'READ_' || p_partkey, case when p_size % 2 = 0 then 'accept' else 'reject' end from part""")
def gate_masked_reads(spark, sf_dir):
    """Reads of the environment in scripts and Ruby, beside others that stand in comments of one line and of several."""
    k = spread(t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size"), "k")
    script = r"""concat('/* process.env.NOT_THIS\n process.env.NOR_THIS */\nconst a = process.env.READ_', k, ' // process.env.NOT_EITHER\nconst b = `${process.env.TOLD_', k, '} // text`\n')"""
    ruby = r"""concat('x = ENV["READ_', k, '"] # ENV["NOT_HERE"]\n')"""
    code = _tree(k, _file("concat('web/p', k, '.ts')", script), _file("concat('web/p', k, '.rb')", ruby))
    names = k.where("p_size % 2 = 0").select((F.col("k") / 1000).cast("long").alias("folder"), F.explode(F.array(F.concat(F.lit("READ_"), "k"), F.concat(F.lit("TOLD_"), "k"))).alias("name"))
    # a file for each thousand parts, so that no row holds all names
    names = names.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("=")))), "\n").alias("text"))
    tree = code.unionByName(names.select(F.concat(F.lit("names/"), "folder", F.lit("/.env.example")).alias("path"), "text")).unionByName(spark.createDataFrame([("Dockerfile", "ENV ALWAYS=1\n")], "path string, text string"))
    tree = sized(tree, "tree")
    return change.check_change(files.region_lines(tree.where("path like 'web/%'")), tree).select("file", "line", "subject", "level")


WORDS = r"regexp_extract_all({0}, '[\pL][\pL\pN\pM_]*')"
TERMS = r"list_distinct(list_transform(list_concat({w}, list_filter(flatten(list_transform({w}, lambda x: regexp_extract_all(regexp_replace(x, '([A-Z][a-z]+)', ' \1 ', 'g'), '[A-Z]?[a-z]+|[A-Z]+'))), lambda x: length(x) > 1)), lambda x: lower(x)))"


def _terms(text: str) -> str:
    return TERMS.format(w=WORDS.format(text))


NOTES = f"""
q as (select item_id, text from benchmark union all select -1, '  ' union all select -2, '!!'),
qw as (select item_id, unnest({_terms('text')}) as w from q),
d as (select doc_id, coalesce(source, '') || ' ' || coalesce(lang, '') as title, text, coalesce(l.quality = 0, false) as hidden from documents left join labels l using (doc_id)),
p as (select doc_id, hidden, unnest({_terms('title')}) as w, 2 as points from d union all select doc_id, hidden, unnest({_terms('text')}), 1 from d),
s as (select item_id, doc_id, hidden, sum(points) as score from qw join p using (w) group by all union all select -1, doc_id, hidden, 0 from d)"""


def _notebook(spark, sf_dir) -> tuple[recall.Notebook, DataFrame]:
    quality = t(spark, sf_dir, "labels").select("doc_id", "quality")
    notes = t(spark, sf_dir, "documents").join(quality, "doc_id", "left").select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("title"), F.col("text").alias("body"), F.when(F.col("quality") == 0, "stale").otherwise("anchored").alias("state"))
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query")).unionByName(spark.createDataFrame([(-1, "  "), (-2, "!!")], "query_id long, query string"))
    return recall.Notebook(notes), asked


@query(f"""
with {NOTES}, r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rk from s where not hidden)
select item_id, rk as rank, doc_id, score::bigint as score from r where rk <= 8""")
def mem_recall_notes(spark, sf_dir):
    """The first notes of each query, words of any case within names counted, stale notes left out; all notes for a blank query, none for one without words."""
    notes, asked = _notebook(spark, sf_dir)
    return notes.recall(asked, 8).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query(f"""
with {NOTES} select q.item_id, count(s.doc_id) filter (not hidden) as matches, count(s.doc_id) filter (hidden) as hidden_stale, greatest(count(s.doc_id) filter (not hidden) - 8, 0) as limit_omitted
from q left join s using (item_id) group by q.item_id""")
def mem_recall_matches(spark, sf_dir):
    """How many notes each query finds, how many stale ones it would, and how many the limit leaves out."""
    notes, asked = _notebook(spark, sf_dir)
    return notes.matches(asked, 8).withColumnRenamed("query_id", "item_id")


SETTLED = """fixed + strlen(b::varchar) + strlen(t::varchar) as b1, (b1 + 3) // 4 as t1, fixed + strlen(b1::varchar) + strlen(t1::varchar) as b2, (b2 + 3) // 4 as t2, fixed + strlen(b2::varchar) + strlen(t2::varchar) as b3, (b3 + 3) // 4 as t3, fixed + strlen(b3::varchar) + strlen(t3::varchar) as b4, (b4 + 3) // 4 as t4"""


@query(f"""
with recursive i as (select user_id as u, row_number() over (partition by user_id order by event_id) as rn, strlen('{{"id":' || event_id || ',"type":"' || event_type || repeat('é', event_id % 40) || '"}}') as size, count(*) over (partition by user_id) as n from events),
head as (select distinct u, n, strlen('{{"operation":"recall","query":"' || u || '"}}') + 1 + {len(payload.FIELDS)} + 4 as plain from i),
start as (select u, n, plain, 0::bigint as rn, 0::bigint as held, 0::bigint as taken, 0::bigint as b, 0::bigint as t, plain + strlen(n::varchar) as fixed from head),
f as (
    select u, n, plain, rn, held, taken, b4 as b, t4 as t, false as kept from (select *, {SETTLED} from start)
    union all
    select u, n, plain, rn, case when fits then held + size else held end, case when fits then taken + 1 else taken end, b4, t4, fits from (
        select *, {SETTLED}, b4 <= 1200 as fits from (
            select f.u, f.n, f.plain, i.rn, f.held, f.taken, f.b, f.t, i.size, f.plain + f.held + i.size + f.taken + strlen((f.n - f.taken - 1)::varchar) as fixed from f join i on i.u = f.u and i.rn = f.rn + 1))
),
last as (select *, plain + held + greatest(taken - 1, 0) + strlen((n - taken)::varchar) as fixed from f where rn = n)
select u as user_id, b4::bigint as bytes, t4::bigint as tokens, (n - taken)::bigint as omitted, (select list(rn order by rn) from f k where k.u = x.u and k.kept) as places from (select *, {SETTLED} from last) x""")
def win_payload_budget(spark, sf_dir):
    """The events of each user as items of a payload of 1200 bytes: which fit, and what the payload states of itself, to the byte."""
    e = t(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    items = e.select(F.col("user_id").alias("group"), order.alias("order"), F.expr("""concat('{"id":', event_id, ',"type":"', event_type, repeat('é', cast(event_id % 40 as int)), '"}')""").alias("text"))
    heads = e.select(F.col("user_id").alias("group")).distinct().withColumn("meta", F.expr("""concat('{"operation":"recall","query":"', group, '"}')"""))
    rows = payload.bounded(items, heads, 300)
    places = F.array_sort(F.collect_list(F.when(F.col("order").isNotNull() & F.col("kept"), F.col("order"))))
    state = {x: F.max(F.when(F.col("order").isNull(), F.col(x))).alias(x) for x in ("bytes", "tokens", "omitted")}
    return rows.groupBy("group").agg(*state.values(), places.alias("places")).select(F.col("group").cast("long").alias("user_id"), *state, "places")


ENDS = (("\f", "."), (" ", ","), ("\r", "z"), ("\x1d", "w"))


@query("""
select doc_id, i::bigint as lineno, md5(line) as line_md5 from (
    select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as i from (
        select doc_id, case when x = '' then [] when regexp_matches(x, '[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]$') then list_slice(raw, 1, len(raw) - 1) else raw end as parts from (
            select doc_id, x, regexp_split_to_array(x, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]') as raw from (
                select doc_id, translate(text, '.,zw', chr(12) || chr(8232) || chr(13) || chr(29)) as x from documents where text is not null))))""")
def src_all_line_ends(spark, sf_dir):
    """Lines of all documents with form feeds, separators and carriage returns among their line ends."""
    text = F.translate("text", "".join(x for _, x in ENDS), "".join(x for x, _ in ENDS))
    lines = files.region_lines(t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("text")))
    return lines.select(F.col("file").cast("long").alias("doc_id"), F.col("lineno").cast("long").alias("lineno"), F.md5("text").alias("line_md5"))

