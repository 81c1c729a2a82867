"""Queries over reports, policies, remembered notes and text functions; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import anchors, change, extract, relations, reports, sync
from ..operators.store import Store
from ..runtime import fresh_path, spread
from ..sources import files, settings
from .cases import services
from .composed import FINDINGS, SERVICES, gate_change, service_tree, t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"select oracle, count(*) as findings, count(*) filter (level = 'accept') as accept, 0::bigint as review, count(*) filter (level = 'reject') as reject, 0::bigint as unverifiable, count(distinct file) filter (level = 'reject') as files from ({FINDINGS}) group by oracle")
def agg_audit_report(spark, sf_dir):
    """All findings of all services by oracle and level, each counted once though it comes twice."""
    found = gate_change(spark, sf_dir)
    return reports.audit(found.unionByName(found))


@query(f"select '::error file=' || file || ',line=' || line || ',title=groundwire ' || oracle || '::' || kind || ' ' || ref || ': ' || reason as value from ({FINDINGS}) where level = 'reject'")
def snk_annotations(spark, sf_dir):
    return reports.annotations(gate_change(spark, sf_dir))


@query("select 'NAME_' || p_size as name, count(*) as n, list_slice(list_sort(list('p' || p_partkey || '/.env.example')), 1, 20) as sources from part group by p_size")
def agg_declared_where(spark, sf_dir):
    tree = t(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("/.env.example")).alias("path"), F.concat(F.lit("NAME_"), "p_size", F.lit("=\n")).alias("text"))
    return reports.declared_where(files.declared_env(tree))


@query("select 'python' as lang, replace(p_brand, '#', '-') as dist, count(*) as n, list_slice(list_sort(list('p' || p_partkey || '/requirements.txt')), 1, 20) as sources from part group by p_brand union all select 'node', 'left-pad', count(*), list_slice(list_sort(list('p' || p_partkey || '/package.json')), 1, 20) from part where p_size % 2 = 0 having count(*) > 0")
def agg_listed_where(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    python = p.select(F.concat(F.lit("p"), "p_partkey", F.lit("/requirements.txt")).alias("path"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("==1\n")).alias("text"))
    node = p.where("p_size % 2 = 0").select(F.concat(F.lit("p"), "p_partkey", F.lit("/package.json")).alias("path"), F.lit('{"dependencies": {"left-pad": "1"}}').alias("text"))
    return reports.listed_where(files.declared_dists(python.unionByName(node)))


@query("select 's' || s_suppkey as by, 's' || s_suppkey || '.app.main:app' as app from supplier")
def idx_find_apps(spark, sf_dir):
    facts = files.python_facts(services(spark, sf_dir).where("path like '%.py'"))
    return reports.find_apps(facts, F.substring_index("path", "/", 1))


@query(f"""
select "table", 1::bigint as version, rows from (values ('files', (select count(*) + 2 from supplier)), ('env', (select count(*) from nation where n_regionkey <> 4)), ('dists', (select count(distinct {{lib}}) from nation where n_regionkey <= 2)), ('routes', 0), ('projects', (select count(distinct {{lib}}) from nation where n_regionkey <= 2))) v("table", rows)""".replace("{lib}", "concat('lib', translate(lower(n_name), '_0123456789 ', 'xabcdefghij'))"))
def orc_status(spark, sf_dir):
    """Rows of the tables of a kept index; facts and own names are left to the queries that show them."""
    store = Store(spark, fresh_path(spark, "store"))
    sync.synchronise(store, service_tree(spark, sf_dir))
    return reports.status(store).where(~F.col("table").isin("facts", "names")).select("table", "version", "rows")


@query("""
select page_id, host, host in ('localhost', '127.0.0.1', '::1', '0.0.0.0', 'good.example') as allowed from (select page_id, nullif(regexp_replace(lower(regexp_extract(url, '^(?:[hH][tT][tT][pP][sS]?)://(?:[^@/?#]*@)?(\\[[^\\]/]+\\]|[^:/?#\\[\\]]+)', 1)), '^\\[|\\]$', '', 'g'), '') as host from (
    select page_id, case page_id % 5 when 0 then url when 1 then 'http://user:pw@LOCALHOST:80/x' when 2 then 'https://[::1]/' || page_id when 3 then 'ftp://localhost/' else 'http://Good.example?q=' || page_id end as url from pages)) where host is not null
union all select page_id, null, false from pages where page_id % 5 = 3""")
def flt_allowed_hosts(spark, sf_dir):
    """Addresses of pages, and others with users, ports, brackets, capitals and another scheme."""
    k = F.col("page_id")
    url = F.when(k % 5 == 0, F.col("url")).when(k % 5 == 1, "http://user:pw@LOCALHOST:80/x").when(k % 5 == 2, F.concat(F.lit("https://[::1]/"), k)).when(k % 5 == 3, "ftp://localhost/").otherwise(F.concat(F.lit("http://Good.example?q="), k))
    rows = t(spark, sf_dir, "pages").withColumn("url", url)
    return rows.select("page_id", policy.url_host(F.col("url")).alias("host"), policy.allowed_host(F.col("url"), ("Good.example",)).alias("allowed"))


@query("select c_custkey, c_custkey % 4 in (0, 1) as allowed from customer")
def flt_allowed_commands(spark, sf_dir):
    k = F.col("c_custkey")
    command = F.when(k % 4 == 0, "make  test").when(k % 4 == 1, F.concat(F.lit(" make test -k "), k)).when(k % 4 == 2, "make tests").otherwise("rm test")
    return t(spark, sf_dir, "customer").select("c_custkey", policy.allowed_command(command, ("make test", "tox")).alias("allowed"))


@query(f"""
with d as (select s.file, n, 'note ' || n as title, 'text ' || n as body, case when n % 3 = 0 then 'gone/' || n || '.py' else s.file end as cited from (select file, cast(regexp_extract(file, '[0-9]+') as bigint) as n from {SERVICES}) s)
select left(sha256('["' || title || '","' || body || '","note",["' || cited || '"]]'), 20) as id, title, n % 3 <> 0 as stored, case when n % 3 <> 0 then 1 else 0 end::bigint as anchors from d""")
def mem_remember(spark, sf_dir):
    """A note about each service, given twice, of which every third cites a file that is not there and is refused."""
    k = F.col("s_suppkey").cast("long")
    s = t(spark, sf_dir, "supplier").select(F.concat(F.lit("note "), k).alias("title"), F.concat(F.lit(" text "), k).alias("text"), F.lit("note").alias("kind"), F.lit(5).cast("long").alias("created"), F.array(F.when(k % 3 == 0, F.concat(F.lit("gone/"), k, F.lit(".py"))).otherwise(F.concat(F.lit("svc/s"), k, F.lit(".py")))).alias("files"))
    stored, made = anchors.remember(s.unionByName(s), change.Index(service_tree(spark, sf_dir)))
    held = made.groupBy("id").agg(F.count("*").alias("anchors"))
    return stored.join(held, "id", "left").select("id", "title", "stored", F.coalesce("anchors", F.lit(0)).alias("anchors"))


@query(f"select file as id, 'env' as kind, env as value, false as declared, 'valid' as state from {SERVICES} where region <> 4 union all select file, 'file', file, true, 'valid' from {SERVICES}")
def mem_prose_anchors(spark, sf_dir):
    """Notes that declare their file, and name in prose a variable (kept if it is declared), a missing one and a path that is not there (dropped)."""
    s = t(spark, sf_dir, "supplier").select(F.concat(F.lit("svc/s"), "s_suppkey", F.lit(".py")).alias("id"), F.concat(F.lit("It reads NATION_"), "s_nationkey", F.lit(" and NATION_X"), "s_suppkey", F.lit(", see no/such/file.py")).alias("body"))
    prose = extract.prose_claims(s, "id", "body").withColumnRenamed("subject", "value")
    made = anchors.anchors(s.select("id", F.lit("file").alias("kind"), F.col("id").alias("value")), prose, change.Index(service_tree(spark, sf_dir)))
    return made.select("id", "kind", "value", "declared", "state")


@query("""
with l as (select user_id as g, event_type as item, min(struct_pack(a := event_id % 3, b := event_id)) as first from events group by 1, 2)
select user_id, rank, item from (select g as user_id, item, row_number() over (partition by g order by first.a, first.b, item) as rank from l) where rank <= 2""")
def set_first_positions(spark, sf_dir):
    """The kinds of events of each user in the order in which they first come, over three lists, two of each."""
    e = t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("list"), "event_id", F.col("event_type").alias("item"))
    return relations.first_positions(e, ["user_id"], "item", ["list", "event_id"], 2).withColumn("rank", F.col("rank").cast("long"))


@query("""
select 'r' || c_custkey as repo, key, value, layer from customer, lateral (values
    ('block_on', case when c_custkey % 3 = 0 then '"never"' when c_custkey % 2 = 0 then '"review"' else '"reject"' end, case when c_custkey % 3 = 0 then 'repo' when c_custkey % 2 = 0 then 'user' else 'default' end),
    ('exclude', case when c_custkey % 3 = 0 then '["gen' || c_custkey || '", "out"]' else '[]' end, case when c_custkey % 3 = 0 then 'repo' else 'default' end),
    ('stack', case when c_custkey % 2 = 0 then '["go"]' else '[]' end, case when c_custkey % 2 = 0 then 'user' else 'default' end),
    ('env_declared_in', '[]', 'default'), ('oracles', '["env_vars", "imports_lockfile", "routes"]', 'default')) v(key, value, layer)""")
def src_merged_settings(spark, sf_dir):
    """Settings of a repository a customer, from a user's file for every second and its own for every third."""
    k = t(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("repo"), F.col("c_custkey").alias("k"))
    user = k.where("k % 2 = 0").select("repo", F.lit("user").alias("layer"), F.lit("g.toml").alias("path"), F.lit('block_on = "Review"\nstack = "go"\n').alias("text"))
    own = k.where("k % 3 = 0").select("repo", F.lit("repo").alias("layer"), F.lit(".g.json").alias("path"), F.concat(F.lit('{"groundwire": {"block_on": "never", "exclude": ["gen'), "k", F.lit('", " out "]}}')).alias("text"))
    merged = settings.merged_settings(settings.read_settings(user.unionByName(own)), k.select("repo"))
    return merged.where("error is null").select("repo", "key", "value", "layer")


CAMEL = r"list_sort(list_distinct(list_transform(list_concat({w}, list_filter(flatten(list_transform({w}, lambda x: regexp_extract_all(regexp_replace(x, '([A-Z][a-z]+)', ' \1 ', 'g'), '[A-Z]?[a-z]+|[A-Z]+'))), lambda x: length(x) > 1)), lambda x: lower(x))))".format(w=r"regexp_extract_all(text, '[\pL][\pL\pN\pM_]*')")


@query(f"select doc_id, sha256(array_to_string({CAMEL}, ' ')) as terms_sha, (strlen(text) + 3) // 4 as tokens, right(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), 300) as tail, replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') as escaped from documents")
def fn_texts_of_documents(spark, sf_dir):
    """Words with their camel-case parts, token estimates, the last characters and escaped texts of all documents."""
    x = F.col("text")
    # a file of many texts may be one split
    held = spread(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return held.select("doc_id", F.sha2(F.array_join(text.terms(x), " "), 256).alias("terms_sha"), text.estimated_tokens(x).alias("tokens"), text.tail(x).alias("tail"), text.escaped(x).alias("escaped"))
