"""All queries over the library's own operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders, policy, text
from ..operators import extract, notes, relations
from ..runtime import ordered
from ..sources import files
from . import cases, composed, gates, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return QUERIES | cases.QUERIES | composed.QUERIES | gates.QUERIES | reports.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | cases.SQL | composed.SQL | gates.SQL | reports.SQL


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n(column) -> F.Column:
    return F.count(column).cast("long")


PROSE_SQL = r"select d.doc_id, regexp_extract(x, '(?:import|from)[ \t\n\r\f\v]+([A-Za-z_][A-Za-z0-9_]*)', 1) as name from documents d, unnest(regexp_extract_all(d.text, '(?m)(?:^|[ \t\n\r\f\v`(])(?:import|from)[ \t\n\r\f\v]+[A-Za-z_][A-Za-z0-9_]*(?:[. \t\n\r\f\v`)]|$)')) u(x)"


def prose_imports(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.IMPORT), F.lit(1))).alias("name"))


@query(f"select doc_id, name, cast(count(*) as bigint) as uses from ({PROSE_SQL}) group by all")
def ext_prose_imports(spark, sf_dir):
    return prose_imports(spark, sf_dir).groupBy("doc_id", "name").agg(n("*").alias("uses"))


@query(f"""
with claims as ({PROSE_SQL}), vocabulary as (select distinct w as name from benchmark, unnest(regexp_extract_all(lower(text), '[a-z]+')) u(w)),
graded as (select c.doc_id, case when v.name is not null then 'accept' else 'review' end as level from claims c left join vocabulary v on lower(c.name) = v.name)
select doc_id, case when bool_or(level = 'review') then 'review' else 'accept' end as verdict, cast(count(*) as bigint) as claims,
cast(count(*) filter (level = 'accept') as bigint) as accepted from graded group by doc_id""")
def gate_documents(spark, sf_dir):
    """Import claims in prose against the benchmark's words: undeclared is a reject, capped since prose is soft."""
    words = t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("key"), F.lit("benchmark").alias("source"))
    claims = prose_imports(spark, sf_dir).withColumn("key", F.lower("name"))
    level = ladders.capped(F.when(F.col("declared_in").isNotNull(), "accept").otherwise("reject"), F.lit(False))
    graded = relations.check_references(claims, words, "key", "source").withColumn("level", level)
    return graded.groupBy("doc_id").agg(ladders.worst(F.col("level")).alias("verdict"), n("*").alias("claims"), F.count_if(F.col("level") == "accept").cast("long").alias("accepted"))


@query(r"""
select doc_id, cast(i as bigint) as lineno, md5(line) as line_md5 from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from (
    select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as lines from documents where text <> ''))""")
def src_region_lines(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return files.region_lines(docs).select(F.col("file").cast("long").alias("doc_id"), F.col("lineno").cast("long").alias("lineno"), F.md5("text").alias("line_md5"))


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) in ('localhost', '127.0.0.1', '::1', '[::1]', '0.0.0.0') as allowed from pages")
def flt_safe_urls(spark, sf_dir):
    url = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", policy.url_host(url).alias("host"), policy.allowed_host(url).alias("allowed"))


@query("""
with claims as (select l_orderkey, l_linenumber, case when l_partkey % 7 = 0 then l_partkey + 10000000 else l_partkey end as k from lineitem)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(k as bigint) as k from claims where k not in (select p_partkey from part)""")
def jn_reference_anti(spark, sf_dir):
    """References whose target is absent; every seventh is broken on purpose, since the tables have no orphans."""
    claims = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_partkey") % 7 == 0, F.col("l_partkey") + 10_000_000).otherwise(F.col("l_partkey")).cast("long").alias("k"))
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.lit("part").alias("source"))
    return relations.check_references(claims, parts, "k", "source").where("declared_in is null").select("l_orderkey", "l_linenumber", "k")


@query("""
with c as (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_returnflag, case when l_partkey % 5 = 0 then -l_partkey else l_partkey end as pk, case when l_suppkey % 3 = 0 then -l_suppkey else l_suppkey end as sk from lineitem)
select level, reason, cast(count(*) as bigint) as findings from (
select case when c.l_returnflag = 'R' then 'review' when p.p_partkey is not null then 'accept' when s.s_suppkey is not null then 'review' else 'reject' end as level,
case when c.l_returnflag = 'R' then 'dynamic' when p.p_partkey is not null then 'declared' when s.s_suppkey is not null then 'related' else 'absent' end as reason
from c left join part p on c.pk = p.p_partkey left join supplier s on c.sk = s.s_suppkey) group by all""")
def jn_ladder_multi(spark, sf_dir):
    """Four ordered rungs over two lookups."""
    c = t(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_partkey") % 5 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("pk"), F.when(F.col("l_suppkey") % 3 == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).alias("sk"))
    j = c.join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.lit(True).alias("in_part")), "pk", "left").join(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), F.lit(True).alias("in_supp")), "sk", "left")
    dynamic, part, supp = F.col("l_returnflag") == "R", F.col("in_part").isNotNull(), F.col("in_supp").isNotNull()
    level = F.when(dynamic, "review").when(part, "accept").when(supp, "review").otherwise("reject")
    reason = F.when(dynamic, "dynamic").when(part, "declared").when(supp, "related").otherwise("absent")
    return j.select(level.alias("level"), reason.alias("reason")).groupBy("level", "reason").agg(n("*").alias("findings"))


@query("select event_type as kind, case event_type when 'click' then 'env' when 'view' then 'imports' when 'purchase' then 'routes' else 'unverifiable' end as owner, cast(count(*) as bigint) as claims from events group by all")
def jn_kind_owner(spark, sf_dir):
    owners = spark.createDataFrame([("click", "env"), ("view", "imports"), ("purchase", "routes")], "kind string, owner string")
    claims = t(spark, sf_dir, "events").select(F.col("event_type").alias("kind"))
    return claims.join(F.broadcast(owners), "kind", "left").select("kind", F.coalesce("owner", F.lit("unverifiable")).alias("owner")).groupBy("kind", "owner").agg(n("*").alias("claims"))


@query("""
with spans as (select user_id, event_id as s, event_id + 50 + event_id % 400 as e, concat('s', event_id) as name from events),
hit as (select p.event_id, sp.name, row_number() over (partition by p.event_id order by sp.e - sp.s, sp.name) as rn from events p join spans sp on p.user_id = sp.user_id and p.event_id between sp.s and sp.e)
select event_id, name as scope from hit where rn = 1""")
def jn_interval_scope(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id")
    spans = e.select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 50 + F.col("event_id") % 400).alias("e"), F.concat(F.lit("s"), F.col("event_id")).alias("name"))
    return relations.innermost(e, spans, ["user_id"], "event_id", "s", "e", "name").select("event_id", "scope")


@query("""
with b as (select c_custkey as k, c_mktsegment as v from customer where c_custkey % 10 <> 1), a as (select c_custkey as k, case when c_custkey % 9 = 0 then 'MOVED' else c_mktsegment end as v from customer where c_custkey % 10 <> 2)
select coalesce(b.k, a.k) as k, case when b.k is null then 'added' when a.k is null then 'removed' else 'changed' end as op from b full join a on b.k = a.k where b.k is null or a.k is null or b.v is distinct from a.v""")
def jn_fingerprint_diff(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    after = c.where("k % 10 <> 2").withColumn("v", F.when(F.col("k") % 9 == 0, "MOVED").otherwise(F.col("v")))
    return relations.snapshot_diff(c.where("k % 10 <> 1"), after, "k", "v")


@query("select 'kept_existing' as state, cast(count(*) as bigint) as notes from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id) union all select 'ready', cast(count(*) as bigint) from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def jn_import_split(spark, sf_dir):
    d, l = t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels").select("doc_id")
    return relations.union_all([d.join(l, "doc_id", how).agg(n("*").alias("notes")).select(F.lit(name).alias("state"), "notes") for how, name in (("left_semi", "kept_existing"), ("left_anti", "ready"))])


@query("select c_custkey, concat('/', lower(r_name), '/', lower(n_name), '/', c_custkey) as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def jn_prefix_chain(spark, sf_dir):
    """Full paths through a chain of parents of bounded depth."""
    chain = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.select("c_custkey", F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/"), F.col("c_custkey")).alias("path"))


@query(r"""
with cand as (select distinct p_name as candidate from part), typo as (select distinct concat(substr(p_name, 1, 3), substr(p_name, 5)) as name from part),
tok as (select name, list_distinct(list_filter(string_split_regex(lower(name), '[_\-./:\s]+'), lambda x: x <> '')) as nt from typo), ctok as (select candidate, list_distinct(list_filter(string_split_regex(lower(candidate), '[_\-./:\s]+'), lambda x: x <> '')) as ct from cand),
p as (select name, candidate, least(levenshtein(lower(name), lower(candidate)), (case when length(name) >= 16 then 4 else 3 end) + 1) as d, case when length(name) >= 16 then 4 else 3 end as cap, len(list_intersect(nt, ct)) as o, len(nt) as a, len(ct) as b from tok, ctok where name <> candidate),
r as (select *, row_number() over (partition by name order by d - o, d, candidate) as rk from p where d <= cap or o >= 2 or (a > 0 and o = a) or (b > 0 and o = b))
select name, cast(rk as bigint) as rank, candidate, cast(d as bigint) as distance, cast(o as bigint) as overlap from r where rk <= 3""")
def win_did_you_mean(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    typos = p.select(F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)")).alias("name"))
    got = relations.did_you_mean(typos, p, "name", "p_name")
    return got.select("name", F.col("rank").cast("long").alias("rank"), "candidate", F.col("distance").cast("long").alias("distance"), F.col("overlap").cast("long").alias("overlap"))


LEVEL_SQL = "case event_type when 'click' then 'accept' when 'view' then 'review' when 'purchase' then 'reject' else 'unverifiable' end"


def levels(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind == "click", "accept").when(kind == "view", "review").when(kind == "purchase", "reject").otherwise("unverifiable")
    return t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", "value", "ts", ladders.capped(level, F.col("event_id") % 4 != 0).alias("level"))


@query(f"""
with f as (select user_id, case when event_id % 4 = 0 and l = 'reject' then 'review' else l end as level from (select *, {LEVEL_SQL} as l from events))
select user_id, case when bool_or(level = 'reject') then 'reject' when bool_or(level = 'review') then 'review' else 'accept' end as verdict, cast(count(*) as bigint) as claims, cast(count(*) filter (level = 'accept') as bigint) as accepts,
cast(count(*) filter (level = 'review') as bigint) as reviews, cast(count(*) filter (level = 'reject') as bigint) as rejects, cast(count(*) filter (level = 'unverifiable') as bigint) as unverifiable, bool_or(level = 'reject') as blocked from f group by user_id""")
def agg_gate_verdict(spark, sf_dir):
    c = F.col("level")
    out = levels(spark, sf_dir).groupBy("user_id").agg(ladders.worst(c).alias("verdict"), n("*").alias("claims"), *(F.count_if(c == k).cast("long").alias(v) for k, v in (("accept", "accepts"), ("review", "reviews"), ("reject", "rejects"), ("unverifiable", "unverifiable"))))
    return out.withColumn("blocked", ladders.blocks(F.col("verdict"), F.lit("reject")))


@query(f"""
with f as (select event_type, case when event_id % 4 = 0 and l = 'reject' then 'review' else l end as level from (select *, {LEVEL_SQL} as l from events))
select event_type, cast(count(*) filter (level = 'accept') as bigint) as accept, cast(count(*) filter (level = 'review') as bigint) as review, cast(count(*) filter (level = 'reject') as bigint) as reject from f group by event_type""")
def agg_audit_pivot(spark, sf_dir):
    got = levels(spark, sf_dir).groupBy("event_type").pivot("level", ["accept", "review", "reject"]).count()
    return got.select("event_type", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("accept", "review", "reject")))


@query("select cast(count(*) as bigint) as findings from (select distinct event_id, user_id, event_type, props from (select * from events union all select * from events))")
def agg_finding_dedupe(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return e.unionByName(e).dropDuplicates().agg(n("*").alias("findings"))


@query("select event_type as surface, cast(count(*) as bigint) as blocks, cast(sum(cast(json_extract_string(props, '$.n') as bigint)) as bigint) as rejects, min(event_id) as first_event, max(event_id) as last_event from events group by event_type")
def agg_ledger_summary(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("surface")).agg(n("*").alias("blocks"), F.sum(F.get_json_object("props", "$.n").cast("long")).alias("rejects"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("select source, cast(count(distinct lang) as bigint) as names from documents group by source")
def agg_decl_by_source(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("lang").cast("long").alias("names"))


@query("""
with a as (select d.doc_id, d.lang, case when l.quality is null then 'none' when l.quality = 1 and l.toxic = 0 then 'valid' when l.toxic = 1 then 'invalid' else 'stale' end as s from documents d left join labels l using (doc_id))
select lang, s as state, cast(count(*) as bigint) as notes, grouping_id(lang, s) as level from a group by grouping sets ((lang, s), (lang), (s), ())""")
def agg_memory_stats(spark, sf_dir):
    a = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    s = F.when(F.col("quality").isNull(), "none").when((F.col("quality") == 1) & (F.col("toxic") == 0), "valid").when(F.col("toxic") == 1, "invalid").otherwise("stale")
    got = a.select("lang", s.alias("state")).cube("lang", "state").agg(n("*").alias("notes"), F.grouping_id().cast("long").alias("level"))
    return got


@query("select lang, sha256(string_agg(h, chr(10) order by h)) as fingerprint, cast(count(*) as bigint) as files from (select lang, sha256(text) as h from documents) group by lang")
def agg_tree_fingerprint(spark, sf_dir):
    h = t(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return h.groupBy("lang").agg(relations.stable_hash(F.collect_list("h")).alias("fingerprint"), n("*").alias("files"))


@query("select user_id as node, arg_max(event_type, event_id) as op, max(event_id) as last_seq from (select * from events where event_id > 100 order by event_id limit 50000) group by user_id")
def win_changes_since(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("node"), F.col("event_type").alias("op"))
    return relations.latest_ops(e, 100, 50_000)


@query("select doc_id, lang, (select count(*) from documents) > 140 as has_more from documents order by doc_id limit 100 offset 40")
def win_export_page(spark, sf_dir):
    return relations.page(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, 40)


@query("select cast(row_number() over (order by array_position(['R', 'A', 'N'], l_returnflag), l_orderkey, l_linenumber, l_partkey, l_suppkey) as bigint) as place, l_orderkey, cast(l_linenumber as bigint) as l_linenumber from lineitem")
def win_finding_order(spark, sf_dir):
    """The order of all findings with a level before the place; flags stand for levels."""
    worst = F.array_position(F.array(F.lit("R"), F.lit("A"), F.lit("N")), F.col("l_returnflag")).alias("worst")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    l = ordered(t(spark, sf_dir, "lineitem").select(worst, *keys), ["worst", *keys])
    return l.select("place", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as bigint) as place, l_orderkey, cast(l_linenumber as bigint) as l_linenumber from lineitem")
def win_finding_order_all(spark, sf_dir):
    """The order of all findings, range-partitioned."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    l = ordered(t(spark, sf_dir, "lineitem").select(*keys), keys)
    return l.select("place", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("""
with x as (select row_number() over (order by s_suppkey) * 2 as turn, 0 as side, s_name as name from supplier union all select row_number() over (order by n_nationkey) * 2 + 1, 1, n_name from nation)
select cast(row_number() over (order by turn) as bigint) as place, side, name from x""")
def win_interleave(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    m = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return relations.interleave(s, m, "k", "name")


@query("select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by sha256('13' || p_partkey), p_partkey) as rn from part) where rn <= 3")
def win_hash_sample(spark, sf_dir):
    return relations.hash_sample(t(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", "13", 3)


@query("""
with recursive o as (select source, doc_id, strlen(text) as b, row_number() over (partition by source order by doc_id) as rn from documents),
f as (select source, 0::bigint as rn, 0::bigint as used, 0::bigint as taken from (select distinct source from documents) union all
select f.source, o.rn, case when f.used + o.b <= 20000 then f.used + o.b else f.used end, case when f.used + o.b <= 20000 then f.taken + 1 else f.taken end from f join o on o.source = f.source and o.rn = f.rn + 1)
select source, arg_max(used, rn) as used, arg_max(taken, rn) as taken, max(rn) - arg_max(taken, rn) as omitted from f group by source""")
def win_bounded_budget(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return relations.bounded(d, ["source"], "doc_id", "size", 20_000)


@query("""
with b as (select distinct o_custkey as k from orders where o_orderdate < timestamp '1996-01-01'), a as (select distinct o_custkey as k from orders where o_orderdate >= timestamp '1996-01-01')
select k, 'removed' as op from (select k from b except select k from a) union all select k, 'added' from (select k from a except select k from b)""")
def set_snapshot_diff(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    b, a = o.where(F.col("o_orderdate") < cut).select("k"), o.where(F.col("o_orderdate") >= cut).select("k")
    return b.subtract(a).withColumn("op", F.lit("removed")).unionByName(a.subtract(b).withColumn("op", F.lit("added")))


SECRET_SQL = r"""(?i)\b([a-z0-9_]*(?:password|passwd|secret|token|api[_-]?key))["'']?\s*[:=]\s*(?:"[^"]{4,}"|''[^'']{4,}''|[^\s"''`,;]{4,})"""
SCRUB_SQL = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED PRIVATE KEY]', 'gs'),
'(?i)\bbearer\s+[A-Za-z0-9._~+/-]{{12,}}=*', 'Bearer [REDACTED]', 'g'), '{SECRET_SQL}', '\1=[REDACTED]', 'g'), '([a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+:)[^\s/@]+(@)', '\1[REDACTED]\2', 'g')"""


query(cases.scrub_cases(SCRUB_SQL))(cases.fn_scrub_inline)


@query(f"select doc_id, sha256({SCRUB_SQL.replace('(x,', '(text,')}) as clean_sha, {SCRUB_SQL.replace('(x,', '(text,')} <> text as redacted from documents")
def fn_scrub_documents(spark, sf_dir):
    clean = text.scrub(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("clean_sha"), (clean != F.col("text")).alias("redacted"))


@query(r"select doc_id, cast(len(ws) as bigint) as n_terms, sha256(array_to_string(ws, ' ')) as terms_sha from (select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\pL][\pL\pN\pM_]*'), lambda x: lower(x)))) as ws from documents)")
def fn_terms_documents(spark, sf_dir):
    w = text.words(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_terms"), F.sha2(F.array_join(w, " "), 256).alias("terms_sha"))


@query("select doc_id, substr(sha256(source || chr(0) || text), 1, 20) as note_id, 'note-' || substr(sha256(text), 1, 24) as import_id from documents")
def fn_note_id(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.content_id(F.col("source"), F.col("text")).alias("note_id"), text.content_id(F.col("text"), prefix="note-", size=24).alias("import_id"))


WORDS_SQL = r"list_distinct(list_transform(regexp_extract_all({0}, '[\pL][\pL\pN\pM_]*'), lambda x: lower(x)))"


@query(f"""
with q as (select item_id, unnest({WORDS_SQL.format('text')}) as w from benchmark), d as (select doc_id, unnest({WORDS_SQL.format("coalesce(source, '') || ' ' || coalesce(lang, '')")}) as w, 2 as p from documents union all select doc_id, unnest({WORDS_SQL.format('text')}), 1 from documents),
s as (select item_id, doc_id, sum(p) as score from q join d using (w) group by all), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rk from s)
select item_id, doc_id, cast(score as bigint) as score, cast(rk as bigint) as rank from r where rk <= 8""")
def mem_recall_topk(spark, sf_dir):
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.words(F.col("text")).alias("words"))
    notes = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.words(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))).alias("title_words"), text.words(F.col("text")).alias("body_words"))
    return relations.recall(q, notes, 8).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query("""
with a as (select doc_id, source, case when doc_id % 11 = 0 then 'invalid' when doc_id % 5 = 0 and sha256(text || '!') <> sha256(text) then 'stale' else 'valid' end as s from documents)
select source, case when bool_or(s = 'invalid') then 'invalid' when bool_or(s <> 'valid') then 'stale' else 'valid' end as state, cast(count(*) as bigint) as anchors from a group by source""")
def mem_anchor_state(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    seen = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    state = F.when(seen.isNull(), "invalid").when(seen != F.sha2("text", 256), "stale").otherwise("valid")
    return d.select("source", state.alias("s")).groupBy("source").agg(ladders.anchor_summary(F.col("s")).alias("state"), n("*").alias("anchors"))


@query("select d.doc_id, c.op from documents d join (select user_id, arg_max(event_type, event_id) as op from events where event_id > 500 group by user_id) c on c.user_id = d.doc_id where c.op <> 'click'")
def mem_changes_invalidate(spark, sf_dir):
    e = t(spark, sf_dir, "events").where("event_id > 500").groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("event_type", "event_id").alias("op"))
    return t(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id").where("op <> 'click'")


EDGES_SQL = "select concat('nation:', n_nationkey) as a, concat('region:', n_regionkey) as b from nation union all select concat('supplier:', s_suppkey), concat('nation:', s_nationkey) from supplier"


@query(f"""
with recursive e as (select a, b from ({EDGES_SQL}) union all select b, a from ({EDGES_SQL})), w as (select 'region:1' as node, 0 as hop union select e.b, w.hop + 1 from w join e on e.a = w.node where w.hop < 2)
select node, cast(min(hop) as bigint) as hop from w group by node""")
def gr_neighbors(spark, sf_dir):
    def name(kind, key):
        return F.concat(F.lit(f"{kind}:"), F.col(key))

    edges = t(spark, sf_dir, "nation").select(name("nation", "n_nationkey").alias("a"), name("region", "n_regionkey").alias("b")).union(t(spark, sf_dir, "supplier").select(name("supplier", "s_suppkey"), name("nation", "s_nationkey")))
    roots = edges.where("b = 'region:1'").select(F.col("b").alias("node"))
    return relations.neighbours(edges, roots, 2).select("node", F.col("hop").cast("long").alias("hop"))


@query("select ref, case when c = 0 then 'not_found' when c = 1 then 'resolved' else 'ambiguous' end as status, cast(c as bigint) as matches from (select r.ref, (select count(*) from part where p_name = r.ref or concat('part:', p_partkey) = r.ref or cast(p_partkey as varchar) = r.ref) as c from (select 'part:7' as ref union all select 'absent' union all select min(p_name) from part) r)")
def gr_resolve(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"))
    first = p.agg(F.min("name")).first()[0]
    return relations.union_all([relations.resolve(p, x) for x in ("part:7", "absent", first)])


@query("select event_id, case when event_id % 2 = 0 then 'blocked' when event_id % 3 = 0 then 'changed_during_check' when event_id % 5 = 0 then 'needs_review' when event_id % 7 <> 0 then 'needs_test_evidence' else 'ready' end as state from events")
def hon_checkpoint_state(spark, sf_dir):
    k = F.col("event_id")
    return t(spark, sf_dir, "events").select("event_id", ladders.checkpoint_state(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("state"))


@query("select event_id, case when event_id % 13 = 0 then 'unverifiable' when event_id % 7 = 0 then 'review' when event_id % 2 = 0 or event_id % 3 = 0 or event_id % 5 = 0 then 'accept' else 'reject' end as level from events")
def jn_env_ladder(spark, sf_dir):
    k = F.col("event_id")
    return t(spark, sf_dir, "events").select("event_id", ladders.env_level(k % 13 != 0, k % 7 == 0, k % 2 == 0, k % 3 == 0, k % 5 == 0, F.lit(True)).alias("level"))


@query("select cast(count(*) as bigint) as total, cast(count(*) filter (m not in (select p_name from part)) as bigint) as detected from (select concat(substr(p_name, 1, 2), substr(p_name, 2)) as m from part)")
def ev_mutation_tally(spark, sf_dir):
    """Accepted references, one letter doubled, checked again: how many are detected."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    mutated = p.select(F.expr("concat(substring(p_name, 1, 2), substring(p_name, 2))").alias("name"))
    graded = relations.check_references(mutated, p.select(F.col("p_name").alias("name"), F.lit("part").alias("src")), "name", "src")
    return graded.agg(n("*").alias("total"), F.count_if(F.col("declared_in").isNull()).cast("long").alias("detected"))


FOUND_SQL = "select d.doc_id, '{kind}', {value} from documents d, unnest(regexp_extract_all(d.text, '{pattern}', {group})) u(x)"


@query(
    f"with c as ({PROSE_SQL}) select doc_id, 'import' as kind, name as subject from c union "
    + " union ".join((
        FOUND_SQL.format(kind="import", value="x", pattern="`([a-z][a-z0-9_]{2,})`", group=1),
        FOUND_SQL.format(kind="env", value="x", pattern=r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b", group=1) + " where length(x) >= 4",
        FOUND_SQL.format(kind="route", value=r"regexp_replace(x, '\s+', ' ')", pattern=r"\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[\w./{}\-:]*", group=0),
        FOUND_SQL.format(kind="file", value="regexp_replace(x, '[.,;:)]+$', '')", pattern=r"(?:^|[^\w/])((?:[\w.\-]+/)+[\w.\-]+\.[A-Za-z0-9]{1,8})", group=1),
    ))
)
def ext_prose_claims(spark, sf_dir):
    return extract.prose_claims(t(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
with i as (select doc_id as record, concat('n', doc_id % 700) as id, text, case when doc_id % 11 = 0 then 'episode' when doc_id % 13 = 0 then 'odd' else 'note' end as kind from documents),
r as (select *, case when length(trim(coalesce(text, ''))) not between 1 and 4000 then 'text' when kind = 'episode' then 'episode' when kind = 'odd' then 'kind' end as reason from i),
g as (select *, row_number() over (partition by id order by record) as nth from r where reason is null)
select record, id, 'skipped' as action, reason from r where reason is not null
union all select record, id, case when nth > 1 then 'duplicate' when id in (select concat('n', doc_id) from labels) then 'kept_existing' else 'ready' end, null from g""")
def mem_import_notes(spark, sf_dir):
    """Documents as notes of another store, some of them raw or of an odd kind, against labelled ids as notes here."""
    k = F.col("doc_id")
    kind = F.when(k % 11 == 0, "episode").when(k % 13 == 0, "odd").otherwise("note")
    incoming = t(spark, sf_dir, "documents").select(k.alias("record"), F.concat(F.lit("n"), k % 700).alias("id"), F.concat(F.lit("note "), k).alias("title"), "text", kind.alias("kind"), F.lit(0).alias("created"))
    here = t(spark, sf_dir, "labels").select(F.concat(F.lit("n"), "doc_id").alias("id"))
    return notes.import_notes(incoming, here).select("record", "id", "action", "reason")


@query("""
with p as (select *, row_number() over (order by item_id) as place from (select * from benchmark order by item_id limit 21 offset 5)),
s as (select item_id, place, sum(octet_length(encode(text)) + length(cast(item_id as varchar)) + 66) over (order by place) + place - 1 as size from p)
select cast(place as bigint) as place, item_id as id, cast(count(*) over () + 5 as bigint) as next_offset from s where place <= 20 and size <= 4000""")
def mem_export_page(spark, sf_dir):
    """A page of benchmark items as notes; the SQL adds up bytes, of which 66 a note are its keys and fixed values."""
    rows = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("title"), "text", F.lit("note").alias("kind"), F.lit(0).alias("created"))
    return notes.export_page(rows, 20, 5, 1000).select("place", "id", F.col("next_offset").cast("long").alias("next_offset"))


@query(f"""
with recursive e as (select a, b from ({EDGES_SQL}) union all select b, a from ({EDGES_SQL})), w as (select 'region:1' as node, 0 as hop union select e.b, w.hop + 1 from w join e on e.a = w.node where w.hop < 1),
near as (select node as name, 1 as side, row_number() over (order by min(hop), node) as rn from w group by node),
best as (select cast(item_id as varchar) as name, 0 as side, row_number() over (order by item_id) as rn from benchmark where item_id between 3 and 6)
select cast(row_number() over (order by rn, side) as bigint) as place, side, name from (select * from best union all select * from near)""")
def mem_brief(spark, sf_dir):
    """Notes that share a word, and the sources one step around a reference, in turn."""
    def name(kind, key):
        return F.concat(F.lit(f"{kind}:"), F.col(key))

    edges = t(spark, sf_dir, "nation").select(name("nation", "n_nationkey").alias("a"), name("region", "n_regionkey").alias("b")).union(t(spark, sf_dir, "supplier").select(name("supplier", "s_suppkey"), name("nation", "s_nationkey")))
    held = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id").between(3, 6), F.array(F.lit("wanted"))).otherwise(F.array(F.lit("other"))).alias("title_words"), F.array().cast("array<string>").alias("body_words"))
    refs = edges.where("b = 'region:1'").select(F.col("b").alias("node"))
    return notes.brief(["wanted"], held, refs, edges, hops=1)


@query("select d.doc_id as id, case when d.doc_id % 5 = 0 then 'refused' when l.doc_id is null then 'not_checked' when toxic = 1 then 'changed' else 'stored' end as action, case when d.doc_id % 5 <> 0 and toxic = 0 then 'ready' end as state from documents d left join labels l on l.doc_id = d.doc_id")
def mem_handoff(spark, sf_dir):
    drafts = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5 != 0).alias("anchors_valid"))
    reports = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("ready").alias("state"), F.lit(0).alias("before"), F.col("toxic").alias("after"))
    return notes.handoff(drafts, reports)


@query(r"""select doc_id, replace(regexp_replace(regexp_replace(text, '["''`]', '', 'g'), '#[^\n]*', '', 'g'), ' ', '') as code from documents""")
def fn_mask_comments(spark, sf_dir):
    """Texts without quotes, with what follows a hash masked, compared without blanks."""
    bare = t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[\"'`]", "").alias("text"))
    return bare.select("doc_id", F.replace(text.mask_comments(F.col("text"), "hash"), F.lit(" "), F.lit("")).alias("code"))