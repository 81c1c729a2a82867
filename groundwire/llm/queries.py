"""Queries of the llm operators: thin callables over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(table(spark, sf_dir, "documents"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_documents, write_shards

    return read_documents(*write_shards(table(spark, sf_dir, "documents")))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import line_rules

    return line_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .separators import document_tokens

    return document_tokens(table(spark, sf_dir, "documents"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_hnsw, op4_wavelet_tokens, op5_near_dup, op6_line_rules, op7_pack, op8_token_counts, op9_prefix_bpe, op10_lattice_lm, op11_spelling, op12_phrases, op13_simhash)}

#: Words as the contracts have them; lower() would fold more than A-Z.
_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""

#: Every pair that shares a shingle is counted here, and components follow by recursion: the plain reading of op5's contract.
_NEAR_DUP = f"""
with recursive words as (select doc_id, coalesce({_WORDS}, []) as w from documents),
sets as (
    select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as shingle
    from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from sets a join sets b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach as (select doc_id as a, doc_id as b from words union select reach.a, links.b from reach join links on links.a = reach.b),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select words.doc_id, coalesce(sizes.n, 0) as n_shingles, least.component_id, words.doc_id = least.component_id as kept
from words join least using (doc_id) left join sizes using (doc_id)
"""

#: The checksum byte by byte, with its table made by rule; near words by the place and the rest of each deletion.
_SPELLING = """
with recursive steps(i, k, c) as (
    select i, 0, i from range(256) t(i)
    union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8
),
crc as (select list(c order by i) as of from steps where k = 8),
runs as (
    select coalesce(cast(doc_id as varchar), '') || ':' as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) as run
    from documents
),
each as (select id || run as whole, run, count(*) as n from runs where length(run) >= 6 group by 1, 2),
bytes as (select run, n, list_transform(range(octet_length(encode(whole))), lambda i: cast('0x' || substr(hex(encode(whole)), 2 * i + 1, 2) as bigint)) as raw from each),
sums as (select run, n, xor(list_reduce(raw, lambda a, b: xor(a >> 8, of[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) as h from bytes, crc),
typed as (select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from sums),
words as (select word, cast(sum(n) as bigint) as n from typed where length(word) >= 6 group by word having sum(n) >= 5),
fewer as (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
    select a.word, b.word as near, b.n as near_n from fewer a join fewer b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select a.word, b.word, b.n from fewer a join words b on a.rest = b.word
    union select b.word, a.word, a.n from fewer a join words b on a.rest = b.word
),
best as (select word, count(*) as n_near from pairs group by word),
top as (select word, near, near_n from pairs qualify row_number() over (partition by word order by near_n desc, encode(near)) = 1),
forms as (
    select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n
    from words left join best using (word) left join top using (word)
),
chain(word, last, steps) as (select word, word, 0 from forms union all select c.word, f.form, steps + 1 from chain c join forms f on f.word = c.last where f.form is not null),
ends as (select word, max_by(last, steps) as root from chain group by word)
select word, form, root, n, n_near, form_n from forms join ends using (word)
"""

#: All runs of words within pieces are counted; every candidate is cut at every place.
_PHRASES = """
with pieces as (
    select row_number() over () as piece_id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
    from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)
),
words as (select piece_id, lang, unnest(w) as one, generate_subscripts(w, 1) as place from pieces),
runs as (select lang, one, lead(one, 1) over next as two, lead(one, 2) over next as three from words window next as (partition by piece_id order by place)),
spans as (
    select lang, 1 as k, one as phrase from runs
    union all select lang, 2, one || ' ' || two from runs where two is not null
    union all select lang, 3, one || ' ' || two || ' ' || three from runs where three is not null
),
f as (select lang, k, phrase, count(*) as f from spans group by all),
totals as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
candidates as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
cuts as (
    select c.lang, c.phrase, c.a, cut_at, x.f as l, y.f as r, cast((cast(1000000 as hugeint) * a * a) // (cast(x.f as hugeint) * y.f) as bigint) as score
    from (select *, unnest(generate_series(1, k - 1)) as cut_at from candidates) c
    join f x on x.lang = c.lang and x.k = cut_at and x.phrase = array_to_string(list_slice(w, 1, cut_at), ' ')
    join f y on y.lang = c.lang and y.k = c.k - cut_at and y.phrase = array_to_string(list_slice(w, cut_at + 1, c.k), ' ')
),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut_at) = 1),
inner_parts as (
    select lang, a, array_to_string(list_slice(w, i, i + 1), ' ') as phrase from candidates, (values (1), (2)) as t(i) where k = 3
),
kept as (select * from lowest c where not exists (select 1 from inner_parts p where p.lang = c.lang and p.phrase = c.phrase and 100 * p.a >= 50 * c.a))
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op5_near_dup": _NEAR_DUP, "op11_spelling": _SPELLING, "op12_phrases": _PHRASES}
