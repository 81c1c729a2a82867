"""Whole tables against plain SQL in DuckDB."""

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    return con


@pytest.mark.parametrize("hot_rows", [1024, 3])
def test_near_dup(spark, duck, monkeypatch, hot_rows):
    from groundwire.llm import near_dup, queries

    monkeypatch.setattr(near_dup, "HOT_ROWS", hot_rows)
    got = queries.op5_near_dup(spark, DIR)
    want = duck.sql(queries.ORACLE_SQL["op5_near_dup"])
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.columns == want.columns


def test_base_columns_of_line_rules(spark, duck):
    from groundwire.llm.queries import op6_line_rules

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    sql = rf"""
    with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
    lines as (select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '{WORD}') group by 1, 2),
    dup as (select doc_id, sum(n - 1) as n_dup_lines from lines group by 1),
    win as (select doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') as x from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from t where len(w) > 2)),
    twice as (select doc_id, i from win join (select doc_id, x from win group by 1, 2 having count(*) > 1) using (doc_id, x)),
    hit as (select doc_id, count(distinct i + k) as n_repeat_words from twice, (select unnest([0, 1, 2]) as k) group by 1),
    base as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
        from t left join dup using (doc_id) left join hit using (doc_id))
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base
    """
    assert sorted(map(tuple, op6_line_rules(spark, DIR).select(names).collect())) == sorted(duck.sql(sql).fetchall())


def test_base_columns_of_lattice_lm(spark, duck):
    import zlib

    from groundwire.llm.queries import op10_lattice_lm

    duck.create_function("crc", lambda i: zlib.crc32(str(i).encode()), ["BIGINT"], "BIGINT")
    sql = rf"""
    with t as (select doc_id, crc(doc_id) % 7 = 2 as held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
    tokens as (select doc_id, held_out, unnest(list_append(w, ' ')) as token from t),
    counts as (select token, count(*) as c from tokens where not held_out group by 1),
    total as (select sum(c) as n, count(*) as v from counts)
    select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, sum(log10((coalesce(c, 0) + 1) / (n * 1.0 + v + 1))) as base_score
    from tokens left join counts using (token), total group by 1, 2
    """
    got = {r.doc_id: r for r in op10_lattice_lm(spark, DIR).collect()}
    want = duck.sql(sql).fetchall()
    assert len(got) == len(want)
    for doc, held_out, n_tokens, n_known, train_tokens, base in want:
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n_tokens, n_known, train_tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
