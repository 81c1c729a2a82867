"""Collocations against plain SQL over whole tables, with ample and with far too few buckets."""

import duckdb
import pandas as pd
import pytest

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_sql(documents):
    from groundwire.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(con.sql(ORACLE_SQL["op12_phrases"]).fetchall())


@pytest.mark.parametrize("hot_rows", [1024, 2])
def test_whole_table(spark, monkeypatch, hot_rows):
    from groundwire.llm import near_dup
    from groundwire.llm.queries import op12_phrases

    monkeypatch.setattr(near_dup, "HOT_ROWS", hot_rows)
    got = op12_phrases(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == by_sql(pd.read_parquet("/root/testdata/sf0.001/documents.parquet"))


def test_few_buckets_change_nothing(spark, docs, rows, empty):
    from groundwire.llm.phrases import phrases

    frame = pd.DataFrame({"text": [r[1] for r in rows], "lang": [r[2] for r in rows]})
    want = by_sql(frame)
    for n_buckets in (None, 1 << 16):
        assert sorted(map(tuple, phrases(docs, n_buckets=n_buckets).collect())) == want
    assert len(want) > 20 and phrases(empty).count() == 0


def test_pruning_keeps_what_is_frequent(spark):
    """Pieces, several spaces, capitals, a null language beside `und`; all phrases that count enough, and no others."""
    from groundwire.llm.phrases import frequent_phrases, phrases

    rows = [("New  York\tCity, new york city! New York", None)] * 4 + [("the new york. city the", "und")] * 3 + [(None, "und"), ("", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    texts = docs.na.fill({"text": "", "lang": "und"})
    tables, words = frequent_phrases(texts, least=8)
    assert [sorted(map(tuple, t.collect())) for t in tables] == [[("und", "city", 11), ("und", "new", 15), ("und", "york", 15)], [("und", "new york", 15), ("und", "york city", 8)], [("und", "new york city", 8)]]
    assert [tuple(r) for r in words.collect()] == [("und", 47)]
    assert sorted(map(tuple, phrases(docs).collect())) == by_sql(pd.DataFrame({"text": [r[0] for r in rows], "lang": [r[1] for r in rows]}))


def test_rounds_keep_the_first_rows(spark):
    from groundwire.llm.phrases import _best

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'x', 'y') as lang", "concat('p', id) as phrase", "id % 7 as a", "id % 2 as score")
    got = _best(rows, 20).collect()
    for lang in "xy":
        want = sorted(((-r.score, -r.a, r.phrase) for r in rows.collect() if r.lang == lang))[:20]
        assert [(-r.score, -r.a, r.phrase) for r in sorted(got, key=lambda r: r["rank"]) if r.lang == lang] == want


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from groundwire.llm.phrases import SCORE

    a, l, r = 10**14, 3 * 10**15, 7 * 10**14
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert row.select(F.expr(SCORE).alias("score")).first()[0] == 1_000_000 * a * a // (l * r)
