"""Columns of any name pass through the filters, and what is learned has no cap on grams."""

import random

from pyspark.sql import functions as F

CLASHES = ("__text", "__id", "__score", "__lang", "__place", "row", "letter", "score", "lang_pred", "kept")


def _clashing(docs):
    return docs.drop("score", "kept").withColumns({x: F.lit(k) for k, x in enumerate(CLASHES)}).withColumn("a.b", F.lit(1))


def test_recognised_keeps_clashing_columns(docs):
    from groundwire.llm.language import languages, recognised

    clashing = _clashing(docs)
    got = recognised(clashing)
    assert got.columns == clashing.columns
    assert got.where("score = 7 and kept = 9 and row = 5").count() == got.count() > 50
    assert languages(clashing).count() == clashing.count()


def test_many_grams_all_count(spark):
    from groundwire.llm.language import train

    r = random.Random(2)
    text = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(60_000))
    models = train(spark.createDataFrame([(1, text, "zz")], "doc_id long, text string, lang string"))
    held = len(models[0].value.tables[3].values) - 1
    raw = text.encode()
    assert held == len({(b"\0\0\0" + raw)[k : k + 4] for k in range(len(raw))}) > 120_000


def test_one_of_each_keeps_clashing_columns(docs):
    from groundwire.llm.near_dup import one_of_each

    clashing = _clashing(docs)
    got = one_of_each(clashing)
    assert got.columns == clashing.columns
    assert got.where("__id = 1 and __text = 0 and __place = 4").count() == got.count() > 50
