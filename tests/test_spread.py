"""Work is dealt out before much is made of few bytes, and written tables are as large as their rows."""

import os
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from groundwire.functions import text as texts
from groundwire.operators import change, recall, relations
from groundwire.plans import cases, catalogue, composed, gates
from groundwire.runtime import sized
from groundwire.sources import files, sample

DIR = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("tree", [cases.services, composed.service_tree, composed.far_tree])
def test_trees_have_several_tasks(spark, tree):
    assert tasks(tree(spark, DIR)) > 1


def test_masked_reads_tree_has_several_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gates.change, "check_change", lambda added, tree: seen.append(tree) or spark.createDataFrame([("f", 1, "s", "l")], "file string, line long, subject string, level string"))
    gates.gate_masked_reads(spark, DIR)
    assert tasks(seen[0]) > 1


@pytest.mark.parametrize("name", ["src_code_declarations", "mem_recall_topk", "mem_recall_matches"])
def test_dealt_out_by_number(spark, name):
    assert "REPARTITION_BY_NUM" in catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_sized_files_are_as_large_as_their_rows(spark):
    held = sized(spark.range(20_000).withColumn("x", F.lit("x" * 50)), "sized")
    assert sum(os.path.getsize(urlparse(f).path) for f in held.inputFiles()) > 20_000 * 50


def test_only_pools_that_are_asked_for(spark):
    names = spark.createDataFrame([("a", "helth")], "at string, ref string")
    pool = spark.createDataFrame([("a", "health"), ("b", "helthy")], "at string, candidate string")
    near = relations.did_you_mean(names, pool, "ref", "candidate", within=["at"])
    assert [(r["at"], r["candidate"]) for r in near.collect()] == [("a", "health")]
    assert "LeftSemi" in near._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_of_names_are_dealt_out_and_not_sent_to_the_driver(spark):
    names = spark.range(60).select((F.col("id") % 20).alias("at"), F.concat(F.lit("helth_"), "id").alias("ref"))
    pool = spark.range(60).select((F.col("id") % 20).alias("at"), F.concat(F.lit("health_"), "id").alias("candidate"))
    near = relations.did_you_mean(names, pool, "ref", "candidate", 1, within=["at"])
    assert {(r["name"], r["candidate"]) for r in near.collect()} == {(f"helth_{k}", f"health_{k}") for k in range(60)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin [^\n]*key#", plan) and re.search(r"SortMergeJoin [^\n]*place#", plan)
    assert "REPARTITION_BY_NUM" in plan


def test_pieces_have_each_key_once(spark):
    held = relations._pieces(spark.createDataFrame([("aaaaaaaa",), ("x",), ("",)], "name string"), "name", True)
    assert held.count() == held.distinct().count() > 0


def test_changed_lines_are_not_sent_to_the_driver(spark):
    tree = sample.tree(spark, broken=True)
    facts, _ = change.added_facts(files.region_lines(tree), change.Index(tree))
    assert [r["line"] for r in facts.collect() if (r["path"], r["tag"], r["name"]) == ("app/broken.py", "import", "requestz")] == [3]
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[path#\d+, line#\d+L\]", plan) and not re.search(r"BroadcastHashJoin \[path#\d+, line#\d+L\]", plan)


def test_postings_have_one_row_a_word(spark):
    notes = spark.createDataFrame([(129, ["a", "b"], ["b", "c"])], "place long, title array<string>, body array<string>")
    assert sorted((r["term"], r["block"], r["place"], r["points"]) for r in recall.postings(notes).collect()) == [("a", 1, 129, 2), ("b", 1, 129, 3), ("c", 1, 129, 1)]


def test_matches_hold_bitmaps_in_place(spark):
    plan = catalogue.queries()["mem_recall_matches"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_matches_of_several_blocks(spark):
    notes = spark.range(1, 1001).select("id", F.when(F.col("id") % 3 == 0, "red").otherwise("").alias("title"), F.when(F.col("id") % 5 == 0, "red blue").otherwise("green").alias("body"), F.when(F.col("id") % 7 == 0, "stale").otherwise("anchored").alias("state"))
    asked = spark.createDataFrame([(1, "red blue"), (2, "green"), (3, " "), (4, "none"), (5, "!")], "query_id long, query string")
    got = {r["query_id"]: (r["matches"], r["hidden_stale"], r["limit_omitted"]) for r in recall.Notebook(notes).matches(asked, 8).collect()}
    count = lambda test: tuple(sum(test(k) and (k % 7 == 0) == stale for k in range(1, 1001)) for stale in (False, True))
    want = {1: count(lambda k: k % 3 == 0 or k % 5 == 0), 2: count(lambda k: k % 5 != 0), 3: count(lambda k: True), 4: (0, 0), 5: (0, 0)}
    assert got == {k: (*v, max(v[0] - 8, 0)) for k, v in want.items()}


def test_texts_of_documents_are_dealt_out_and_words_found_at_once(spark):
    plan = catalogue.queries()["fn_texts_of_documents"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "lambdafunction" not in plan


def test_terms_with_parts_in_odd_words(spark):
    text = "getHTTPUrl2 aBc ABc x1yz café ΑΣ.ΑΣ 1in_ 9to"
    want = ["abc", "bc", "caf", "café", "get", "gethttpurl2", "http", "in", "in_", "to", "url", "x1yz", "yz", "ας"]
    assert spark.range(1).select(texts.terms(F.lit(text)).alias("t")).first().t == want
    assert spark.range(1).select(texts.terms(F.lit("")).alias("t"), texts.terms(F.lit(None).cast("string")).alias("n")).first() == ([], None)


def test_route_claims_resolve_routes_once(spark):
    read = catalogue.queries()["fx_route_claims"](spark, DIR).inputFiles()
    assert any("/routes-" in f for f in read) and not any("/facts-" in f for f in read)
