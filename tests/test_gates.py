"""Projects, plug-ins, evidence, recall and budgets on small cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from groundwire.operators import change, payload, plugins, recall, relations
from groundwire.sources import files, projects
from groundwire.streaming import feed


def tree_of(spark, held):
    return spark.createDataFrame(sorted(held.items()), "path string, text string")


def names(tree):
    facts = projects.project_facts(tree)
    found = projects.own_names(tree.select("path"), facts)
    return {k: {r.name for r in found.where(F.col("kind") == k).collect()} for k in ("module", "nested", "package")}


def test_roots_of_packaging_files(spark):
    held = {
        "pyproject.toml": '[project]\nname = "My-Thing"\n[tool.setuptools.package-dir]\n"" = "python"\n[tool.poetry]\npackages = [{include = "svc", from = "services"}]\n[tool.pytest.ini_options]\npythonpath = ["tests/helpers"]\n',
        "python/mypkg/__init__.py": "", "services/svc/__init__.py": "", "tests/helpers/util_of_tests.py": "", "apps/blog/__init__.py": "", "apps/blog/models.py": "",
        "one/setup.cfg": "[options]\npackage_dir =\n    = source\n", "one/source/core/__init__.py": "", "two/Pipfile": "", "two/src/late.py": "", "two/not-a-name/x.py": "", "web/package.json": '{"name": "@a/web"}', "web/bad/package.json": "{",
    }
    got = names(tree_of(spark, held))
    assert {"mypkg", "svc", "util_of_tests", "core", "late", "my_thing"} <= got["module"] and "blog" not in got["module"] and "not-a-name" not in got["module"]
    assert got["nested"] == {"blog"} and got["package"] == {"@a/web"}


def test_modules_resolve_from_the_nearest_project(spark):
    tree = tree_of(spark, {"app/x.py": "", "back/setup.py": "", "back/app/x.py": "", "back/src/y.py": "", "src/y.py": "", "back/app/deep/z.py": "", "lib/w/__init__.py": ""})
    asked = [("back/app/m.py", "app.x"), ("front/m.py", "app.x"), ("back/m.py", "y"), ("m.py", "y"), ("back/app/m.py", ".deep.z"), ("back/app/deep/m.py", "..x"), ("m.py", "w"), ("m.py", "none"), ("m.py", None)]
    got = {(r.file, r.module): r.home for r in projects.module_homes(spark.createDataFrame(asked, "file string, module string"), tree).collect()}
    assert got == {("back/app/m.py", "app.x"): "back/app/x.py", ("front/m.py", "app.x"): "app/x.py", ("back/m.py", "y"): "back/src/y.py", ("m.py", "y"): "src/y.py", ("back/app/m.py", ".deep.z"): "back/app/deep/z.py", ("back/app/deep/m.py", "..x"): "back/app/x.py", ("m.py", "w"): "lib/w/__init__.py"}


@pytest.mark.parametrize("path,text,want", [
    ("pyproject.toml", '[tool.uv]\ndev-dependencies = ["a>1"]\n[tool.hatch.envs.x]\nextra-dependencies = ["b"]\n[tool.pdm.dev-dependencies]\nt = ["c[x]"]\n[tool.poetry.dev-dependencies]\nd = "1"\n', ["a", "b", "c", "d"]),
    ("requirements.txt", "git+https://x/y#egg=one\n-e .\nhttps://x/two.whl\nthree[x]==1\n# four\n", ["one", "three"]),
    ("pnpm-lock.yaml", "packages:\n\n  /left@1.0.0:\n    resolution: {}\n  '@s/p@2':\nimporters:\n  .:\n    dependencies:\n      right:\n", ["@s/p", "left", "right"]),
    ("package-lock.json", '{"packages": {"": {"dependencies": {"x": "1"}}, "node_modules/y": {}}}', ["x", "y"]), ("setup.cfg", "[metadata]\n", [""]),
])
def test_names_of_manifests(path, text, want):
    assert sorted(r[2] for r in files.manifest_names(path, text)) == want


def test_mandatory_requirements():
    got = set(projects.project_rows("p/pyproject.toml", '[project]\ndependencies = ["a>=1"]\n[project.optional-dependencies]\nx = ["b"]\n[tool.poetry.dependencies]\npython = "3"\nc = "1"\n'))
    assert got == {("p/pyproject.toml", "core", "a"), ("p/pyproject.toml", "core", "c")}
    assert list(projects.project_rows("pyproject.toml", "[")) == []


def crashing(facts, lines, parsed, index):
    raise RuntimeError("no such thing")


def late(facts, lines, parsed, index):
    bad = F.udf(lambda x: 1 // 0, "string")
    return lines.select(F.lit("k").alias("kind"), bad("text").alias("subject"), F.lit("r").alias("ref"), "file", F.col("lineno").alias("line"), F.lit("reject").alias("level"), F.lit("w").alias("reason"), F.lit(False).alias("dynamic"))


def third(facts, lines, parsed, index):
    todo = lines.where(F.col("text").contains("TODO"))
    return todo.select(F.lit("todo").alias("kind"), F.lit("TODO").alias("subject"), F.lit("TODO").alias("ref"), "file", F.col("lineno").alias("line"), F.when(F.col("lineno") > 1, "reject").otherwise("odd").alias("level"), F.lit("left over").alias("reason"), F.lit(False).alias("dynamic"))


def test_oracles_are_loaded_and_isolated(spark):
    tree = tree_of(spark, {"a.go": "// TODO\nx := 1 // TODO\n", ".env.example": "A=\n"})
    here = "tests.test_gates"
    asked = plugins.oracles(["env_vars", f"{here}:third", f"{here}:crashing", f"{here}:late", "no_such_oracle"])
    added = spark.createDataFrame([("a.go", 1, "x"), ("a.go", 2, "TODO")], "file string, lineno long, text string")
    got = change.check_change(added, tree, oracles=asked)
    found = {(r.oracle, r.level) for r in got.collect()}
    assert found == {(f"{here}:third", "reject"), (f"{here}:crashing", "unverifiable"), (f"{here}:late", "unverifiable"), ("no_such_oracle", "unverifiable")}
    assert change.verdict(got.where(F.col("level") != "reject")).first()["blocking"] is False
    assert set(plugins.oracles()) == {"env_vars", "imports_lockfile", "routes"}


def test_runs_and_reports_are_evidence(spark):
    from groundwire.operators.claims import claims_from_json

    tree = tree_of(spark, {"r.xml": '<testsuite><testcase name="a"/></testsuite>', "e.xml": "<testsuite/>"})
    cases = [({"command": "make"}, "contradicted"), ({"report": "./r.xml"}, "proven"), ({"evidence": {"report": "e.xml", "exit_code": 0}}, "not_observed"), ({"report": "none.xml", "evidence": {"exit_code": 0}}, "not_observed"), ({"evidence": {"exit_code": 0}}, "plausible"), ({"evidence": {"output": "3 passed, 1 failed"}}, "contradicted")]
    text = json.dumps([{"kind": "tests_pass", **case} for case, _ in cases])
    asked = claims_from_json(spark.createDataFrame([(text,)], "j string"), "j")
    runs = spark.createDataFrame([("make", 0), (" make ", 2)], "command string, exit_code int")
    got = change.check_claims(asked, tree, runs=runs).orderBy("nth").collect()
    assert [r.reason for r in got] == [want for _, want in cases]


def plain_terms(text):
    out = set()
    for word in re.findall(r"[^\W\d_]\w*", text):
        out |= {word.lower(), *(p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", word) if len(p) > 1)}
    return out


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_recall_is_exact(spark, limit):
    r = random.Random(limit)
    words = ["the", "The", "getValue", "HTTPServer", "value", "rare", "x1", "été", "_y"]
    notes = [(f"n{i:04d}", " ".join(r.choices(words, [9, 1, 1, 1, 3, 0.05, 1, 1, 1], k=r.randint(0, 4))), " ".join(r.choices(words, [9, 1, 1, 1, 3, 0.02, 1, 1, 1], k=r.randint(0, 6))), [f"src/{r.choice(words)}.py"] if i % 3 == 0 else None, r.choice(["anchored", "stale", "invalid", None])) for i in range(700)]
    held = recall.Notebook(spark.createDataFrame(notes, "id string, title string, body string, locators array<string>, state string").repartition(4))
    queries = [(1, "the"), (2, "The value"), (3, "rare the"), (4, "server http"), (5, ""), (6, " 12 "), (7, "absent"), (8, None), (9, "ÉTÉ value getvalue")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for hidden in (False, True):
        want, counts = [], {}
        for q, query in queries:
            sought = plain_terms(query or "")
            found, over = [], 0
            for i, title, body, sources, state in notes:
                in_title, in_body = plain_terms(title), plain_terms(body + " " + " ".join(sources or []))
                if (query or "").strip() and not sought & (in_title | in_body):
                    continue
                if state in ("stale", "invalid") and not hidden:
                    over += 1
                else:
                    found.append((-2 * len(sought & in_title) - len(sought & in_body), i))
            counts[q] = (len(found), over, max(0, len(found) - limit))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:limit], 1)]
        assert sorted(map(tuple, held.recall(asked, limit, hidden).collect())) == want
        assert {r[0]: tuple(r)[1:] for r in held.matches(asked, limit, hidden).collect()} == counts


def test_common_words_read_few_blocks(spark):
    notes = spark.range(20_000).selectExpr("id", "if(id % 50 = 0, 'the', '') as title", "'the other' as body")
    held = recall.Notebook(notes)
    got = held.recall(spark.createDataFrame([(1, "the other")], "query_id long, query string"), 3)
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == [(0, 4), (50, 4), (100, 4)]
    assert held.postings.where("term = 'the'").select("block").distinct().count() > 150


def encoded(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def plain_budget(meta, items, budget):
    """Item by item, by writing the whole payload each time."""
    usage = {"max_bytes": budget * 4, "bytes": 0, "estimated_tokens": 0, "omitted": len(items), "token_estimate": "ceil(UTF-8 bytes / 4); model dependent"}
    out = {**meta, "items": [], "usage": usage}

    def size():
        for _ in range(8):
            n = len(encoded(out).encode())
            if (usage["bytes"], usage["estimated_tokens"]) == (n, -(-n // 4)):
                break
            usage["bytes"], usage["estimated_tokens"] = n, -(-n // 4)
        return len(encoded(out).encode())

    kept, fits = [], size() <= budget * 4
    for k, item in enumerate(items if fits else []):
        out["items"].append(item)
        usage["omitted"] = len(items) - len(out["items"])
        if size() > budget * 4:
            out["items"].pop()
            usage["omitted"] = len(items) - len(out["items"])
        else:
            kept.append(k)
    size()
    return kept, fits, usage["bytes"], usage["estimated_tokens"], usage["omitted"]


def test_budget_to_the_byte(spark):
    r = random.Random(8)
    groups = {f"g{k}": ({"operation": "recall", "query": "é" * r.randint(0, 30)} if k % 5 else {}, [{"id": j, "text": "ü" * r.choice([0, 3, 40, 300])} for j in range(r.choice([0, 1, 9, 30, 120]))]) for k in range(60)}
    groups["wide"] = ({"query": "x" * 2000}, [{"id": 1}])
    heads = spark.createDataFrame([(g, encoded(m)) for g, (m, _) in groups.items()], "group string, meta string")
    items = spark.createDataFrame([(g, k, encoded(x)) for g, (_, xs) in groups.items() for k, x in enumerate(xs)] + [("unknown", 0, "{}")], "group string, order long, text string")
    got = payload.bounded(items, heads, 256).collect()
    for g, (meta, xs) in groups.items():
        kept, fits, size, tokens, omitted = plain_budget(meta, xs, 256)
        own = [x for x in got if x.group == g]
        assert sorted(x.order for x in own if x.order is not None and x.kept) == kept
        assert [(x.kept, x.bytes, x.tokens, x.omitted) for x in own if x.order is None] == [(fits, size, tokens, omitted)]
    assert {x.group for x in got} == set(groups)


def test_stream_state_follows_the_batch(spark, tmp_path):
    source, target, cursor = (str(tmp_path / x) for x in ("in", "out", "at"))

    def batch(rows):
        spark.createDataFrame(rows, feed.CHANGE).write.mode("append").json(source)
        feed.follow_latest(feed.changes(spark, source), target, cursor).awaitTermination()

    batch([(k, 1, "c", f"file:{k}", "added") for k in range(1, 40)])
    batch([(90, 2, "d", "file:3", "removed"), (2, 2, "d", "file:5", "late"), (91, 2, "d", None, "x")])
    batch([(92, 3, "e", "file:3", "added"), (93, 3, "e", "file:3", "changed")])
    sizes = [spark.read.parquet(f"{target}/batch={k}").count() for k in range(3)]
    assert sizes == [39, 1, 1]  # what a batch moves on, not all that is known
    got = {r.node: (r.op, r.seq) for r in feed.read_latest(spark, target).collect()}
    assert len(got) == 39 and got["file:3"] == ("changed", 93) and got["file:5"] == ("added", 5)


def test_pools_bound_suggestions(spark):
    asked = spark.createDataFrame([("x", "get_value"), ("y", "get_value")], "pool string, name string")
    there = spark.createDataFrame([("x", "get_values"), ("y", "set_value"), ("y", "value_get"), ("z", "get_value_"), ("y", "value")], "pool string, candidate string")
    got = relations.did_you_mean(asked, there, "name", "candidate", 3, within=["pool"]).orderBy("pool", "rank").collect()
    assert [(r.pool, r.candidate) for r in got] == [("x", "get_values"), ("y", "set_value"), ("y", "value_get"), ("y", "value")]
