"""Misspellings, edits, stacks and checkpoints beside notes, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from groundwire.functions import text as texts
from groundwire.operators import change, mutation, notes
from groundwire.sources import sample, stack


def test_typo_gives_another_name_of_the_same_form(spark):
    names = ["A", "ab", "API_KEY", "x1", "left-pad", "a.b", "aaaa", "Z9", "requests"]
    rows = spark.createDataFrame([(n, f"{n} {k}") for n in names for k in range(40)], "name string, key string")
    got = rows.withColumn("typo", mutation.typo(F.col("name"), F.col("key"))).collect()
    seen = {}
    for r in got:
        form = mutation.IDENTIFIER if re.match(mutation.IDENTIFIER, r.name) else mutation.PACKAGE
        assert r.typo != r.name and re.match(form, r.typo)
        assert abs(len(r.typo) - len(r.name)) <= 1
        seen.setdefault(r.name, set()).add(len(r.typo) - len(r.name))
    assert seen["API_KEY"] == {-1, 0, 1} and -1 not in seen["x1"]
    again = rows.withColumn("typo", mutation.typo(F.col("name"), F.col("key"))).collect()
    assert [r.typo for r in got] == [r.typo for r in again]


def test_struck_lines(spark):
    cases = [
        ("env_vars", 'X = KEY or os.environ["KEY"], KEY', "KEY", "KYE", 'X = KEY or os.environ["KYE"], KEY'),
        ("env_vars", "process.env.KEY + KEYS", "KEY", "KYE", "process.env.KYE + KEYS"),
        ("imports_lockfile", "import a.req, req", "req", "rqe", "import a.req, rqe"),
        ("imports_lockfile", "require('req/x')", "req", "rqe", "require('rqe/x')"),
        ("imports_lockfile", "from 're.q'", "re.q", "r.eq", "from 'r.eq'"),
        ("routes", "app.add('/go', go)", "go", "og", "app.add('/go', og)"),
        ("routes", "app.go()", "go", "og", None),
        ("routes", None, "go", "og", None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, oracle string, text string, name string, other string, want string")
    for r in rows.withColumn("got", mutation.struck(F.col("text"), F.col("oracle"), F.col("name"), F.col("other"))).collect():
        assert r.got == r.want, r


def test_run_on_the_sample(spark):
    tree = sample.tree(spark)
    run = mutation.mutations(tree, seed=7, count=50)
    rows = run.collect()
    by = {x: {r.name for r in rows if r.oracle == x} for x in ("env_vars", "imports_lockfile", "routes")}
    # LOG_LEVEL has a fallback; yaml comes under another name; decorated routes define themselves
    assert by["env_vars"] == {"DATABASE_URL", "API_KEY", "REDIS_URL", "SMTP_HOST"}
    assert by["imports_lockfile"] == {"fastapi", "requests", "sqlalchemy"}
    assert by["routes"] == {"health", "metrics"}
    assert all(r.struck and r.detected and r.blocked and r.suggested for r in rows), [r for r in rows if not r.suggested]
    few = {(r.oracle, r.file, r.line, r.name, r.mutated) for r in mutation.mutations(tree, seed=7, count=2).collect()}
    assert len(few) == 6 and few <= {(r.oracle, r.file, r.line, r.name, r.mutated) for r in rows}


def test_a_new_file_binds_its_own_handlers(spark):
    text = ["def here(): pass", "def setup(app):", "    app.add_api_route('/a', here)", "    app.add_api_route('/b', gone)"]
    added = spark.createDataFrame([("app/fresh.py", i, x) for i, x in enumerate(text, 1)], "file string, lineno int, text string")
    got = {r.ref: r.level for r in change.check_change(added, sample.tree(spark)).collect()}
    assert got["here"] == "accept" and got["gone"] == "reject"


def plain(text, edits):
    if text is None:
        return "\n".join(new or "" for _, new, _ in edits)
    for old, new, every in edits:
        text = text + (new or "") if not old else text.replace(old, new or "", -1 if every else 1)
    return text


def test_edits_equal_a_loop(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab\n$\\é") for _ in range(rng.randint(0, n)))
    rows = [(i, None if i % 17 == 0 else word(30), [(word(2) if k % 4 else None, word(3) if k % 5 else None, rng.choice([True, False, None])) for k in range(rng.randint(0, 4))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, text string, edits array<struct<old: string, new: string, all: boolean>>")
    got = {r.i: r.x for r in df.select("i", texts.edited(F.col("text"), F.col("edits")).alias("x")).collect()}
    assert got == {i: plain(text, edits) for i, text, edits in rows}


def test_stack(spark):
    tree = spark.createDataFrame([("requirements.txt", "x\nFASTAPI\n"), ("package.json", None), ("sub/go.mod", ""), ("Gemfile", "")], "path string, text string")
    tags = lambda df: sorted(r.tag for r in df.collect())
    assert tags(stack.detect_stack(tree)) == ["fastapi", "node", "python", "ruby"]
    assert tags(stack.detect_stack(tree, pinned=["b", "a", "a"])) == ["a", "b"]
    assert tags(stack.detect_stack(tree.limit(0))) == []


def test_beside_notes(spark):
    held = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    handoffs = spark.createDataFrame([(1, "e", "f"), (2, "e", None)], "id int, evidence string, fingerprint string")
    got = {r.id: (r.evidence, r.current) for r in notes.beside_notes(held, handoffs, spark.createDataFrame([("f",)], "fingerprint string")).collect()}
    assert got == {1: ("e", True), 2: ("e", False), 3: (None, None), None: (None, None)}
