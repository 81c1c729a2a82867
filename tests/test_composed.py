"""Composed operators on small trees: what SQL over whole tables does not show."""

import difflib

from groundwire.operators import change, evidence, graph, index
from groundwire.sources import files, sample


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_close_matches_equal_the_library(spark):
    names = ["alpha", "alpah", "alphabet", "beta", "gamma", "gama", "alpaa", "", "alp"]
    refs = ["alpha", "gamm", "zzz", "alpah"]
    got = {}
    for r in graph.close_matches(frame(spark, [(x,) for x in refs], "ref string"), frame(spark, [(x,) for x in [*names, None]], "node string")).collect():
        got.setdefault(r.ref, []).append((r["rank"], r.node))
    for ref in refs:
        assert [x for _, x in sorted(got.get(ref, []))] == difflib.get_close_matches(ref, names, n=3)


def test_fragments_and_documentation(spark):
    tree = sample.tree(spark)
    added = [
        ("app/config.py", 5, 'URL = os.environ["DATABASE_URL"]'),  # as in the tree
        ("app/new.py", 40, "    x = os.getenv(name)"),  # a fragment that does not parse by itself
        ("app/new.py", 41, 'y = os.environ["GONE"]'),
        ("app/more.py", 7, "import nowhere"),
        ("docs/a.py", 1, 'z = os.environ["GONE_TOO"]'),
        ("web/a.ts", 3, "const k = process.env.GONE_JS"),
        (None, 1, "import x"),
        ("app/none.py", 1, None),
    ]
    got = {(r.file, r.line, r.subject): r.level for r in change.check_change(frame(spark, added, "file string, lineno int, text string"), tree).collect()}
    assert got == {
        ("app/config.py", 5, "DATABASE_URL"): "accept",
        ("app/new.py", 40, "<dynamic>"): "review",
        ("app/new.py", 41, "GONE"): "reject",
        ("app/more.py", 7, "nowhere"): "reject",
        ("docs/a.py", 1, "GONE_TOO"): "review",
        ("web/a.ts", 3, "GONE_JS"): "reject",
    }
    assert change.check_change(frame(spark, [], "file string, lineno int, text string"), tree).count() == 0


def test_route_edges_of_many_kinds(spark):
    text = {
        "a.py": "from lib import *\n@router.get('/x')\ndef f(): pass\n",
        "b.py": "@nobody.get('/x')\ndef f(): pass\n",
        "c.py": "import lib\nfrom lib import have, lack\nimport far\ndef setup(app, handler):\n    app.add_api_route('/1', handler)\napp.add_api_route('/2', have)\napp.add_api_route('/3', lack)\napp.add_api_route('/4', lib.have)\napp.add_api_route('/5', far.f)\napp.add_api_route('/6', lib)\napp.add_api_route('/7', make())\nobj = 1\napp.add_api_route('/8', obj.f)\napp.add_api_route('/9', have.inner)\n",
        "lib.py": "def have(): pass\n",
    }
    tree = frame(spark, list(text.items()), "path string, text string")
    held = change.Index(tree)
    from groundwire.operators.routes import check_route_edges

    got = {(r.file, r.subject): r.level for r in check_route_edges(held.facts, tree).collect()}
    assert got[("a.py", "GET /x")] == "review" and got[("b.py", "GET /x")] == "reject"
    assert [got["c.py", f"GET /{k}"] for k in range(1, 10)] == ["accept", "accept", "reject", "accept", "review", "review", "review", "review", "review"]


def test_report_counts():
    read = lambda x: list(evidence.report_counts("r", x))
    assert read(None) == [] and read("<a/>") == [] and read("<testsuite") == []
    assert read('<testsuite tests="3" failures="1" skipped="1"/>') == [("r", 2, 1, 0)]
    assert read('<testsuites><testsuite tests="9"><testsuite tests="2"><testcase/><testcase><error/></testcase></testsuite></testsuite></testsuites>') == [("r", 2, 0, 1)]
    assert read('<testsuite tests="-1"/>') == [] and read('<testsuite tests="x"/>') == []


def test_readable_and_no_change(spark):
    rows = frame(spark, [("a.py", "x"), ("b.py", "nul\0"), ("c.py", "y" * 600_000), ("d.bin", "z")], "path string, text string")
    got = {r.path: r.ok for r in rows.select("path", index.readable(rows.text).isNotNull().alias("ok")).collect()}
    assert got == {"a.py": True, "b.py": False, "c.py": False, "d.bin": True}
    assert index.changed_files(rows, rows).isEmpty()
    assert {r.path for r in index.select_files(rows).collect()} == {"a.py", "b.py", "c.py"}


def test_private_dotenv_is_not_read(spark):
    assert "PRIVATE_KEY" not in {r.name for r in files.declared_env(sample.tree(spark)).collect()}
    assert "PRIVATE_KEY" in {r.name for r in files.declared_env(sample.tree(spark), configured=(".env",)).collect()}
