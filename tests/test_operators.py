import random

from pyspark.sql import functions as F

from groundwire.functions import text
from groundwire.operators import imports, notes, relations, routes
from groundwire.sources import files
from groundwire.streaming import feed


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_did_you_mean_finds_all_within_the_cap(spark):
    r = random.Random(1)
    names = ["".join(r.choice("abc") for _ in range(r.randint(1, 20))) for _ in range(150)]
    candidates = ["".join(r.choice("abc") for _ in range(r.randint(1, 20))) for _ in range(150)]
    n, c = spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in candidates], "c string")
    got = {(x.name, x["rank"]): (x.candidate, x.distance) for x in relations.did_you_mean(n, c, "n", "c").collect()}
    for name in set(names):
        cap = 4 if len(name) >= 16 else 3
        near = sorted((d - (x == name), d, x) for x in set(candidates) if x != name and (d := edit_distance(name, x)) <= cap)[:3]
        assert [got[name, k + 1] for k in range(len(near))] == [(x, d) for _, d, x in near]
        assert (name, len(near) + 1) not in got


def test_scrub_is_idempotent(spark):
    df = spark.createDataFrame([("password: 'hunter22' and bearer abcdefghijklmnop",)], "x string")
    once = text.scrub(F.col("x"))
    row = df.select(once.alias("a"), text.scrub(once).alias("b")).first()
    assert row.a == row.b and "hunter22" not in row.a and "abcdefghijklmnop" not in row.a


def test_diff_lines():
    diff = "--- a/x.py\n+++ b/x.py\n@@ -0,0 +1,2 @@\n+a\n++++ b\n@@@ -1 -1 +1 @@@\n++c\n--- /dev/null\n+++ y.txt\n@@ -0,0 +1 @@\n+z\n"
    assert list(files.added_lines(diff)) == [("x.py", 1, "a"), ("x.py", 2, "+++ b"), ("y.txt", 1, "z")]


def test_corrupt_manifests_declare_nothing():
    for name in ("package.json", "pyproject.toml", "setup.cfg", "Pipfile.lock", "package-lock.json"):
        assert [x[2:] for x in files.manifest_names(name, "{{{ [")] == [("", "error")]
    got = list(files.manifest_names("package-lock.json", '{"packages": {"": {}, "node_modules/@a/b": {}}, "dependencies": {"c": {"dependencies": {"d": {}}}}}'))
    assert [x[2] for x in got] == ["@a/b", "c", "d"]


def test_file_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "a.js").write_text("x")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "b.py").write_bytes("é\r\nz\n".encode())
    tree = files.read_files(spark, str(tmp_path))
    assert [(r.file, r.lineno, r.text) for r in files.region_lines(tree).orderBy("lineno").collect()] == [("src/b.py", 1, "é"), ("src/b.py", 2, "z")]


def test_change_feed_keeps_the_latest(spark, tmp_path):
    source, target, cursor = (str(tmp_path / x) for x in ("in", "out", "at"))
    rows = [(1, 1, "c", "file:a", "added"), (2, 1, "c", "file:b", "added")]
    spark.createDataFrame(rows, feed.CHANGE).write.json(source)
    feed.keep_latest(feed.changes(spark, source), target, cursor).awaitTermination()
    spark.createDataFrame([(3, 2, "d", "file:a", "removed")], feed.CHANGE).write.mode("append").json(source)
    feed.keep_latest(feed.changes(spark, source), target, cursor).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{target}/batch=1").collect()} == {("file:a", "removed", 3), ("file:b", "added", 2)}


def masked(text, style):
    """Character by character: the state is a quote, a line comment, a block comment or none."""
    out, state, i = [], "", 0
    while i < len(text):
        two, c = text[i : i + 2], text[i]
        step = 2 if (state == "block" and two == "*/") or (not state and style == "clike" and two in ("//", "/*")) or (len(state) == 1 and c == "\\" and len(two) == 2) else 1
        piece = text[i : i + step]
        if state == "line" and c == "\n":
            state = ""
        elif state in ("line", "block"):
            state = "" if two == "*/" and state == "block" else state
            piece = "".join(x if x == "\n" else " " for x in piece)
        elif state:
            state = "" if piece == state else state
        elif c in "'\"`":
            state = c
        elif style == "clike" and two in ("//", "/*"):
            state, piece = "line" if two == "//" else "block", "  "
        elif style == "hash" and c == "#":
            state, piece = "line", " "
        out.append(piece)
        i += step
    return "".join(out)


def test_masking_keeps_places(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab'\"`\\/*#\n ") for _ in range(r.randint(0, 60))) for _ in range(600)] + ['"' + "x\\n" * 50_000 + '" // c', "/*" + "* x\n" * 50_000, "é // ü", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(len(texts), None)], "i int, x string")
    rows = df.select("i", "x", text.mask_comments(F.col("x")).alias("c"), text.mask_comments(F.col("x"), "hash").alias("h")).collect()
    for row in rows:
        want = (None, None) if row.x is None else (masked(row.x, "clike"), masked(row.x, "hash"))
        assert (row.c, row.h) == want


def service(main, **modules):
    return [("m.py", "from fastapi import FastAPI, APIRouter\n" + main), *((f"{k}.py", "from fastapi import APIRouter\n" + v) for k, v in modules.items())]


def test_router_chains(spark):
    five = {f"r{i}": f"import r{i + 1}\nfrom . import r{i + 1}\nrouter = APIRouter(prefix='/p{i}')\nrouter.include_router(r{i + 1}.router, prefix='/i{i}')\n@router.get('/x{i}')\ndef f{i}(): pass\n" for i in range(1, 6)}
    five["r6"] = "router = APIRouter()\n@router.get('/last')\ndef g(): pass\n"
    tree = service("from r1 import router as first\napp = FastAPI()\napp.include_router(first, prefix='/api')\napp.include_router(first, prefix=V)\napp.include_router(gone.router)\n", **five)
    tree.append(("alone.py", "from fastapi import APIRouter\nrouter = APIRouter(prefix='/own')\n@router.post('/y')\ndef h(): pass\n"))
    got = {(r.method, r.full, r.handler) for r in routes.resolved_routes(spark.createDataFrame(tree, "path string, text string")).collect()}
    known = {(m, f) for m, f, _ in got if f}
    assert known == {
        ("GET", "/api/p1/x1"), ("GET", "/api/p1/i1/p2/x2"), ("GET", "/api/p1/i1/p2/i2/p3/x3"), ("GET", "/api/p1/i1/p2/i2/p3/i3/p4/x4"), ("POST", "/own/y"),
    }
    assert {h for _, f, h in got if f is None} >= {"f1", "f5", "g", "router"}


def test_open_tables_prove_no_absence(spark):
    table = spark.createDataFrame([("GET", "/a/{id}", "/a/{id}", "one", False, "f"), ("GET", None, "/b/{x}", "two", False, "f")], "method string, full string, tail string, handler string, dynamic boolean, file string")
    asked = spark.createDataFrame([("GET /a/{other}", None), ("* /a/{id}/", "one"), ("/a/{id}", "x"), ("GET /v1/b/{y}", None), ("GET /c", None), (None, None)], "subject string, handler string")
    grade = lambda t: {(r.subject, r.handler): (r.level, r.reason) for r in routes.check_route_claims(asked, t).collect()}
    assert grade(table) == {
        ("GET /a/{other}", None): ("accept", "registered"), ("* /a/{id}/", "one"): ("accept", "registered"), ("/a/{id}", "x"): ("reject", "handled by another"),
        ("GET /v1/b/{y}", None): ("review", "under an unresolved prefix"), ("GET /c", None): ("review", "dynamic registration"),
    }
    assert set(grade(table.limit(0)).values()) == {("unverifiable", "no routes")}


def test_the_nearest_project_proves_absence(spark):
    sources = spark.createDataFrame([("uv.lock", "lockfile"), ("a/pyproject.toml", "manifest"), ("a/b/uv.lock", "lockfile"), ("a/b/pyproject.toml", "manifest")], "file string, kind string")
    asked = spark.createDataFrame([(x,) for x in ("m.py", "z/m.py", "a/m.py", "a/bb/m.py", "a/b/c/m.py")], "file string")
    assert {r.file: r.locked for r in imports.lock_reach(asked, sources).collect()} == {"m.py": True, "z/m.py": True, "a/m.py": False, "a/bb/m.py": False, "a/b/c/m.py": True}
    assert not any(r.locked for r in imports.lock_reach(asked, sources.limit(0)).collect())


def test_no_manifest_is_unverifiable(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    asked = spark.createDataFrame([("a.ts", "left-pad", None), ("a.ts", "fs", False)], "file string, subject string, optional boolean")
    got = imports.check_script_imports(asked, empty("file string, dist string, kind string"), empty("name string"), empty("pattern string, base string"), empty("path string"), empty("name string"))
    assert {r.subject: r.level for r in got.collect()} == {"left-pad": "unverifiable", "fs": "accept"}


def test_export_stops_where_import_skips(spark):
    rows = [(f"n{i}", "t", "x" * n, "note", 0) for i, n in enumerate((10, 900, 10))]
    notes_df = spark.createDataFrame(rows, "id string, title string, text string, kind string, created int")
    page = notes.export_page(notes_df, 3, 0, 100).collect()
    assert [(r.id, r.has_more, r.next_offset) for r in page] == [("n0", True, 1)]
    secret = [(0, "a", "password: 'hunter22'", "body", None, None), (1, "a", "t", "b", "note", 1), (2, None, "t", "b", "note", 1), (3, "b", "t", "", "note", 1)]
    got = notes.import_notes(spark.createDataFrame(secret, "record long, id string, title string, text string, kind string, created long"), spark.createDataFrame([], "id string"), prefix="old-").orderBy("record").collect()
    assert [(r.action, r.reason, r.redactions) for r in got[:2]] == [("ready", None, 1), ("duplicate", None, 0)] and "hunter22" not in got[0].title and got[0].id.startswith("old-")
    assert [(r.action, r.reason) for r in got[2:]] == [("skipped", "id"), ("skipped", "text")]
