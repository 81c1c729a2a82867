"""Settings in layers, listings that prune, scopes, intervals, kinds of neighbours and merged lists."""

import json
import os
import random
import tomllib

import pytest

from groundwire.operators import change, graph, relations
from groundwire.sources import files, listing, settings


def test_nearest_layer_holds(spark):
    held = [
        ("r1", "user", "u.toml", 'block_on = "Review"\noracles = "env_vars, routes"\n[env_vars]\nambient = ["A"]\nkeep = 1\n'),
        ("r1", "repo", "g.toml", '[groundwire]\nexclude = ["gen", " "]\nblock_on = "never"\n[groundwire.env_vars]\nambient = ["B"]\n'),
        ("r2", "repo", ".g.json", '{"block_on": "maybe", "oracles": ["a", "a"]}'), ("r3", "repo", "g.toml", "x = ["), ("r4", "repo", "g.json", "[1]"), ("r5", "repo", "g.toml", "exclude = 3"), ("r6", "user", "g.json", ""), ("other", "repo", "g.toml", ""),
    ]
    layers = settings.read_settings(spark.createDataFrame(held, "repo string, layer string, path string, text string"))
    env = settings.environment_settings(spark, "r1", {"GROUNDWIRE_ORACLES": "routes,,mine:f", "PATH": "x", "GROUNDWIRE_STACK": ""})
    merged = settings.merged_settings(layers.unionByName(env), spark.createDataFrame([(f"r{k}",) for k in range(1, 7)], "repo string")).cache()
    assert settings.settings_of(merged, "r1") == {"oracles": ["routes", "mine:f"], "block_on": "never", "env_declared_in": [], "stack": [], "exclude": ["gen"], "per_oracle": {"env_vars": {"ambient": ["B"], "keep": 1}}}
    assert settings.settings_of(merged, "r6") == settings.DEFAULTS
    errors = {(r.repo, r.error) for r in merged.where("error is not null").collect()}
    assert {("r2", 'block_on cannot be "maybe"'), ("r2", "an oracle is listed twice"), ("r4", "the settings must be a table"), ("r5", "exclude must be a list of strings")} <= errors
    assert {r for r, _ in errors} == {"r2", "r3", "r4", "r5"}
    with pytest.raises(ValueError, match="r4"):
        settings.settings_of(merged, "r4")


def test_ignored_folders_are_never_opened(spark, tmp_path, monkeypatch):
    for path, text in {"a.py": "1", "src/b.py": "2", "src/deep/er/c.ts": "3", "node_modules/x/y.js": "4", "src/gen/d.py": "5", "src/big.txt": "x" * 50, "x.egg-info/PKG": "6", "src/nul.bin": "a\0b"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    os.symlink(tmp_path / "src", tmp_path / "loop")
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    want = {"a.py": "1", "src/b.py": "2", "src/deep/er/c.ts": "3", "src/big.txt": None, "src/nul.bin": None}
    for parts in (1, 2, 64):
        got = listing.read_tree(spark, str(tmp_path), exclude="gen", max_bytes=20, partitions=parts).collect()
        assert {r.path: r.text for r in got} == want and len(got) == len(want)
    some = listing.read_tree(spark, f"file://{tmp_path}", include="*.py,src/deep/*").collect()
    assert {r.path for r in some} == {"a.py", "src/b.py", "src/gen/d.py", "src/deep/er/c.ts"} and all(r.size == 1 for r in some)

    opened = []
    entries = listing.TreeReader._entries
    monkeypatch.setattr(listing.TreeReader, "_entries", lambda self, store, folder: opened.append(folder) or entries(self, store, folder))
    reader = listing.TreeReader({"path": str(tmp_path), "exclude": "gen"})
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert len(rows) == 5
    assert {os.path.relpath(x, tmp_path) for x in opened} == {".", "src", "src/deep", "src/deep/er"}


def test_methods_of_two_classes_stand_apart(spark):
    text = "import os\n\n\nclass A:\n    def load(self):\n        return os.environ['X']\n\n\nclass B:\n    def load(self):\n        def inner():\n            return os.environ['X']\n        return inner\n"
    tree = spark.createDataFrame([("m.py", text), (".env.example", "X=\n")], "path string, text string")
    edges = graph.context_edges(tree).cache()
    assert {r.a for r in edges.where("relation = 'reads_env'").collect()} == {"symbol:m.py:A.load", "symbol:m.py:B.load.inner"}
    assert {r.b for r in edges.where("relation = 'declares' and file = 'm.py'").collect()} == {f"symbol:m.py:{x}" for x in ("A", "A.load", "B", "B.load", "B.load.inner")}
    found = {(r.ref, r.node) for r in graph.roots_of(edges, spark.createDataFrame([(" A.load",), ("env:X",), ("X",), ("none",)], "ref string")).collect()}
    assert found == {("A.load", "symbol:m.py:A.load"), ("env:X", "env:X"), ("X", "env:X")}
    near, touched = graph.around(edges, spark.createDataFrame([("symbol:m.py:A.load",)], "node string"), 2, ["symbol"])
    assert {(r.node, r.hop) for r in near.collect()} >= {("symbol:m.py:A.load", 0), ("symbol:m.py:B.load.inner", 2)} and near.where("node like 'env:%'").isEmpty()
    assert touched.where("b = 'env:X'").count() >= 2
    notes = spark.createDataFrame([(1, "m.py"), (2, "other.py")], "id int, file string")
    assert [r.id for r in graph.notes_near(notes, near, edges).collect()] == [1]


def test_innermost_spans(spark):
    r = random.Random(7)
    spans = [(g, (s := r.randint(-50, 2000)), s + r.choice([0, 1, 3, 7, 64, 500, 4000]), f"s{k}") for k, g in enumerate("ab" * 150)] + [("a", 9, 3, "backwards")]
    points = [(g, k) for g in "abc" for k in range(-60, 2100, 7)]
    got = relations.innermost(spark.createDataFrame(points, "g string, at long"), spark.createDataFrame(spans, "g string, s long, e long, name string"), ["g"], "at", "s", "e", "name")
    want = {}
    for g, at in points:
        inside = [(e - s, name) for h, s, e, name in spans if h == g and s <= at <= e]
        if inside:
            want[g, at] = min(inside)[1]
    assert {(x.g, x.at): x.scope for x in got.collect()} == want


def test_items_as_they_first_come(spark):
    rows = [("q", 1, 0, "b"), ("q", 0, 1, "a"), ("q", 1, 1, "a"), ("q", 0, 0, "c"), ("q", 2, 0, None), ("p", 5, 5, "z"), ("q", 1, 2, "d")]
    got = relations.first_positions(spark.createDataFrame(rows, "g string, list int, place int, item string"), ["g"], "item", ["list", "place"], 3)
    assert sorted(map(tuple, got.collect())) == [("p", 1, "z"), ("q", 1, "c"), ("q", 2, "a"), ("q", 3, "b")]


def test_settings_reach_the_check(spark):
    tree = spark.createDataFrame([("a.rb", "x = ENV['ONLY_HERE']\n"), ("conf/names", "ONLY_HERE=\n")], "path string, text string")
    file = spark.createDataFrame([("r", "repo", "g.toml", 'env_declared_in = ["conf/names"]\noracles = ["env_vars"]\n')], "repo string, layer string, path string, text string")
    held = settings.settings_of(settings.merged_settings(settings.read_settings(file), spark.createDataFrame([("r",)], "repo string")), "r")
    added = files.region_lines(tree.where("path = 'a.rb'"))
    got = change.check_change_with(held, added, tree).collect()
    assert [(x.ref, x.level, x.oracle) for x in got] == [("ONLY_HERE", "accept", "env_vars")]
    assert change.check_change(added, tree).first()["level"] == "review"


def test_toml_values_survive(spark):
    text = 'a = 1\n[t]\nx = [1, 2.5, true, "s"]\n[t2."k.v"]\ny = "z"\n'
    rows = {(section, key): json.loads(value) for section, key, value, _ in settings.setting_rows("toml", text)}
    data = tomllib.loads(text)
    assert rows == {("t", "x"): data["t"]["x"], ("t2", "k.v"): data["t2"]["k.v"]}
