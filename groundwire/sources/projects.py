"""Projects within a tree: their source roots, own modules, mandatory dependencies, and where a module lies."""

from __future__ import annotations

import configparser
import json
import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_norm
from ..runtime import per_row
from .files import MANIFEST, _requirement

# Files that make a folder a Python project; folders that hold sources anyway.
PROJECT_MARKERS = ("pyproject.toml", "setup.cfg", "setup.py", "Pipfile", "requirements.txt", "requirements-dev.txt", "manage.py")
DEFAULT_ROOTS = ("", "src", "lib")
IDENTIFIER = r"^[\p{L}_][\p{L}\p{N}_]*$"


def folder(path: Column) -> Column:
    """The folder of a path, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parents(path: Column) -> Column:
    """All folders around a path, the root as an empty name."""
    dirs = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(dirs) - 1), lambda i: F.array_join(F.slice(dirs, F.lit(1), i), "/"))


def _at(data, *keys, kind=dict):
    """The value below nested tables, or an empty one where it is missing or of another kind."""
    for key in keys:
        data = data.get(key) if isinstance(data, dict) else None
    return data if isinstance(data, kind) else kind()


def _own_names(base: str, data: dict):
    if base == "pyproject.toml":
        yield from (_at(data, "project", "name", kind=str), _at(data, "tool", "poetry", "name", kind=str))
    elif base == "package.json":
        yield _at(data, "name", kind=str)
    else:
        yield _at(data, "name", kind=str)
        yield from (_at(x, "name", kind=str) for key, x in _at(data, "packages").items() if key and "node_modules/" not in key)


def _mandatory(base: str, text: str):
    """Requirements without which a project does not run."""
    if base == "pyproject.toml":
        data = tomllib.loads(text)
        yield from map(_requirement, _at(data, "project", "dependencies", kind=list))
        yield from (x for x in _at(data, "tool", "poetry", "dependencies") if x != "python")
    elif base == "setup.cfg":
        yield from map(_requirement, _config(text).get("options", "install_requires", fallback="").splitlines())
    elif base == "Pipfile":
        yield from _at(tomllib.loads(text), "packages")
    elif base.startswith("requirements"):
        yield from map(_requirement, text.splitlines())


def _config(text: str) -> configparser.ConfigParser:
    out = configparser.ConfigParser()
    out.read_string(text)
    return out


def _package_folders(base: str, text: str):
    """Folders that packaging tables name as holding packages."""
    if base == "setup.cfg":
        config = _config(text)
        yield from (x.partition("=")[2] for x in config.get("options", "package_dir", fallback="").splitlines() if "=" in x)
        yield from config.get("options.packages.find", "where", fallback="").split(",")
    elif base == "pyproject.toml":
        tool = _at(tomllib.loads(text), "tool")
        yield from _at(tool, "setuptools", "package-dir").values()
        yield from _at(tool, "setuptools", "packages", "find", "where", kind=list)
        yield from (_at(x, "from", kind=str) for x in _at(tool, "poetry", "packages", kind=list))
        yield from (x.rpartition("/")[0] for x in _at(tool, "hatch", "build", "targets", "wheel", "packages", kind=list) if isinstance(x, str))
        searched = _at(tool, "pytest", "ini_options").get("pythonpath", [])
        yield from [searched] if isinstance(searched, str) else searched


def project_rows(path: str, text: str | None):
    """(file, kind, name) of one manifest: `own` names, `core` requirements, `root` folders;
    nothing of one that cannot be read."""
    base, home = path.rpartition("/")[2], path.rpartition("/")[0]
    try:
        if text is None:
            return
        if base in ("pyproject.toml", "package.json", "package-lock.json", "npm-shrinkwrap.json"):
            data = tomllib.loads(text) if base.endswith(".toml") else json.loads(text)
            yield from ((path, "own", x) for x in sorted(set(_own_names(base, data)) - {""}))
        yield from ((path, "core", x) for x in sorted({x for x in _mandatory(base, text) if x}))
        below = {x.strip().strip("./") for x in _package_folders(base, text) if isinstance(x, str)} - {""}
        yield from ((path, "root", f"{home}/{x}" if home else x) for x in sorted(below))
    except (ValueError, TypeError, AttributeError, configparser.Error):
        return


def project_facts(tree: DataFrame) -> DataFrame:
    """(file, kind, name) of all manifests of a tree (path, text)."""
    named = tree.where(F.element_at(F.split("path", "/"), -1).rlike(MANIFEST))
    return per_row(named, project_rows, ["path", "text"], "file string, kind string, name string")


def source_roots(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """(root): folders from which Python imports resolve: the usual ones, each Python project's and its `src`, and those declared.

    paths: path, of all files; facts: `project_facts` of them.
    """
    base = F.element_at(F.split("path", "/"), -1)
    home = paths.where(base.rlike(MANIFEST) & ~base.rlike(r"\.json$|^yarn\.lock$|^pnpm-lock")).select(folder(F.col("path")).alias("home")).distinct()
    own = home.select(F.explode(F.array("home", F.when(F.col("home") == "", "src").otherwise(F.concat("home", F.lit("/src"))))).alias("root"))
    usual = paths.sparkSession.createDataFrame([(x,) for x in DEFAULT_ROOTS], "root string")
    return usual.unionByName(own).unionByName(facts.where("kind = 'root'").select(F.col("name").alias("root"))).distinct()


def local_modules(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(name): what can be imported from a source root: each path meets the roots among its folders."""
    dirs = F.split("path", "/")
    seen = paths.where("path like '%.py'").select(F.posexplode(parents(F.col("path"))).alias("at", "root"), dirs.alias("dirs"))
    head = F.element_at("dirs", F.col("at") + 1)
    seen = seen.select("root", F.when(F.col("at") + 1 == F.size("dirs"), F.regexp_replace(head, r"\.py$", "")).otherwise(head).alias("name")).distinct()
    return seen.join(roots, "root", "left_semi").where(F.col("name").rlike(IDENTIFIER)).select("name").distinct()


def nested_packages(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(name): packages deeper in the tree, importable only with help."""
    deep = paths.where("path like '%/%/__init__.py'").select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct()
    return deep.where(F.col("name").rlike(IDENTIFIER)).join(modules, "name", "left_anti")


def workspace_packages(facts: DataFrame) -> DataFrame:
    """(name): Node packages of the tree itself: what any manifest calls its own, in a workspace or not."""
    return facts.where("kind = 'own'").where(F.col("file").rlike(r"\.json$")).select("name").distinct()


def own_names(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, name) of what a tree provides itself: `module`, `nested` and `package`."""
    modules = local_modules(paths, source_roots(paths, facts))
    named = facts.where("kind = 'own'").where(F.col("file").rlike(r"\.toml$")).select(module_norm(F.col("name")).alias("name"))
    parts = {"module": modules.unionByName(named).distinct(), "nested": nested_packages(paths, modules), "package": workspace_packages(facts)}
    return reduce(DataFrame.unionByName, (x.select(F.lit(kind).alias("kind"), "name") for kind, x in parts.items()))


def search_roots(files: DataFrame, tree: DataFrame) -> DataFrame:
    """(file, roots): folders from which a file's absolute imports resolve, in order: the projects around it from the inside, then the usual ones."""
    marked = tree.where(F.element_at(F.split("path", "/"), -1).isin(*PROJECT_MARKERS)).select(folder(F.col("path")).alias("dir")).where("dir <> ''").distinct()
    around = files.select("file").distinct().select("file", F.explode(parents(F.col("file"))).alias("dir")).join(marked, "dir")
    # as many as a path has folders
    near = around.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(F.length("dir").alias("n"), "dir")), asc=False).alias("x"))
    usual = F.array(*map(F.lit, DEFAULT_ROOTS))
    roots = F.array_union(F.flatten(F.transform(F.col("x.dir"), lambda d: F.array(d, F.concat(d, F.lit("/src"))))), usual)
    return files.select("file").distinct().join(near, "file", "left").select("file", F.coalesce(roots, usual).alias("roots"))


def module_homes(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """(file, module, home): the tree's file of each module that a file (file, module) names, by dots or from the roots around it; absent where there is none."""
    one = asked.where("module is not null").select("file", "module").distinct()
    one = one.join(search_roots(one, tree), "file")
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    dirs = F.split("file", "/")
    above = F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - dots, F.lit(0))), "/")
    inner = F.array_join(F.filter(F.split("module", r"\."), lambda x: x != ""), "/")
    starts = F.when(dots > 0, F.array(above)).otherwise(F.col("roots"))
    places = F.flatten(F.transform(starts, lambda r: F.transform(F.array(F.lit(".py"), F.lit("/__init__.py")), lambda end: F.concat(F.concat_ws("/", F.nullif(r, F.lit("")), F.nullif(inner, F.lit(""))), end))))
    tried = one.select("file", "module", F.posexplode(places).alias("nth", "home"))
    return tried.join(tree.select(F.col("path").alias("home")).distinct(), "home").groupBy("file", "module").agg(F.min_by("home", "nth").alias("home"))
