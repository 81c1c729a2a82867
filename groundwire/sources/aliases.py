"""Path aliases of script projects: `paths` and `baseUrl` of their compiler settings."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import per_row

# Strings stay, comments and commas before a closing bracket go.
_LENIENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)


def settings_rows(path: str, text: str | None):
    """(path, parent, pattern, base) of one settings file with comments; nothing from corrupt text."""
    try:
        data = json.loads(_LENIENT.sub(lambda m: m.group(1) or "", _LENIENT.sub(lambda m: m.group(0) if m.group(0) == "," else m.group(1) or "", text or "")))
        options = data.get("compilerOptions") or {}
        patterns, base, parent = options.get("paths") or {}, options.get("baseUrl"), data.get("extends")
        here = posixpath.dirname(path)
        if isinstance(parent, str) and parent.startswith("."):
            parent = posixpath.normpath(posixpath.join(here, parent))
            yield path, parent if parent.endswith(".json") else f"{parent}.json", None, None
        for pattern in patterns:
            yield path, None, pattern, None
        if isinstance(base, str):
            yield path, None, None, posixpath.normpath(posixpath.join(here, base)).strip("./") or "."
    except (ValueError, AttributeError, TypeError):
        return


def script_aliases(files: DataFrame, hops: int = 2) -> DataFrame:
    """(file, pattern, base) of tsconfig and jsconfig files (path, text), with those they extend, up to two up."""
    every = per_row(files.where(F.col("path").rlike(r"\.json$")), settings_rows, ["path", "text"], "path string, parent string, pattern string, base string")
    named = F.element_at(F.split("path", "/"), -1).rlike(r"^(ts|js)config(\..*)?\.json$")
    own = every.where("parent is null").select("path", "pattern", "base")
    up = every.where("parent is not null").select("path", "parent").distinct()
    found, at = own.select(F.col("path").alias("file"), "pattern", "base"), up.select(F.col("path").alias("file"), "parent")
    for _ in range(hops):
        found = found.unionByName(at.join(own.withColumnRenamed("path", "parent"), "parent").select("file", "pattern", "base"))
        at = at.join(up.select(F.col("path").alias("parent"), F.col("parent").alias("next")), "parent").select("file", F.col("next").alias("parent"))
    return found.withColumn("path", F.col("file")).where(named).drop("path").distinct()
