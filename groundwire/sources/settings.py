"""Settings in layers: what a user, a repository and the environment say, of which the nearest layer holds for each key."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import per_row

#: Layers, the later ones win; defaults are below all.
LAYERS = ("default", "user", "repo", "environment")
LISTS = ("oracles", "env_declared_in", "stack", "exclude")
BLOCKS = ("reject", "review", "never")
DEFAULTS = {"oracles": ["env_vars", "imports_lockfile", "routes"], "block_on": "reject", "env_declared_in": [], "stack": [], "exclude": []}
#: Names of the environment that set a key, and the table of a shared file that is this library's own.
PREFIX, SECTION = "GROUNDWIRE_", "groundwire"
ROW = "section string, key string, value string, error string"


def _listed(value, key: str) -> list[str]:
    """A list of names, or one text with commas."""
    if isinstance(value, str):
        value = value.split(",")
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{key} must be a list of strings")
    return [x.strip() for x in value if x.strip()]


def setting_rows(format_: str, text: str | None):
    """(section, key, value, error) of one TOML or JSON file; a file that cannot be used gives one row with the error.

    Values are JSON.  Keys of the file itself have an empty section, those of its tables the table's name.
    """
    try:
        data = (json.loads(text) if format_ == "json" else tomllib.loads(text)) if (text or "").strip() else {}
        data = data.get(SECTION, data) if isinstance(data, dict) else None
        if not isinstance(data, dict):
            raise ValueError("the settings must be a table")
        rows = []
        for key, value in data.items():
            if isinstance(value, dict):
                rows += [(key, inner, json.dumps(x, sort_keys=True, default=str), None) for inner, x in value.items()]
            elif key in LISTS:
                rows.append(("", key, json.dumps(_listed(value, key)), None))
            elif key == "block_on":
                rows.append(("", key, json.dumps(str(value).lower()), None))
        yield from rows
    except ValueError as error:
        yield "", "", None, str(error)[:200]


def read_settings(files: DataFrame) -> DataFrame:
    """(repo, layer, section, key, value, error) of settings files (repo, layer, path, text)."""
    named = files.withColumn("format", F.when(F.col("path").endswith(".json"), "json").otherwise("toml")).withColumn("place", F.concat_ws("\0", "repo", "layer"))
    # the parser sees one file a row and passes its repository through
    def rows(place, format_, text):
        for row in setting_rows(format_, text):
            yield (place, *row)

    got = per_row(named, rows, ["place", "format", "text"], f"place string, {ROW}")
    parts = F.split("place", "\0")
    return got.select(parts[0].alias("repo"), parts[1].alias("layer"), "section", "key", "value", "error")


def environment_settings(spark: SparkSession, repo: str, environ: Mapping[str, str]) -> DataFrame:
    """The layer of the environment, from a process's variables."""
    rows = []
    for key in (*LISTS, "block_on"):
        given = environ.get(PREFIX + key.upper())
        if given:
            rows.append((repo, "environment", "", key, json.dumps(_listed(given, key) if key in LISTS else given.strip().lower()), None))
    return spark.createDataFrame(rows, f"repo string, layer string, {ROW}")


def merged_settings(layers: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, section, key, value, layer, error): each key of each repository (repo) as its nearest layer has it.

    Keys that no layer sets have their default.  error tells of a file that cannot be used, which then counts as absent, and
    of a value that is not allowed: another block_on than reject, review or never, or an oracle that is listed twice.
    """
    spark = repos.sparkSession
    usual = spark.createDataFrame([("", k, json.dumps(v)) for k, v in DEFAULTS.items()], "section string, key string, value string")
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    base = repos.select("repo").distinct().crossJoin(F.broadcast(usual)).withColumns({"layer": F.lit("default"), "error": F.lit(None).cast("string")})
    rows = base.unionByName(layers.join(repos.select("repo").distinct(), "repo", "left_semi").select(*base.columns))
    good = rows.where("error is null and value is not null").groupBy("repo", "section", "key").agg(F.max_by(F.struct("value", "layer"), rank).alias("x")).select("repo", "section", "key", "x.value", "x.layer")
    listed = F.from_json("value", "array<string>")
    wrong = F.when((F.col("section") == "") & (F.col("key") == "block_on") & ~F.col("value").isin(*(json.dumps(x) for x in BLOCKS)), F.concat(F.lit("block_on cannot be "), "value"))
    wrong = wrong.when((F.col("section") == "") & (F.col("key") == "oracles") & (F.size(listed) > F.size(F.array_distinct(listed))), F.lit("an oracle is listed twice"))
    bad = rows.where("error is not null").select("repo", F.lit("").alias("section"), F.lit("").alias("key"), F.lit(None).cast("string").alias("value"), "layer", "error")
    return good.withColumn("error", wrong).unionByName(bad)


def settings_of(merged: DataFrame, repo: str) -> dict:
    """One repository's settings as Python values; raises where they hold an error."""
    rows = merged.where(F.col("repo") == repo).collect()  # a row for each key of one repository
    for r in rows:
        if r["error"]:
            raise ValueError(f"{repo}: {r['error']}")
    out: dict = {}
    for r in rows:
        (out.setdefault("per_oracle", {}).setdefault(r["section"], {}) if r["section"] else out)[r["key"]] = json.loads(r["value"])
    return out
