"""Ladders of import claims: joins against what a tree and its manifests provide, then ordered rungs."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_norm, top_level
from ..sources.projects import folder, parents

# Modules whose distribution has another name.
ALIASES = (
    ("yaml", "pyyaml"), ("sklearn", "scikit_learn"), ("PIL", "pillow"), ("bs4", "beautifulsoup4"), ("dateutil", "python_dateutil"), ("psycopg2", "psycopg2_binary"),
    ("cv2", "opencv_python"), ("cv2", "opencv_python_headless"), ("cv2", "opencv_contrib_python"), ("attr", "attrs"), ("attrs", "attrs"), ("msgpack", "msgpack_python"), ("msgpack", "msgpack"),
    ("dotenv", "python_dotenv"), ("google", "protobuf"), ("google", "google_api_core"), ("google", "google_auth"), ("google", "google_cloud_storage"), ("google", "googleapis_common_protos"),
    ("jose", "python_jose"), ("jwt", "pyjwt"), ("rest_framework", "djangorestframework"), ("pkg_resources", "setuptools"), ("multipart", "python_multipart"), ("faker", "faker"), ("pymysql", "pymysql"),
    ("MySQLdb", "mysqlclient"), ("Crypto", "pycryptodome"), ("Cryptodome", "pycryptodomex"), ("OpenSSL", "pyopenssl"), ("magic", "python_magic"), ("ruamel", "ruamel_yaml"), ("zope", "zope_interface"),
    ("backports", "backports_zoneinfo"), ("git", "gitpython"), ("github", "pygithub"), ("gi", "pygobject"), ("wx", "wxpython"), ("serial", "pyserial"), ("usb", "pyusb"), ("docx", "python_docx"),
    ("pptx", "python_pptx"), ("fitz", "pymupdf"), ("cairo", "pycairo"), ("Levenshtein", "python_levenshtein"), ("Levenshtein", "levenshtein"), ("slugify", "python_slugify"), ("markdown", "markdown"),
    ("nacl", "pynacl"), ("snowflake", "snowflake_connector_python"), ("websocket", "websocket_client"), ("socks", "pysocks"), ("ldap", "python_ldap"), ("memcache", "python_memcached"), ("playhouse", "peewee"),
    ("flask_sqlalchemy", "flask_sqlalchemy"), ("sqlalchemy", "sqlalchemy"), ("typing_extensions", "typing_extensions"), ("importlib_metadata", "importlib_metadata"), ("tree_sitter", "tree_sitter"),
    ("mcp", "mcp"), ("pydantic_settings", "pydantic_settings"), ("azure", "azure_core"), ("azure", "azure_identity"), ("azure", "azure_storage_blob"), ("win32api", "pywin32"), ("win32con", "pywin32"),
    ("pythoncom", "pywin32"), ("googleapiclient", "google_api_python_client"),
)


# Modules that Node has itself.
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http",
    "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys",
    "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib", "test", "sqlite",
)
# Specifiers that a framework resolves, if its package is listed.
FRAMEWORK_PREFIXES = (
    ("@docusaurus/core", "@site/"), ("@docusaurus/core", "@theme/"), ("@docusaurus/core", "@generated/"), ("@docusaurus/core", "@docusaurus/"),
    ("@sveltejs/kit", "$lib/"), ("@sveltejs/kit", "$app/"), ("@sveltejs/kit", "$env/"), ("@sveltejs/kit", "$service-worker"),
    ("nuxt", "#app"), ("nuxt", "#imports"), ("nuxt", "#components"), ("astro", "astro:"), ("vite", "virtual:"), ("next", "next/"), ("@angular/core", "@angular/"),
)
# Endings that a script module may have.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".json")


def lock_reach(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, locked): whether the nearest folder around a file that has a source also has a lockfile.

    claims: file; sources: file, kind (manifest or lockfile).  A lockfile proves absence for its own project only.
    """
    held = sources.select(folder(F.col("file")).alias("dir"), (F.col("kind") == "lockfile").alias("lock")).groupBy("dir").agg(F.max("lock").alias("lock"))
    around = claims.select("file").distinct().select("file", F.explode(parents(F.col("file"))).alias("dir"))
    return around.join(held, "dir", "left").groupBy("file").agg(F.coalesce(F.max_by("lock", F.when(F.col("lock").isNotNull(), F.length("dir"))), F.lit(False)).alias("locked"))


def _state(dists: DataFrame) -> DataFrame:
    """One row: broken, sources, locks: whether a manifest cannot be read, what is listed, and how much of it by lockfiles."""
    bad = F.col("kind") == "error"
    return dists.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("broken"), F.count_if(~bad).alias("sources"), F.count_if(F.col("kind") == "lockfile").alias("locks"))


def _graded(rungs, last: tuple[str, str]) -> tuple[Column, Column]:
    """Level and reason of the first rung that holds."""
    level, reason = F.when(rungs[0][0], rungs[0][1]), F.when(rungs[0][0], rungs[0][2])
    for test, grade, why in rungs[1:]:
        level, reason = level.when(test, grade), reason.when(test, why)
    return level.otherwise(last[0]).alias("level"), reason.otherwise(last[1]).alias("reason")


def check_script_imports(claims: DataFrame, dists: DataFrame, local: DataFrame, aliases: DataFrame, tree: DataFrame, modules: DataFrame) -> DataFrame:
    """Claims (file, subject, optional) of Node imports with level and reason, first rung that holds.

    dists: file, dist, kind (manifest or lockfile); local: name, of workspace packages; aliases: pattern or base as
    `sources.aliases.script_aliases` gives them; tree: path, of all files; modules: name, of packages that are only
    installed.  Every lookup is an equi join: alias patterns and prefixes meet the prefixes of a specifier.
    """
    spark = claims.sparkSession
    c = claims.where("subject is not null").select("file", "subject", F.coalesce("optional", F.lit(False)).alias("optional")).groupBy("file", "subject").agg(F.max("optional").alias("optional"))
    top = F.when(F.col("subject").startswith("@"), F.coalesce(F.nullif(F.regexp_extract("subject", r"^(@[^/]+/[^/]+)", 1), F.lit("")), F.col("subject"))).otherwise(F.substring_index("subject", "/", 1))
    c = c.withColumns({"top": top, "head": F.substring_index("subject", "/", 1)})
    state = _state(dists)
    dists = dists.where("kind <> 'error'")
    names = dists.select(F.col("dist").alias("top")).distinct()
    s = c.select("subject", "head").distinct()
    starts = s.select("subject", F.explode(F.transform(F.sequence(F.lit(0), F.length("subject")), lambda i: F.left(F.col("subject"), i))).alias("key"))
    p = aliases.where("pattern is not null").select("pattern").distinct()
    stem = F.regexp_replace("pattern", r"\*$", "")
    by_start = starts.join(p.where("pattern like '%*'").select(stem.alias("key")).distinct(), "key", "left_semi").select("subject")
    whole = p.where("pattern not like '%*' or pattern like '%/*'").select(F.regexp_replace("pattern", r"/\*$", "").alias("subject"))
    framework = spark.createDataFrame(list(FRAMEWORK_PREFIXES), "top string, key string").join(names, "top", "left_semi").select("key").distinct()
    bases = aliases.where("base is not null").select("base").distinct()
    files = tree.select("path").distinct()
    ends = "(" + "|".join(x.replace(".", r"\.") for x in SCRIPT_ENDINGS) + ")$"
    inside = files.select(F.explode(F.array_union(parents(F.col("path")), F.array(F.when(F.col("path").rlike(ends), F.regexp_replace("path", ends, ""))))).alias("at")).where("at <> ''").distinct()
    based = inside.select(folder(F.col("at")).alias("base"), F.element_at(F.split("at", "/"), -1).alias("head")).join(bases.select(F.when(F.col("base") == ".", "").otherwise(F.col("base")).alias("base")).distinct(), "base", "left_semi").select("head")
    dirs = files.where("path like '%/%'").select(F.substring_index("path", "/", 1).alias("head")).unionByName(files.where("path like 'src/%/%'").select(F.split("path", "/").getItem(1).alias("head")))
    scopes = names.where("top like '@%/%'").select(F.substring_index("top", "/", 1).alias("head"))
    rows = c.withColumn("builtin", F.when(F.col("top").isin(*NODE_BUILTINS), True))
    for table, key, name in (
        (names, "top", "provided"), (local.select(F.col("name").alias("top")), "top", "own"), (by_start.unionByName(whole), "subject", "alias"),
        (starts.join(framework, "key", "left_semi").select("subject"), "subject", "framework"), (based, "head", "based"), (dirs, "head", "in_tree"), (modules.select(F.col("name").alias("top")), "top", "installed"), (scopes, "head", "scope"),
    ):
        rows = rows.join(table.distinct().withColumn(name, F.lit(True)), key, "left")
    rows = rows.join(lock_reach(c, dists), "file", "left").crossJoin(F.broadcast(state))
    yes = lambda x: F.col(x).isNotNull()
    rungs = (
        (F.col("broken"), "unverifiable", "a manifest cannot be read"), (F.col("subject") == "<dynamic>", "review", "dynamic"), (yes("builtin") | F.col("subject").startswith("node:"), "accept", "built in"), (F.col("sources") == 0, "unverifiable", "no manifest"), (yes("provided"), "accept", "provided"),
        (yes("own"), "accept", "workspace package"), (yes("alias"), "accept", "path alias"), (yes("framework"), "accept", "framework alias"), (yes("based"), "accept", "base folder"),
        (yes("in_tree") & ~F.col("top").startswith("@"), "review", "folder of the tree"), (yes("installed"), "review", "installed only"), (F.col("optional"), "review", "optional"),
        (yes("scope") & F.col("top").contains("/"), "review", "same scope"), (~F.coalesce("locked", F.lit(False)), "review", "no lockfile"),
    )
    return rows.select("file", "subject", *_graded(rungs, ("reject", "absent")))


def check_python_imports(claims: DataFrame, dists: DataFrame, local: DataFrame, installed: DataFrame, nested: DataFrame) -> DataFrame:
    """Claims (subject, optional, and file where known) with level and reason, first rung that holds.

    dists: dist, kind (manifest or lockfile), and file, of which the nearest to a claim's file counts; local, nested: name; installed: name, dist, of an environment that is
    given as a table, since it differs by machine.  Without any manifest, or with one that cannot be read (kind `error`),
    absence cannot be told: unverifiable.
    A reject needs a lockfile; what only resembles a distribution, is optional or nested is reviewed.
    """
    spark = claims.sparkSession
    by_file = "file" in claims.columns and "file" in dists.columns
    kept = ["file", "subject"] if by_file else ["subject"]
    c = claims.select(*kept, "optional", top_level(F.col("subject")).alias("top")).distinct().withColumn("norm", module_norm(F.col("top")))
    d = dists.where("kind <> 'error'").select(module_norm(F.col("dist")).alias("norm"), "kind").distinct()

    def flag(df, key, name):
        return df.select(F.col(key)).distinct().withColumn(name, F.lit(True))

    aliases = spark.createDataFrame(list(ALIASES), "top string, norm string").join(d, "norm", "left_semi")
    here = installed.select(F.col("name").alias("top"), module_norm(F.col("dist")).alias("norm"))
    parts = d.select(F.explode(F.split("norm", "_")).alias("norm")).where(F.length("norm") >= 3)
    affixed = d.select(F.explode(F.array(*(F.regexp_extract("norm", p, 1) for p in (r"^python_(.+)$", r"^py(.+)$", r"^(.+)_python$", r"^(.+)_py$", r"^(.+)[23]$")))).alias("norm")).where(F.length("norm") >= 3)
    rows = c.withColumn("std", F.when(F.col("top").isin(*sorted(sys.stdlib_module_names)), True))
    for table, key, name in (
        (local.select(F.col("name").alias("top")), "top", "own"), (d, "norm", "provided"), (aliases, "top", "alias"),
        (here.join(d, "norm", "left_semi"), "top", "env_locked"), (here, "top", "env_only"), (parts.unionByName(affixed), "norm", "related"), (nested.select(F.col("name").alias("top")), "top", "inner"),
    ):
        rows = rows.join(flag(table, key, name), key, "left")
    rows = rows.crossJoin(F.broadcast(_state(dists)))
    if by_file:
        rows = rows.join(lock_reach(c, dists.where("kind <> 'error'")), "file", "left").withColumn("locks", F.coalesce(F.col("locked"), F.lit(False)).cast("long"))
    yes = lambda x: F.col(x).isNotNull()
    rungs = (
        (F.col("broken"), "unverifiable", "a manifest cannot be read"), (F.col("subject") == "<dynamic>", "review", "dynamic"), (yes("std"), "accept", "standard library"), (F.col("sources") == 0, "unverifiable", "no manifest"), (yes("own"), "accept", "own package"),
        (yes("provided"), "accept", "provided"), (yes("alias"), "accept", "provided under another name"), (yes("env_locked"), "accept", "installed and listed"), (yes("env_only"), "review", "installed only"),
        (yes("related"), "review", "related"), (F.col("optional"), "review", "optional"), (yes("inner"), "review", "nested"), (F.col("locks") == 0, "review", "no lockfile"),
    )
    return rows.select(*kept, *_graded(rungs, ("reject", "absent")))
