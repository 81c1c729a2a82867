"""Claims from source lines by pattern: environment reads of many languages, imports of scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_Q, _N = "[\"']", "([A-Za-z_][A-Za-z0-9_]*)"
# Reads of an environment variable, first match in this order wins for a line and name.
# Group 1 is the name; group 2, where there is one, is the read's own fallback.
ENV_READS = (
    rf"\bos\.environ\[\s*{_Q}{_N}{_Q}\s*\]()",
    rf"\bos\.environ\.get\(\s*{_Q}{_N}{_Q}\s*(?:,\s*([^)]*))?\)",
    rf"\bos\.getenv\(\s*{_Q}{_N}{_Q}\s*(?:,\s*([^)]*))?\)",
    rf"(?<![\w.])environ\[\s*{_Q}{_N}{_Q}\s*\]()",
    rf"(?<![\w.])environ\.get\(\s*{_Q}{_N}{_Q}\s*(?:,\s*([^)]*))?\)",
    rf"(?<![\w.])getenv\(\s*{_Q}{_N}{_Q}\s*(?:,\s*([^)]*))?\)",
    rf"\bprocess\.env\.{_N}\s*(\|\||\?\?)?",
    rf"\bprocess\.env\[\s*{_Q}{_N}{_Q}\s*\]\s*(\|\||\?\?)?",
    rf"\bDeno\.env\.get\(\s*{_Q}{_N}{_Q}\s*\)\s*(\|\||\?\?)?",
    rf"\bBun\.env\.{_N}\s*(\|\||\?\?)?",
    rf"\bimport\.meta\.env\.{_N}\s*(\|\||\?\?)?",
    rf"\bENV\[\s*{_Q}{_N}{_Q}\s*\]\s*(\|\|)?",
    rf"\bENV\.fetch\(\s*{_Q}{_N}{_Q}\s*(,[^)]+)?\)",
    rf'\bos\.(?:Getenv|LookupEnv)\(\s*"{_N}"\s*\)()',
    rf'\benv::var(?:_os)?\(\s*"{_N}"\s*\)()',
    rf'\b(?:option_)?env!\(\s*"{_N}"\s*\)()',
    rf'\bSystem\.getenv\(\s*"{_N}"\s*\)()',
    rf'\bEnvironment\.GetEnvironmentVariable\(\s*"{_N}"\s*\)()',
    rf"\$_ENV\[\s*{_Q}{_N}{_Q}\s*\]()",
)
# A read whose key is no literal; a comment line.
DYNAMIC_READ = r"""(?:\bos\.environ\[|\bos\.environ\.get\(|\bos\.getenv\(|(?<![\w.])environ\[|(?<![\w.])getenv\(|\bprocess\.env\[|\bENV\[|\bENV\.fetch\(|\bos\.Getenv\(|\bos\.LookupEnv\(|\benv::var\(|\bSystem\.getenv\(|\bDeno\.env\.get\()\s*(?!["'])\S"""
COMMENT = r"^\s*(#|//|\*|/\*|--)"
# Imports of scripts.
SCRIPT_IMPORTS = (r"""\bfrom\s+['"]([^'"]+)['"]""", r"""^\s*import\s+['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)""")


def _numbered(i: int, pattern: str) -> Column:
    """All matches of a pattern as (pattern, name, fallback)."""
    names, fallbacks = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(names.alias("name"), fallbacks.alias("fallback")), lambda m: F.struct(F.lit(i).alias("pattern"), m["name"].alias("name"), m["fallback"].alias("fallback")))


def _tagged(kind: str, subjects: Column) -> Column:
    return F.transform(F.array_distinct(subjects), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("subject")))


def env_reads(lines: DataFrame) -> DataFrame:
    """(file, lineno, name, has_default, dynamic): literal reads, and one `<dynamic>` for lines with none but a computed key."""
    code = lines.where(~F.col("text").rlike(COMMENT))
    matched = F.array(*(_numbered(i, p) for i, p in enumerate(ENV_READS)))
    found = code.select("file", "lineno", F.explode(F.flatten(matched)).alias("m")).select("file", "lineno", "m.*")
    first = Window.partitionBy("file", "lineno", "name").orderBy("pattern")
    literal = found.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("file", "lineno", "name", (~F.trim(F.coalesce("fallback", F.lit(""))).isin("", "None")).alias("has_default"), F.lit(False).alias("dynamic"))
    computed = code.where(F.col("text").rlike(DYNAMIC_READ)).select("file", "lineno").join(literal.select("file", "lineno").distinct(), ["file", "lineno"], "left_anti")
    return literal.unionByName(computed.select("file", "lineno", F.lit("<dynamic>").alias("name"), F.lit(False).alias("has_default"), F.lit(True).alias("dynamic")))


def package(specifier: Column) -> Column:
    """`@scope/name` or the part before the first slash."""
    return F.when(specifier.startswith("@"), F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index(specifier, "/", 1))


def script_imports(lines: DataFrame) -> DataFrame:
    """(file, lineno, subject, package): imports of JavaScript and TypeScript lines, local paths and URLs left out."""
    found = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in SCRIPT_IMPORTS)))
    rows = lines.where(F.col("file").rlike(r"\.[cm]?[jt]sx?$") & ~F.col("text").rlike(COMMENT)).select("file", "lineno", F.explode(F.array_distinct(found)).alias("subject"))
    kept = rows.where(~F.col("subject").rlike(r"^(\.|/|#|~)") & (~F.col("subject").rlike(r"^[a-z]+:") | F.col("subject").startswith("node:")))
    return kept.withColumn("package", package(F.col("subject")))


def prose_claims(notes: DataFrame, key: str, column: str) -> DataFrame:
    """(key, kind, subject): references that prose makes, each once; always soft."""
    from ..functions.text import BACKTICK_MODULE, ENV_NAME, FILE, IMPORT, ROUTE

    def every(pattern):
        return F.regexp_extract_all(column, F.lit(pattern), F.lit(1))

    route = F.transform(F.arrays_zip(every(ROUTE).alias("m"), F.regexp_extract_all(column, F.lit(ROUTE), F.lit(2)).alias("p")), lambda x: F.concat_ws(" ", x["m"], x["p"]))
    kinds = {"env": F.filter(every(ENV_NAME), lambda x: F.length(x) >= 4), "route": route, "file": F.transform(every(FILE), lambda x: F.regexp_replace(x, r"[.,;:)]+$", "")), "import": F.array_union(every(IMPORT), every(BACKTICK_MODULE))}
    tagged = F.flatten(F.array(*(_tagged(k, v) for k, v in kinds.items())))
    return notes.select(key, F.explode(tagged).alias("c")).select(key, "c.kind", "c.subject")
