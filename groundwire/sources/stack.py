"""What a source tree is written in, from the files at its root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Files at a root that tell a language.
LANGUAGE_FILES = {
    "python": ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "poetry.lock", "uv.lock", "Pipfile.lock"),
    "node": ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock"),
    "go": ("go.mod",),
    "rust": ("Cargo.toml",),
    "ruby": ("Gemfile",),
}
# A framework's tag, its language, its name in a file, and the files that may name it.
FRAMEWORKS = (
    ("fastapi", "python", "fastapi", ("pyproject.toml", "requirements.txt", "poetry.lock", "uv.lock", "Pipfile", "Pipfile.lock", "setup.py", "setup.cfg")),
    ("express", "node", "express", ("package.json",)),
    ("nextjs", "node", "next", ("package.json",)),
    ("django", "python", "django", ("pyproject.toml", "requirements.txt", "poetry.lock", "uv.lock")),
    ("flask", "python", "flask", ("pyproject.toml", "requirements.txt", "poetry.lock", "uv.lock")),
)


def detect_stack(tree: DataFrame, by: Sequence[str] = (), pinned: Sequence[str] = ()) -> DataFrame:
    """(*by, tag), distinct: languages and frameworks of a tree (path, text), or of each tree that `by` tells apart.

    Only files at the root count; a framework is named by a whole word, in any case.  Pinned tags stand alone.
    """
    if pinned:
        one = tree.select(*by).distinct() if by else tree.sparkSession.range(1)
        return one.select(*by, F.explode(F.array(*(F.lit(x) for x in sorted(set(pinned))))).alias("tag"))
    tags = [F.when(F.col("path").isin(*files), F.array(F.lit(tag))) for tag, files in LANGUAGE_FILES.items()]
    for tag, language, word, files in FRAMEWORKS:
        named = F.col("path").isin(*files) & F.coalesce(F.col("text").rlike(rf"(?i)(?<![\w-]){word}(?![\w-])"), F.lit(False))
        tags.append(F.when(named, F.array(F.lit(language), F.lit(tag))))
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.flatten(F.array(*(F.coalesce(x, none) for x in tags))))
    return tree.where(~F.col("path").contains("/")).select(*by, F.explode(found).alias("tag")).distinct()
