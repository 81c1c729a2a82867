"""Oracles as plug-ins: functions over DataFrames, registered or loaded by name, of which one that fails stops no other.

An oracle is a function (facts, lines, parsed, index) that returns findings (kind, subject, ref, file, line, level,
reason, dynamic), or None for none: facts are the `python_facts` on added lines, lines the added lines (file, lineno, text),
parsed the files whose Python parses, and index the `change.Index` of the tree.
"""

from __future__ import annotations

import importlib
import importlib.metadata
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import sized
from .change import environment_findings, import_findings, route_findings
from .relations import union_all

Oracle = Callable[..., DataFrame | None]
COLUMNS = ("kind", "subject", "ref", "file", "line", "level", "reason", "dynamic")
LEVELS = ("accept", "review", "reject", "unverifiable")
#: Entry points of installed packages that offer oracles.
GROUP = "groundwire.oracles"

BUILT_IN: dict[str, Oracle] = {"env_vars": environment_findings, "imports_lockfile": import_findings, "routes": route_findings}


def loaded(name: str) -> Oracle:
    """The oracle that a name stands for: a built-in one, `module:function`, or an installed package's entry point."""
    if name in BUILT_IN:
        return BUILT_IN[name]
    module, _, member = name.partition(":")
    if member:
        found = getattr(importlib.import_module(module), member)
    else:
        points = [x for x in importlib.metadata.entry_points(group=GROUP) if x.name == name]
        if not points:
            raise ValueError(f"no oracle of the name {name!r}")
        found = points[0].load()
    if not callable(found):
        raise TypeError(f"{name!r} is no function")
    return found


def oracles(names: Iterable[str] | None = None) -> dict[str, Oracle]:
    """Oracles by name: all built-in ones, or those that are named.  One that cannot be loaded fails when it is asked."""
    out: dict[str, Oracle] = {}
    for name in names if names is not None else BUILT_IN:
        try:
            out[name] = loaded(name)
        except Exception as error:  # noqa: BLE001 - a plug-in may fail in any way
            out[name] = _failing(error)
    return out


def _failing(error: Exception) -> Oracle:
    def ask(*_):
        raise error

    return ask


def _answer(oracle: Oracle, facts, lines, parsed, index) -> DataFrame | None:
    found = oracle(facts, lines, parsed, index)
    if found is None:
        return None
    return found.select(*(F.col(x).cast({"line": "long", "dynamic": "boolean"}.get(x, "string")).alias(x) for x in COLUMNS))


def guarded(asked: dict[str, Oracle], facts: DataFrame, lines: DataFrame, parsed: DataFrame, index) -> DataFrame:
    """Findings of all oracles, with the column oracle.

    A plug-in's answer is written before it is used, so that a failure in its tasks, too, becomes one unverifiable
    finding that names it.  A level that is none of the four is unverifiable as well.
    """
    spark = facts.sparkSession
    parts = []
    for name, oracle in asked.items():
        try:
            found = _answer(oracle, facts, lines, parsed, index)
            if found is not None and oracle is not BUILT_IN.get(name):
                found = sized(found, "findings")
        except Exception as error:  # noqa: BLE001 - nothing that an oracle does may stop the others
            said = error.getCondition() if isinstance(error, PySparkException) else str(error)
            found = spark.createDataFrame([("oracle", name, name, "", 0, "unverifiable", f"failed: {type(error).__name__}: {said}"[:300], False)], "kind string, subject string, ref string, file string, line long, level string, reason string, dynamic boolean")
        if found is not None:
            parts.append(found.withColumns({"level": F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("unverifiable"), "oracle": F.lit(name)}))
    if not parts:
        return spark.createDataFrame([], "kind string, subject string, ref string, file string, line long, level string, reason string, dynamic boolean, oracle string")
    return union_all(parts)
