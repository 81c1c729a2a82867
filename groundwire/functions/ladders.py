"""Verdict algebra: levels, capping, policies and evidence ladders as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import counted

# Levels by rank; an unverifiable finding never raises a verdict.
LEVELS = ("accept", "review", "reject")


def rank(level: Column) -> Column:
    return F.when(level == "reject", 2).when(level == "review", 1).when(level == "accept", 0)


def worst(level: Column) -> Column:
    """Aggregate: the gravest level; unverifiable ones are ignored, none at all accepts."""
    return F.coalesce(F.max_by(level, rank(level)), F.lit("accept"))


def capped(level: Column, hard: Column) -> Column:
    """A soft reference is reviewed at most."""
    return F.when(~hard & (level == "reject"), "review").otherwise(level)


def blocks(verdict: Column, block_on: Column) -> Column:
    return F.when(block_on == "never", False).when(block_on == "review", verdict.isin("review", "reject")).otherwise(verdict == "reject")


def env_level(built: Column, dynamic: Column, declared: Column, ambient: Column, default: Column, any_declared: Column) -> Column:
    """Ladder of an environment name, first rung that holds."""
    return F.when(~built, "unverifiable").when(dynamic, "review").when(declared | ambient | default, "accept").when(~any_declared, "review").otherwise("reject")


# What test runners print.
FAILED, PASSED = r"\b(\d+) (?:failed|errors?)\b", r"\b(\d+) passed\b"


def tests_honesty(has_report: Column, tests: Column, failures: Column, errors: Column, exit_code: Column, output: Column, observed: Column | None = None) -> Column:
    """Evidence for "tests pass": the exit code of an observed run, then a parsed report, an exit code, quoted output.

    A report that is named and cannot be read proves nothing, whatever stands beside it.
    """
    failed, passed = counted(output, FAILED), counted(output, PASSED)
    report = F.when((failures > 0) | (errors > 0), "contradicted").when(tests > 0, "proven").otherwise("not_observed")
    quoted = F.when(failed > 0, "contradicted").when(passed > 0, "plausible").otherwise("not_observed")
    told = F.when(has_report, report).when(exit_code == 0, "plausible").when(exit_code.isNotNull(), "contradicted").otherwise(F.coalesce(quoted, F.lit("not_observed")))
    return told if observed is None else F.when(observed == 0, "proven").when(observed.isNotNull(), "contradicted").otherwise(told)


def endpoint_honesty(wanted: Column, probed: Column, reported: Column) -> Column:
    """A probe proves or contradicts; a self-report is plausible at best."""
    return F.when(probed.isNotNull(), F.when(probed == wanted, "proven").otherwise("contradicted")).when(reported.isNotNull(), F.when(reported == wanted, "plausible").otherwise("contradicted")).otherwise("not_observed")


def bug_honesty(signature: Column, before: Column, after: Column) -> Column:
    return F.when(after.contains(signature), "contradicted").when(before.contains(signature) & after.isNotNull(), "plausible").otherwise("not_observed")


def honesty_level(honesty: Column) -> Column:
    return F.when(honesty == "proven", "accept").when(honesty == "contradicted", "reject").otherwise("review")


def checkpoint_state(failed: Column, changed: Column, uncertain: Column, observed: Column) -> Column:
    return F.when(failed, "blocked").when(changed, "changed_during_check").when(uncertain, "needs_review").when(~observed, "needs_test_evidence").otherwise("ready")


def anchor_summary(state: Column) -> Column:
    """Aggregate: invalid before stale (anything not valid) before valid; no anchor is valid."""
    return F.when(F.bool_or(state == "invalid"), "invalid").when(F.bool_or(state != "valid"), "stale").otherwise("valid")
