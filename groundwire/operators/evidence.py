"""Evidence and its ledger: test reports, blocked changes, summaries."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import per_row

COUNTS = ("tests", "failures", "errors", "skipped")


def report_counts(path: str, text: str | None):
    """(path, tests, failures, errors) of a JUnit report; nothing from a text that is none.

    Suites give numbers, elements are counted too, and the greater one holds: an explicit failure always wins.  Tests
    and skipped ones are taken from the innermost suites; skipped tests are no tests.
    """
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return
    suites = [root] if root.tag == "testsuite" else list(root.iter("testsuite"))
    if not suites and root.tag != "testsuites":
        return
    try:
        given = {id(s): {k: int(s.get(k) or 0) if s.get(k) is not None else 0 for k in COUNTS} for s in suites}
    except ValueError:
        return
    if any(n < 0 for x in given.values() for n in x.values()):
        return
    leaves = [s for s in suites if s.find(".//testsuite") is None]

    def most(name: str, over, element: str) -> int:
        return max(sum(given[id(s)][name] for s in over), sum(1 for _ in root.iter(element)))

    tests, skipped = most("tests", leaves, "testcase"), most("skipped", leaves, "skipped")
    yield path, max(0, tests - skipped), most("failures", suites, "failure"), most("errors", suites, "error")


def test_reports(reports: DataFrame) -> DataFrame:
    """(path, tests, failures, errors) of JUnit texts (path, text); what is no report is left out."""
    return per_row(reports, report_counts, ["path", "text"], "path string, tests long, failures long, errors long")


EVENT = "ts long, repo string, surface string, mode string, rejects long, oracles array<string>, files array<string>, event string, operation string, bytes long, omitted long"


def read_ledger(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (value); lines that are no object are left out."""
    parsed = lines.where(F.try_parse_json("value").isNotNull() & F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    return parsed.select(F.from_json("value", EVENT).alias("e")).select("e.*")


def blocked_event(findings: DataFrame, repo: str, surface: str, mode: str, ts: int) -> DataFrame:
    """One event as JSON (value) if the findings hold a reject, no row without; at most 20 files are named."""
    bad = findings.where("level = 'reject'")
    row = bad.agg(F.count("*").alias("rejects"), F.array_sort(F.collect_set("oracle")).alias("oracles"), F.slice(F.array_sort(F.collect_set("file")), 1, 20).alias("files")).where("rejects > 0")
    return row.select(F.to_json(F.struct("files", F.lit(mode).alias("mode"), "oracles", "rejects", F.lit(repo).alias("repo"), F.lit(surface).alias("surface"), F.lit(ts).alias("ts"))).alias("value"))


def ledger_summary(events: DataFrame) -> DataFrame:
    """One row: blocks, broken references, context calls with their bytes, and counts by repo, surface and oracle."""
    block = F.col("event").isNull() | (F.col("event") != "context")

    def by(df, key):
        counted = df.groupBy(key).agg(F.count("*").cast("long").alias("n"))
        return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(f"by_{key}"))

    b = events.where(block)
    total = events.agg(
        F.count_if(block).alias("blocks"), F.coalesce(F.sum(F.when(block, F.col("rejects"))), F.lit(0)).alias("broken"), F.count_if(~block).alias("context_requests"),
        F.coalesce(F.sum(F.when(~block, F.col("bytes"))), F.lit(0)).alias("context_bytes"), F.coalesce(F.sum(F.when(~block, F.col("omitted"))), F.lit(0)).alias("context_omitted"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    oracles = b.select(F.explode("oracles").alias("oracle"))
    return total.crossJoin(by(b, "repo")).crossJoin(by(b, "surface")).crossJoin(by(oracles, "oracle"))  # one row each


def last_events(events: DataFrame, order: str, n: int) -> DataFrame:
    """The last `n` events in the order of a column."""
    return events.orderBy(F.desc(order)).limit(n)
