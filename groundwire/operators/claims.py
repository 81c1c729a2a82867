"""Claims from JSON texts, checked and normalised; what is malformed keeps its place with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of kinds, and fields that may stand beside a claim's attributes.
KINDS = {
    "env": "env_var", "env_var": "env_var", "environment": "env_var", "route": "route_handler", "route_handler": "route_handler", "endpoint": "route_handler", "import": "import",
    "package": "import", "dependency": "import", "router_include": "router_include", "tests_pass": "tests_pass", "tests": "tests_pass", "endpoint_status": "endpoint_status", "bug_fixed": "bug_fixed",
}
OUTCOMES = ("tests_pass", "endpoint_status", "bug_fixed")
ATTRIBUTES = ("handler", "method", "path", "command", "url", "status", "signature", "evidence", "report", "cwd", "timeout")


def _at(name: str) -> Column:
    return F.try_variant_get("item", f"$.{name}", "string")


def _type(name: str) -> Column:
    """Type of a field as JSON has it; null for null and for an absent field."""
    return F.nullif(F.schema_of_variant(F.try_variant_get("item", f"$.{name}", "variant")), F.lit("VOID"))


def claims_from_json(rows: DataFrame, column: str) -> DataFrame:
    """(the other columns, nth, kind, subject, file, line, col, hard, source, attrs, error) of a JSON column.

    A text is a list of claims or an object with a list `claims`; anything else, and a null text, gives one row with
    an error and a null nth.  attrs maps attribute names to their JSON or string; error is null for a good claim.
    """
    others = [x for x in rows.columns if x != column]
    doc = F.try_parse_json(column)
    listed = F.coalesce(F.try_variant_get(doc, "$.claims", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(listed, F.when(is_object & F.try_variant_get(doc, "$.claims", "variant").isNull(), F.array().cast("array<variant>")))
    split = rows.withColumn("list", listed)
    good = split.where("list is not null").select(*others, F.posexplode("list").alias("nth", "item"))
    attrs = F.coalesce(F.try_variant_get("item", "$.attrs", "map<string,string>"), F.create_map().cast("map<string,string>"))
    beside = F.create_map(*(y for x in ATTRIBUTES for y in (F.lit(x), _at(x))))
    beside = F.map_filter(beside, lambda k, v: v.isNotNull() & ~F.map_contains_key(F.col("given"), k))
    named = F.trim(F.coalesce(_at("kind"), F.lit("")))
    kinds = F.create_map(*(F.lit(y) for x in KINDS.items() for y in x))
    c = good.withColumn("given", attrs).withColumn("attrs", F.map_concat("given", beside)).withColumn("kind", F.coalesce(kinds[named], named))
    known = lambda *keys: F.coalesce(*(F.nullif(F.col("attrs")[k], F.lit("")) for k in keys))
    subject = F.nullif(_at("subject"), F.lit(""))
    route = F.when(known("path").isNotNull(), F.concat(F.upper(F.coalesce(known("method"), F.lit("GET"))), F.lit(" "), known("path")))
    subject = F.when(subject.isNotNull(), subject).when(F.col("kind") == "route_handler", route).when(F.col("kind").isin(*OUTCOMES), F.coalesce(known("command", "url", "signature"), F.col("kind")))
    bad_place = F.lit(False)
    for name in ("line", "col"):
        number = F.try_variant_get("item", f"$.{name}", "bigint")
        bad_place |= _type(name).isNotNull() & ((_type(name) != "BIGINT") | (F.coalesce(number, F.lit(-1)) < 0))
    source, hard = F.coalesce(_at("source"), F.lit("assertion")), _type("hard")
    error = (
        F.when(~F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)), "must be an object").when(F.col("kind") == "", "missing kind")
        .when(_type("attrs").isNotNull() & ~_type("attrs").startswith("OBJECT"), "attrs must be an object").when(hard.isNotNull() & (hard != "BOOLEAN"), "hard must be a boolean")
        .when(~source.isin("code", "assertion", "prose"), "unknown source").when(bad_place, "line and col must be nonnegative integers")
        .when(F.col("subject").isNull() & (F.col("kind") == "route_handler"), "a route needs a subject or a path").when(F.col("subject").isNull(), "missing subject")
    )
    whole = c.withColumn("subject", subject).select(
        *others, F.col("nth").cast("long").alias("nth"), "kind", "subject", F.coalesce(_at("file"), F.lit("")).alias("file"), *(F.coalesce(F.try_variant_get("item", f"$.{x}", "bigint"), F.lit(0).cast("bigint")).alias(x) for x in ("line", "col")),
        (F.coalesce(F.try_variant_get("item", "$.hard", "boolean"), F.lit(True)) & (source != "prose")).alias("hard"), source.alias("source"), "attrs", error.alias("error"),
    )
    broken = split.where("list is null").select(*others, F.lit("claims must be a list or an object with a list").alias("error"))
    return whole.unionByName(broken, allowMissingColumns=True)
