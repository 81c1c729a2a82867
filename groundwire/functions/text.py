"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Redaction rules, in order (name, pattern, replacement).
SCRUB_RULES = (
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{12,}=*", "Bearer [REDACTED]"),
    ("secret_assignment", r"""(?i)\b([a-z0-9_]*(?:password|passwd|secret|token|api[_-]?key))["']?\s*[:=]\s*(?:"[^"]{4,}"|'[^']{4,}'|[^\s"'`,;]{4,})""", "$1=[REDACTED]"),
    ("url_password", r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+:)[^\s/@]+(@)", "$1[REDACTED]$2"),
)
# References in prose.
ENV_NAME = r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"
ROUTE = r"\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[\w./{}\-:]*)"
FILE = r"(?<![\w/])((?:[\w.\-]+/)+[\w.\-]+\.[A-Za-z0-9]{1,8})"
IMPORT = r"(?m)(?:^|[\s`(])(?:import|from)\s+([A-Za-z_][\w]*)(?:[.\s`)]|$)"
BACKTICK_MODULE = r"`([a-z][a-z0-9_]{2,})`"
# Words, and the parts of two letters or more of those in camel case.
WORD = r"(?U)([^\W\d_]\w*)"
CAMEL_PART = r"([A-Z][a-z]+|[a-z]{2,}|[A-Z]{2,}(?![a-z]))"


def scrub(text: Column) -> Column:
    """Text with secrets redacted by all rules in order; scrubbing twice changes nothing more."""
    for _, pattern, replacement in SCRUB_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def terms(text: Column) -> Column:
    """Distinct lower-case words, and parts of camel-case words of two letters or more, sorted.

    Every letter lies in a word, so parts are sought in the whole text and not word by word.
    """
    return _lowered(F.concat(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.regexp_extract_all(text, F.lit(CAMEL_PART), F.lit(1))))


def _lowered(words: Column) -> Column:
    # put together at line ends, which no word holds and each ends one: one call for all words, and none for each
    joined = F.array_join(F.array_distinct(words), "\n")
    return F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower(joined), "\n"), "")))


def words(text: Column) -> Column:
    """Distinct lower-case words of a text, sorted, without camel-case parts."""
    return _lowered(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)))


def name_tokens(name: Column) -> Column:
    """Distinct lower-case parts of a name: at separators and before a capital after a small letter."""
    cut = F.regexp_replace(name, r"([a-z0-9])(?=[A-Z])", "$1 ")
    return F.array_distinct(F.transform(F.filter(F.split(cut, r"[_\-./:\s]+"), lambda x: x != ""), lambda x: F.lower(x)))


def module_norm(name: Column) -> Column:
    """Distribution names alike: lower case, runs of - _ . as one underscore."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "_"))


def top_level(module: Column) -> Column:
    """`@scope/pkg` as it is, else what stands before the first dot or slash."""
    return F.when(module.startswith("@"), F.regexp_extract(module, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(module, r"^([^./]*)", 1))


def content_id(*parts: Column, prefix: str = "", size: int = 20) -> Column:
    """Hex digits of the SHA-256 of the parts, joined by zero bytes."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def counted(text: Column, pattern: str) -> Column:
    """Sum of the numbers that the pattern's first group matches."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def tail(text: Column, size: int = 300) -> Column:
    # a single space stays as it is, and most are
    return F.right(F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r]\s*| \s+", " ")), F.lit(size))


def escaped(text: Column) -> Column:
    """For workflow commands: percent and line ends."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def edited(text: Column, edits: Column) -> Column:
    """A text after edits in order, an array of (old, new, all): the first occurrence of old is replaced, or all of them.

    An empty or null old appends; an old that does not occur changes nothing.  Without a text the new parts are its lines.
    """
    def apply(now, e):
        old, new = F.coalesce(e["old"], F.lit("")), F.coalesce(e["new"], F.lit(""))
        at = F.position(old, now)
        first = F.concat(F.substring(now, F.lit(1), at - 1), new, F.substring(now, at + F.length(old), F.length(now)))
        return F.when(old == "", F.concat(now, new)).when(F.coalesce(e["all"], F.lit(False)), F.replace(now, old, new)).when(at > 0, first).otherwise(now)

    fresh = F.array_join(F.transform(edits, lambda e: F.coalesce(e["new"], F.lit(""))), "\n")
    return F.when(text.isNull(), fresh).otherwise(F.aggregate(edits, text, apply))


# Strings in three quotes, line comments, block comments, and what lies between; an open string or block ends the text.
_STRINGS = "|".join(rf"{q}[^{q}\\]*+(?:\\[\s\S]?[^{q}\\]*+)*+{q}?" for q in ("'", '"', "`"))
_SPANS = {
    "clike": rf"({_STRINGS}|//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?|[^'\"`/]++|/)",
    "hash": rf"({_STRINGS}|#[^\n]*+|[^'\"`#]++)",
}


def mask_comments(text: Column, style: str = "clike") -> Column:
    """Text with comments blanked: lines, columns and strings stay; null stays null."""
    spans = F.regexp_extract_all(text, F.lit(_SPANS[style]), F.lit(1))
    opening = "^(//|/\\*)" if style == "clike" else "^#"
    return F.when(text.isNotNull(), F.array_join(F.transform(spans, lambda x: F.when(x.rlike(opening), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), ""))
