"""What a grader may run or ask: commands of test runners and hosts of this machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that may be asked without further leave.
HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")


def url_host(url: Column) -> Column:
    """The host of an HTTP address in lower case, without user, port and brackets; null for what is none."""
    found = F.regexp_extract(url, r"^(?i:https?)://(?:[^@/?#]*@)?(\[[^\]/]+\]|[^:/?#\[\]]+)(?::\d*)?(?:[/?#]|$)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"^\[|\]$", ""), F.lit(""))


def allowed_host(url: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether an address may be asked: its host is this machine's, or one of `more`."""
    return F.coalesce(url_host(url).isin(*HOSTS, *(x.lower().strip("[]") for x in more)), F.lit(False))


def allowed_command(command: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a command is an allowed one, or that with further words; blanks count once."""
    plain = F.array_join(F.filter(F.split(command, r"\s+"), lambda x: x != ""), " ")
    return F.coalesce(F.lit(False) if not allowed else F.greatest(*[plain.eqNullSafe(F.lit(x)) | plain.startswith(x + " ") for x in allowed], F.lit(False)), F.lit(False))
