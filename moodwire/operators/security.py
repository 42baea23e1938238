"""Outgoing-URL policy, redaction of log text and the audit of what redaction left."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodwire.functions.binding import let
from moodwire.params import DEFAULT_HOSTS

# What a masked value becomes and which names mark a secret value.
MARKER = "[REDACTED]"
SECRET_NAMES = ["token", "api_token", "api_key", "apikey", "key", "authorization", "x-api-key"]
VALUE_END = "& '\"\\n"
BEARER_END = " '\"\\n"
COMPILED_SECRETS = 100

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# After the scheme any number of slashes or backslashes; names before the last @ are not the host.
AUTHORITY = (
    r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/\\?#\s]*@)?(\[[0-9A-Fa-f:.]+\]|[^/\\?#:@\s\[\]]+)"
    r"(?::([0-9]*))?(?:[/\\?#]\S*)?$"
)
HIERARCHICAL = ["http", "https", "ws", "wss", "ftp"]


def egress_code(url: Column, extra_hosts: Iterable[str] = ()) -> Column:
    """First rule an outgoing URL breaks, or null when it may be called."""
    hosts = sorted({*DEFAULT_HOSTS, *(h.lower() for h in extra_hosts)})
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, SCHEME, 1))
    host = F.lower(F.regexp_extract(url, AUTHORITY, 1))
    port = F.regexp_extract(url, AUTHORITY, 2)
    port_number = F.when(port != "", port.try_cast("int")).otherwise(F.lit(443))
    malformed = (scheme == "") | (
        scheme.isin(HIERARCHICAL)
        & ((host == "") | port_number.isNull() | (port_number > 65535))
    )
    return (
        F.when(url.isNull() | malformed, F.lit("EGRESS_INVALID_URL"))
        .when(scheme != "https", F.lit("EGRESS_SCHEME_DENIED"))
        .when(~host.isin(hosts), F.lit("EGRESS_HOST_DENIED"))
        .when(port_number != 443, F.lit("EGRESS_PORT_DENIED"))
    )


def check_egress(urls: DataFrame, extra_hosts: Iterable[str] = ()) -> DataFrame:
    return urls.withColumn("code", egress_code(F.col("url"), extra_hosts))


def secrets_column(secrets: Iterable[str]) -> Column:
    """Known secrets of the job, in order."""
    return F.array(*[F.lit(s) for s in secrets]).cast("array<string>")


def _told_apart(names: list[str]) -> list[str]:
    """Names that no other one ends: what stands before a value ends with a name exactly if it ends with one of these."""
    return [n for n in names if not any(n != other and n.endswith(other) for other in names)]


def redact(text: Column, secrets: Column | Iterable[str]) -> Column:
    """Mask known secrets, then values of secret-named parameters, then bearer tokens.

    Secrets given as texts are masked one behind the other in compiled code, a column of them in a lambda.
    """
    if isinstance(secrets, Column):
        known = F.aggregate(
            secrets,
            text,
            lambda acc, s: F.when(s == "", acc).otherwise(F.replace(acc, s, F.lit(MARKER))),
        )
    else:
        known = text
        for s in secrets:
            known = known if s == "" else F.replace(known, F.lit(s).cast("string"), F.lit(MARKER))
    names = "|".join(_told_apart(SECRET_NAMES))
    named = F.regexp_replace(known, f"({names})=[^{VALUE_END}]*", f"$1={MARKER}")
    return F.regexp_replace(named, f"Bearer [^{BEARER_END}]*", f"Bearer {MARKER}")


def _given(secrets: Iterable[str]) -> Column | list[str]:
    """A short list as it is; a long one as a column, since each text in it is an expression of its own."""
    listed = list(secrets)
    return listed if len(listed) <= COMPILED_SECRETS else secrets_column(listed)


def redact_lines(lines: DataFrame, secrets: Iterable[str], column: str = "line") -> DataFrame:
    return lines.withColumn(column, redact(F.col(column), _given(secrets)))


def leak_audit(lines: DataFrame, secrets: Iterable[str], by: str = "source") -> DataFrame:
    """Lines and lines still holding a known secret, by source; the second must be 0."""
    given, line = _given(secrets), F.col("line")
    if isinstance(given, Column):  # bound, or a line that is still to be made is made for every secret
        held = let(line, lambda x: F.exists(given, lambda s: (s != "") & F.contains(x, s)))
    else:
        held = reduce(or_, [F.contains(line, F.lit(s)) for s in given if s], F.lit(False))
    return lines.groupBy(by).agg(
        F.count("*").alias("lines"), F.count_if(held).alias("leaking_lines")
    )
