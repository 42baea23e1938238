"""Functions on call outcomes: status classes, retries, quantile ranks."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retry policy in milliseconds.
BACKOFF_BASE_MS = 120
BACKOFF_MAX_MS = 900
BACKOFF_JITTER_MS = 75
BACKOFF_MAX_EXPONENT = 4

# Error kinds of a failed call that are worth another attempt.
TRANSIENT_KINDS = ["timeout", "connect", "request"]


# Reason phrases that differ from the standard library's.
OTHER_PHRASES = {413: "Payload Too Large", 418: "I'm a teapot", 422: "Unprocessable Entity"}


def status_text(status: Column) -> Column:
    """A status with its reason phrase, as error lists print it."""
    phrases = {s.value: s.phrase for s in HTTPStatus} | OTHER_PHRASES
    known = F.create_map(*[F.lit(x) for pair in sorted(phrases.items()) for x in pair])
    phrase = F.coalesce(F.try_element_at(known, status.cast("int")), F.lit("<unknown status code>"))
    return F.concat(status.cast("string"), F.lit(" "), phrase)


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def status_class(status: Column, error_kind: Column | None = None) -> Column:
    """``4xx`` and so on; a call without any status is ``network``."""
    by_status = F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))
    by_status = F.when(status.isNull(), F.lit("network")).otherwise(by_status)
    if error_kind is None:
        return by_status
    return F.when(error_kind == "payload", F.lit("2xx_payload_error")).otherwise(by_status)


def retryable(status: Column, error_kind: Column) -> Column:
    """Server errors and transient network errors; 429 is never retried."""
    return F.coalesce(status.between(500, 599), F.lit(False)) | F.coalesce(
        status.isNull() & error_kind.isin(TRANSIENT_KINDS), F.lit(False)
    )


def backoff_ms(attempt: Column, seed: Column) -> Column:
    """Wait after a failed attempt: doubling base plus jitter from ``seed``, capped."""
    exponent = F.least(attempt, F.lit(BACKOFF_MAX_EXPONENT)).cast("int")
    doubled = F.lit(BACKOFF_BASE_MS) * F.pow(F.lit(2), exponent).cast("bigint")
    jitter = F.pmod(seed, F.lit(BACKOFF_JITTER_MS))
    return F.least(doubled + jitter, F.lit(BACKOFF_MAX_MS)).cast("bigint")


def rank_index(n: Column, q: float) -> Column:
    """0-based nearest-rank position of quantile ``q`` among ``n`` sorted samples."""
    return F.round((n - 1) * F.lit(q)).cast("int")
