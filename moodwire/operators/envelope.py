"""Error envelope of requests that got no result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code → (HTTP status, message, seconds to wait before a retry).
OUTCOMES = {
    "INVALID_REQUEST": (400, "Request validation failed.", None),
    "UNAUTHORIZED": (
        401,
        "Valid authentication credentials are required for this endpoint.",
        None,
    ),
    "GLOBAL_RATE_LIMITED": (429, "Global protection guard is active.", 1),
    "TENANT_RATE_LIMITED": (429, "Tenant '%s' exceeded request budget.", 1),
    "INTELLIGENCE_EXHAUSTION": (
        503,
        "All upstream providers are currently rate-limited or unreachable.",
        300,
    ),
    "CONFIGURATION_ERROR": (500, "Unsupported auth mode configured.", None),
}

# Detail of an exhausted request.
EXHAUSTION_DETAIL = {
    "tier_1": "exhausted",
    "tier_2": "exhausted",
    "tier_3_llm": "cooldown_active",
}


def _map_of(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def _by_code(code: Column, position: int, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, values in OUTCOMES.items():
        out = F.when(code == name, F.lit(values[position]).cast(kind)).otherwise(out)
    return out


def with_envelope(rejected: DataFrame) -> DataFrame:
    """Adds ``http_status`` and ``envelope``; needs request_id, outcome_code, tenant, details.

    ``to_json`` of a map prints the keys it has, so each code gets its own detail keys.
    """
    code = F.col("outcome_code")
    details = (
        F.when(
            code == "INVALID_REQUEST",
            F.transform(
                "details", lambda d: _map_of({k: d[k] for k in ("code", "field", "message")})
            ),
        )
        .when(
            code == "TENANT_RATE_LIMITED",
            F.array(_map_of({"field": F.lit("tenant_id"), "message": F.col("tenant")})),
        )
        .when(
            code == "INTELLIGENCE_EXHAUSTION",
            F.array(_map_of({k: F.lit(v) for k, v in EXHAUSTION_DETAIL.items()})),
        )
        .otherwise(F.array().cast("array<map<string,string>>"))
    )
    message = F.replace(
        _by_code(code, 1, "string"), F.lit("%s"), F.coalesce(F.col("tenant"), F.lit(""))
    )
    return rejected.withColumn("http_status", _by_code(code, 0, "int")).withColumn(
        "envelope",
        F.struct(
            code.alias("code"),
            message.alias("message"),
            _by_code(code, 2, "bigint").alias("retry_after_seconds"),
            F.col("request_id").alias("request_id"),
            details.alias("details"),
        ),
    )


def envelope_json(envelope: Column) -> Column:
    return F.to_json(envelope, {"ignoreNullFields": "false"})
