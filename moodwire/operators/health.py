"""Readiness rollup from landed probes and the list of configured providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodwire.functions.calls import is_success
from moodwire.params import ANSWER_PROVIDERS, FEED_NAMES

# Reasons of a degraded tier.
FALLBACK_ONLY = "primary_news_provider_unavailable_using_fallback_capacity"
NO_NEWS = "no_news_provider_available"
NO_ANSWERS = "no_llm_provider_configured"


def latest_probes(probes: DataFrame, by: list[str]) -> DataFrame:
    """Newest probe of each provider; 2xx and 429 both show a reachable provider."""
    newest = probes.groupBy(*by, "provider").agg(F.max_by("status", "ts").alias("status"))
    reachable = is_success(F.col("status")) | F.coalesce(F.col("status") == 429, F.lit(False))
    return newest.withColumn("reachable", reachable)


def readiness(probes: DataFrame, configured: DataFrame, by: list[str]) -> DataFrame:
    """One row per deployment (``by``): status of each tier, with reasons, and of the whole.

    ``probes`` has provider, ts, status; ``configured`` has provider. The local tier is always up.
    """
    primary, fallbacks = FEED_NAMES[1], [FEED_NAMES[k] for k in (2, 3, 4)]
    primary_up = latest_probes(probes.filter(F.col("provider") == primary), by).select(
        *by, "reachable", F.lit(False).alias("fallback"), F.lit(False).alias("answers")
    )
    present = configured.select(
        *by,
        F.lit(False).alias("reachable"),
        F.col("provider").isin(fallbacks).alias("fallback"),
        F.col("provider").isin(ANSWER_PROVIDERS).alias("answers"),
    )
    seen = probes.select(
        *by, *[F.lit(False).alias(c) for c in ("reachable", "fallback", "answers")]
    )
    facts = (
        primary_up.unionByName(present)
        .unionByName(seen)
        .groupBy(*by)
        .agg(
            F.bool_or("reachable").alias("primary_up"),
            F.bool_or("fallback").alias("fallback"),
            F.bool_or("answers").alias("answers"),
        )
    )

    def status(up):
        return F.when(up, F.lit("operational")).otherwise(F.lit("degraded"))

    news_up = F.col("primary_up") | F.col("fallback")
    return facts.select(
        *by,
        status(news_up & F.col("answers")).alias("status"),
        F.lit("operational").alias("tier_1_status"),
        status(news_up).alias("tier_2_status"),
        F.when(F.col("primary_up"), F.lit(None).cast("string"))
        .when(F.col("fallback"), F.lit(FALLBACK_ONLY))
        .otherwise(F.lit(NO_NEWS))
        .alias("tier_2_reason"),
        status(F.col("answers")).alias("tier_3_status"),
        F.when(~F.col("answers"), F.lit(NO_ANSWERS)).alias("tier_3_reason"),
    )


NEWS, ANSWERS, BREAKER = "tier_2_news", "tier_3_llm", "not_configured"


def _known(probes: DataFrame, configured: DataFrame, by: list[str]) -> DataFrame:
    """Per deployment: whether its primary feed answers, and which of the known providers it has; at most seven."""
    primary = latest_probes(probes.filter(F.col("provider") == FEED_NAMES[1]), by)
    known = [*FEED_NAMES.values(), *ANSWER_PROVIDERS]
    none = F.lit(None).cast("string").alias("provider")
    facts = (
        primary.select(*by, "reachable", none)
        .unionByName(configured.select(*by, F.lit(False).alias("reachable"), "provider"))
        .unionByName(probes.select(*by, F.lit(False).alias("reachable"), none))
    )
    listed = F.when(F.col("provider").isin(known), F.col("provider"))
    return facts.groupBy(*by).agg(
        F.coalesce(F.bool_or("reachable"), F.lit(False)).alias("primary_up"), F.collect_set(listed).alias("listed")
    )


def _status_of(provider: str) -> Column:
    """The primary feed is probed; of the others only their configuration is known."""
    if provider == FEED_NAMES[1]:
        return F.when(F.col("primary_up"), F.lit("operational")).otherwise(F.lit("degraded"))
    return F.when(F.array_contains("listed", provider), F.lit("configured")).otherwise(F.lit("not_configured"))


def provider_status(probes: DataFrame, configured: DataFrame, by: list[str]) -> DataFrame:
    """One row per deployment and known provider: its tier, status and breaker state."""
    rows = [
        F.struct(F.lit(tier).alias("tier"), F.lit(p).alias("provider"), _status_of(p).alias("status"))
        for tier, names in ((NEWS, FEED_NAMES.values()), (ANSWERS, ANSWER_PROVIDERS))
        for p in names
    ]
    each = _known(probes, configured, by).select(*by, F.explode(F.array(*rows)).alias("p"))
    return each.select(*by, "p.*", F.lit(BREAKER).alias("breaker_state"))


def readiness_body(
    probes: DataFrame, configured: DataFrame, by: list[str], answer_order: tuple = tuple(ANSWER_PROVIDERS)
) -> DataFrame:
    """One row per deployment with the readiness answer as JSON: tiers, their providers, and the answer order."""

    def block(names) -> Column:
        return F.struct(
            *[F.struct(_status_of(p).alias("status"), F.lit(BREAKER).alias("breaker_state")).alias(p) for p in names]
        )

    def tier(k: int, *more: Column) -> Column:
        reason = F.col(f"tier_{k}_reason") if k > 1 else F.lit(None).cast("string")
        return F.struct(
            F.col(f"tier_{k}_status").alias("status"),
            reason.alias("degradation_reason"),
            F.lit(BREAKER).alias("breaker_state"),
            *more,
        )

    whole = readiness(probes, configured, by).join(_known(probes, configured, by), by)
    order = F.array(*[F.lit(p) for p in answer_order]).alias("execution_order")
    tiers = F.struct(
        tier(1).alias("tier_1_local_onnx"),
        tier(2, block(FEED_NAMES.values()).alias("providers")).alias(NEWS),
        tier(3, block(ANSWER_PROVIDERS).alias("providers"), order).alias(ANSWERS),
    )
    body = F.to_json(F.struct(F.col("status"), tiers.alias("tiers")), {"ignoreNullFields": "false"})
    return whole.select(*by, body.alias("body"))
