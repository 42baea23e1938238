"""From per-symbol states to final results: local results, escalation, exhaustion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodwire.params import Params
from moodwire.schemas import RESULT_COLUMNS

# Tier names and the text of an unavailable result.
LOCAL_TIER = "tier_1_local_onnx"
ANSWER_TIER = "tier_3_llm"
NEWS_STEP = "tier_2_news"
EXHAUSTED_STEP = "intelligence_exhaustion"
UNAVAILABLE_REASON = "No usable news-backed analysis; LLM fallback disabled"


def result_columns(keys: list[str]) -> list[str]:
    return [*keys, *RESULT_COLUMNS]


def local_results(scored: DataFrame) -> DataFrame:
    """Results of symbols whose news text was scored."""
    return scored.select(
        "request_id",
        "idx",
        F.col("ticker").alias("symbol"),
        "sentiment_score",
        "label",
        "confidence",
        F.lit(LOCAL_TIER).alias("source_tier"),
        F.lit("batch_news").alias("news_provider"),
        F.col("article_count").cast("int").alias("article_count"),
        F.lit(None).cast("string").alias("reasoning"),
    )


def route_of(scored: Column, all_attempted: Column, budget_exhausted: Column, params: Params):
    """What happens to a symbol after the news step."""
    may_escalate = (all_attempted | budget_exhausted) & F.lit(params.answers_configured)
    return (
        F.when(scored, F.lit("local"))
        .when(F.lit(params.news_only), F.lit("unavailable"))
        .when(may_escalate, F.lit("answer"))
        .otherwise(F.lit("exhausted"))
    )


def route(symbol_states: DataFrame, params: Params) -> DataFrame:
    """Adds ``route``; needs scored, all_attempted, budget_exhausted."""
    return symbol_states.withColumn(
        "route",
        route_of(F.col("scored"), F.col("all_attempted"), F.col("budget_exhausted"), params),
    )


def unavailable_results(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route") == "unavailable").select(
        "request_id",
        "idx",
        F.col("ticker").alias("symbol"),
        F.lit(0.0).alias("sentiment_score"),
        F.lit("unavailable").alias("label"),
        F.lit(0.0).alias("confidence"),
        F.lit("unavailable").alias("source_tier"),
        F.lit(None).cast("string").alias("news_provider"),
        F.lit(0).alias("article_count"),
        F.lit(UNAVAILABLE_REASON).alias("reasoning"),
    )


def fill_unavailable(symbols: DataFrame, results: DataFrame) -> DataFrame:
    """Results for all symbols; those without one are unavailable (news-only mode)."""
    missing = symbols.join(results.select("request_id", "idx"), ["request_id", "idx"], "left_anti")
    filler = unavailable_results(missing.withColumn("route", F.lit("unavailable")))
    return merge_results(results, filler)


def merge_results(*parts: DataFrame) -> DataFrame:
    """Reused, local, answered and unavailable results of the same requests."""
    columns = result_columns(["request_id", "idx"])
    merged = parts[0].select(*columns)
    for part in parts[1:]:
        merged = merged.unionByName(part.select(*columns))
    return merged


def exhausted_requests(routed: DataFrame, failed: DataFrame) -> DataFrame:
    """(request_id, cause): a symbol could not be escalated, or an answer chunk failed."""
    blocked = routed.filter(F.col("route") == "exhausted").select(
        "request_id", F.lit(NEWS_STEP).alias("cause")
    )
    unanswered = failed.select("request_id", F.lit(ANSWER_TIER).alias("cause"))
    return blocked.unionByName(unanswered).groupBy("request_id").agg(F.min("cause").alias("cause"))


def request_rollup(routed: DataFrame) -> DataFrame:
    """Per request: symbols with and without news, and whether it ends in exhaustion."""
    return routed.groupBy("request_id").agg(
        F.count("*").alias("symbols"),
        F.count_if("scored").alias("resolved"),
        F.count_if(~F.col("scored")).alias("missing"),
        F.coalesce(F.bool_or(F.col("route") == "exhausted"), F.lit(False)).alias("exhausted"),
    )


def apply_exhaustion(results: DataFrame, routed: DataFrame, failed: DataFrame) -> DataFrame:
    """Results that are sent: none of an exhausted request."""
    return results.join(exhausted_requests(routed, failed), "request_id", "left_anti")


def storable_results(
    local: DataFrame, answered: DataFrame, routed: DataFrame, failed: DataFrame
) -> DataFrame:
    """Results kept for reuse, also those of exhausted requests up to where work stopped.

    A request that could not escalate scored nothing behind its first unscored symbol; one whose
    answer chunk failed has all local results and the answers of the chunks before.
    """
    stop = (
        routed.filter(F.col("route") == "exhausted")
        .groupBy("request_id")
        .agg(F.min("idx").alias("stop_idx"))
    )
    stop_chunk = failed.groupBy("request_id").agg(F.min("chunk").alias("stop_chunk"))
    kept_local = local.join(stop, "request_id", "left").filter(
        F.col("stop_idx").isNull() | (F.col("idx") < F.col("stop_idx"))
    )
    kept_answers = answered.join(stop_chunk, "request_id", "left").filter(
        F.col("stop_chunk").isNull() | (F.col("chunk") < F.col("stop_chunk"))
    )
    return merge_results(kept_local, kept_answers)


def omitted(symbols: DataFrame, results: DataFrame) -> DataFrame:
    """Per request: asked symbols that no result names (an answer left them out)."""
    return (
        symbols.join(results.select("request_id", "idx"), ["request_id", "idx"], "left_anti")
        .groupBy("request_id")
        .agg(F.count("*").alias("omitted_symbols"))
    )


def transitions(routed: DataFrame, failed: DataFrame) -> DataFrame:
    """Fallback steps: one per escalated symbol, one per exhausted request."""
    escalated = routed.filter(F.col("route") == "answer").select(
        "request_id", F.lit(NEWS_STEP).alias("from_tier"), F.lit(ANSWER_TIER).alias("to_tier")
    )
    ended = exhausted_requests(routed, failed).select(
        "request_id", F.col("cause").alias("from_tier"), F.lit(EXHAUSTED_STEP).alias("to_tier")
    )
    return escalated.unionByName(ended)
