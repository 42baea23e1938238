"""Articles inside a request's lookback, and the newest-first limit of a feed call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodwire.session import cut_lineage

HOUR_US = 3_600_000_000
# Where a feed has no lower bound: before every time-stamp (µs).
ALWAYS = -(2**62)
# Rows asked of feed 3 per missing symbol and its hard limit.
FEED3_OVERFETCH = 3
FEED3_LIMIT = 1000


def lower_bound(ts: Column, lookback_hours: Column, feed: int) -> Column:
    """Oldest publication time a feed is asked for; feeds 1 and 2 ask for none."""
    since = ts - F.make_dt_interval(hours=lookback_hours)
    if feed == 3:
        return F.date_trunc("minute", since)
    if feed == 4:
        return F.date_trunc("day", since)
    return F.lit(None).cast("timestamp")


def feed_limit(feed: int, max_articles: Column, n_missing: Column) -> Column:
    """Rows a batched call asks for; ``n_missing`` counts the symbols still without news."""
    if feed == 3:
        wanted = F.greatest(max_articles, F.lit(1)) * n_missing * FEED3_OVERFETCH
        return F.least(wanted, F.lit(FEED3_LIMIT))
    return max_articles * n_missing


def _ranked(articles: DataFrame, points: DataFrame) -> DataFrame:
    """Articles with their rank in their ticker, points with the number of articles up to them.

    Ranks are counted inside (ticker, hour) and shifted by the running total of the hours before,
    so a ticker with very many articles is spread over its hours. ``points`` has ticker, at (µs)
    and inclusive.
    """
    hour = F.expr(f"_at div {HOUR_US}L")
    events = articles.select(
        "*", F.unix_micros("published").alias("_at"), F.lit(1).alias("_is"), F.lit(1).alias("_side")
    )
    probes = points.withColumnRenamed("at", "_at").withColumns(
        {"_is": F.lit(0), "_side": F.when(F.col("inclusive"), F.lit(2)).otherwise(F.lit(0))}
    )
    both = events.unionByName(probes, allowMissingColumns=True).withColumn("_hour", hour)
    per_hour = (
        both.groupBy("ticker", "_hour")
        .agg(F.sum("_is").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy("ticker")
                    .orderBy("_hour")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    inside = (
        Window.partitionBy("ticker", "_hour")
        .orderBy("_at", "_side", "article_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("_in_hour", F.sum("_is").over(inside))
        .join(per_hour, ["ticker", "_hour"])
        .withColumn("rank", F.col("_before") + F.col("_in_hour"))
        .drop("_hour", "_in_hour", "_before", "_at", "_side", "inclusive")
    )


def _request_points(requests: DataFrame, feed: int) -> DataFrame:
    """Two probes per request: articles published before the lower bound, and up to the request."""
    low = lower_bound(F.col("ts"), F.col("lookback_hours"), feed)
    return requests.select(
        "ticker",
        "request_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit("low").alias("which"),
                    F.coalesce(F.unix_micros(low), F.lit(ALWAYS)).alias("at"),
                    F.lit(False).alias("inclusive"),
                ),
                F.struct(
                    F.lit("high").alias("which"),
                    F.unix_micros("ts").alias("at"),
                    F.lit(True).alias("inclusive"),
                ),
            )
        ).alias("p"),
    ).select("ticker", "request_id", "p.*")


def _rank_bounds(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("_is") == 0).groupBy("ticker", "request_id").agg(
        F.max(F.when(F.col("which") == "low", F.col("rank"))).alias("low_rank"),
        F.max(F.when(F.col("which") == "high", F.col("rank"))).alias("high_rank"),
    )


def in_lookback(articles: DataFrame, requests: DataFrame, feed: int) -> DataFrame:
    """Per (request, ticker): number of articles inside the lookback, without listing pairs.

    ``articles`` has article_id, ticker, published; ``requests`` has request_id, ticker, ts,
    lookback_hours.
    """
    ranked = _ranked(
        articles.select("article_id", "ticker", "published"), _request_points(requests, feed)
    )
    return _rank_bounds(ranked).select(
        "request_id", "ticker", (F.col("high_rank") - F.col("low_rank")).alias("n_articles")
    )


def batch_limit(articles: DataFrame, requests: DataFrame, feed: int) -> DataFrame:
    """The newest articles inside each request's lookback, at most its ``row_limit``.

    The ranks a request may take are known before the join, so only rows of the result are ever
    produced, however many articles and requests share a ticker. Runs a job: the ranking is cut,
    because bounds and articles both come from it.
    """
    ranked = cut_lineage(_ranked(articles, _request_points(requests, feed)))
    placed = ranked.filter(F.col("_is") == 1).select(*articles.columns, "rank")
    limits = requests.select("request_id", "ticker", "row_limit")
    wanted = (
        _rank_bounds(ranked)
        .join(limits, ["request_id", "ticker"])
        .withColumn(
            "_from",
            F.greatest(F.col("low_rank") + 1, F.col("high_rank") - F.col("row_limit") + 1),
        )
        .filter(F.col("_from") <= F.col("high_rank"))
        .select(
            "request_id",
            "ticker",
            "high_rank",
            F.explode(F.sequence("_from", "high_rank")).alias("rank"),
        )
    )
    return (
        wanted.join(placed, ["ticker", "rank"])
        .withColumn("pos", F.col("high_rank") - F.col("rank"))
        .drop("rank", "high_rank")
    )
