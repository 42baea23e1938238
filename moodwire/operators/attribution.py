"""Match feed mentions to the symbols a request asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodwire.functions.text import ascii_upper


def attribute_exact(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Inner join on the case-sensitive ticker; a ticker asked for twice matches once."""
    wanted = symbols.groupBy("request_id", "ticker").agg(
        F.max("max_articles").alias("max_articles")
    )
    return mentions.join(wanted, ["request_id", "ticker"])


def attribute_folded(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Inner join on the ASCII-folded ticker; the result has the request's own casing.

    When a request holds several casings of one ticker, the last one asked for gets the titles.
    """
    wanted = symbols.groupBy("request_id", ascii_upper(F.col("ticker")).alias("folded")).agg(
        F.max_by("ticker", "idx").alias("wanted"), F.max("max_articles").alias("max_articles")
    )
    folded = mentions.withColumn("folded", ascii_upper(F.col("ticker"))).drop("ticker")
    return (
        folded.join(wanted, ["request_id", "folded"])
        .withColumnRenamed("wanted", "ticker")
        .drop("folded")
    )


def unresolved(symbols: DataFrame, articles: DataFrame) -> DataFrame:
    """Symbols without any article."""
    return symbols.join(articles, ["request_id", "ticker"], "left_anti")


def cap_per_ticker(articles: DataFrame, n: Column) -> DataFrame:
    """First ``n`` articles of each (request, ticker) in feed order."""
    order = Window.partitionBy("request_id", "ticker").orderBy("feed_rank", "pos")
    return articles.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop(
        "_rn"
    )


def merge_articles(*feeds: DataFrame) -> DataFrame:
    """Bag union of the feeds' articles; duplicates stay."""
    columns = ["request_id", "ticker", "feed_rank", "pos", "title"]
    merged = feeds[0].select(*columns)
    for feed in feeds[1:]:
        merged = merged.unionByName(feed.select(*columns))
    return merged


def article_text(articles: DataFrame) -> DataFrame:
    """Titles per (request, ticker) in feed order, their number and their joined text.

    A group's titles come from the at most four payload rows of one request, so a group is never
    larger than a few landed bodies.
    """
    listed = articles.groupBy("request_id", "ticker").agg(
        F.sort_array(F.collect_list(F.struct("feed_rank", "pos", "title"))).alias("found")
    )
    titles = F.col("found.title")
    return listed.select(
        "request_id",
        "ticker",
        titles.alias("titles"),
        F.size("found").alias("article_count"),
        F.array_join(titles, " ").alias("text"),
    )
