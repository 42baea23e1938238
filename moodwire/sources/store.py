"""The store of results for reuse: Parquet by day of computation, newest per key, pruned where it is read.

Runs append what they computed. ``compact`` brings the store down to the newest living result of each key: days that
hold anything are written anew by dynamic partition overwrite, so a day is replaced as a whole or not at all, and days
outside the store's life keep only their mark, a row without a key, which readers skip. A reader asks for the
results from an instant on, and the days before are not listed into its scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodwire.operators.reuse import newest_per_key
from moodwire.session import cut_lineage


def _day(us: int):
    return F.to_date(F.timestamp_micros(F.lit(us)))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("cache_key", "computed_at", "result", F.to_date("computed_at").alias("day"))


def append(results: DataFrame, path: str) -> None:
    """Add a run's storable results (as of ``newest_per_key``). Runs a job."""
    append_newest(newest_per_key(results), path)


def append_newest(newest: DataFrame, path: str) -> None:
    """Add rows of (cache_key, computed_at, result), such as ``Analysis.storable``. Runs a job."""
    _placed(newest).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, result: str, since_us: int | None = None) -> DataFrame:
    """(cache_key, computed_at, result) of the store, computed after ``since_us``; ``result`` is a struct's DDL."""
    schema = f"cache_key string, computed_at timestamp, result {result}, day date"
    rows = spark.read.schema(schema).parquet(path).where("cache_key is not null")
    if since_us is not None:
        rows = rows.where((F.col("day") >= _day(since_us)) & (F.unix_micros("computed_at") > since_us))
    return rows.select("cache_key", "computed_at", "result")


def useful_since(asked: DataFrame, ttl_s: int) -> int | None:
    """Microseconds of the oldest instant whose results can serve any of ``asked`` (ts); null without rows. Runs a job."""
    first = asked.agg(F.min(F.unix_micros("ts"))).first()[0]
    return None if first is None else first - ttl_s * 1_000_000


def recent(prior: DataFrame, asked: DataFrame, ttl_s: int) -> DataFrame:
    """``prior`` without results too old for any of ``asked``; by day too where the table has days. Runs a job."""
    since = useful_since(asked, ttl_s)
    if since is None:
        return prior.limit(0)
    kept = prior.where(F.col("computed_at") > F.timestamp_micros(F.lit(since)))
    return kept.where(F.col("day") >= _day(since)) if "day" in prior.columns else kept


def compact(spark: SparkSession, path: str, result: str, now_us: int, ttl_s: int) -> None:
    """Leave the newest result of each key that is alive at ``now_us``. Runs jobs.

    What has been read is landed before any day is replaced, so a job that dies in between loses nothing; run
    again it comes to the same store. Results of one instant are told apart by their hash.
    """
    schema = f"cache_key string, computed_at timestamp, result {result}, day date"
    stored = spark.read.schema(schema).parquet(path)
    alive = stored.where("cache_key is not null").where(F.unix_micros("computed_at") > now_us - ttl_s * 1_000_000)
    newest = alive.groupBy("cache_key").agg(
        F.max("computed_at").alias("computed_at"),
        F.max_by("result", F.struct("computed_at", F.xxhash64("result"))).alias("result"),
    )
    kept = cut_lineage(_placed(newest))
    days = cut_lineage(stored.select("day").distinct())
    marks = days.select(*[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns[:3]], "day")
    kept.unionByName(marks).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(path)
