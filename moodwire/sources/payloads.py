"""Landed feed payloads: one row per feed call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodwire import schemas
from moodwire.functions.calls import is_success


def successful(payloads: DataFrame) -> DataFrame:
    """Only 2xx bodies are ever decoded. On Parquet the predicate is pushed into the scan."""
    return payloads.filter(F.col("http_status").between(200, 299))


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return successful(spark.read.format(fmt).schema(schemas.PAYLOADS).load(path))


def stream_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return successful(spark.readStream.format(fmt).schema(schemas.PAYLOADS).load(path))


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.REQUESTS).load(path)


def read_answers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Answer calls of every status: failures are needed for the failure list."""
    return spark.read.format(fmt).schema(schemas.ANSWERS).load(path)


def status_counts(payloads: DataFrame) -> DataFrame:
    """Calls and usable bodies by feed."""
    return payloads.groupBy("feed").agg(
        F.count("*").alias("calls"), F.count_if(is_success(F.col("http_status"))).alias("usable")
    )
