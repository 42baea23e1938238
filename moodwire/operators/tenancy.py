"""Who a request belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodwire.functions.text import is_blank, utrim
from moodwire.params import Params

ANONYMOUS = "anonymous"


def tenant_by_key(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``tenant`` by exact match on the trimmed key; null when unknown.

    ``keys`` is (api_key, tenant, ord); the first pair of a key wins. The join side is left to
    the optimizer, which broadcasts the key table only below its size threshold.
    """
    first = keys.groupBy("api_key").agg(F.min_by("tenant", "ord").alias("tenant"))
    trimmed = requests.withColumn("_key", F.nullif(utrim(F.col("api_key")), F.lit("")))
    return trimmed.join(first.withColumnRenamed("api_key", "_key"), "_key", "left").drop("_key")


def tenant_by_claims(claims: Column) -> Column:
    """``tid`` else ``sub``; a blank ``tid`` does not fall through to ``sub``."""
    named = F.coalesce(claims["tid"], claims["sub"])
    return F.when(~is_blank(named), named)


def resolve_tenant(requests: DataFrame, params: Params, keys: DataFrame | None) -> DataFrame:
    """Adds ``tenant`` and, where there is none, ``outcome_code``."""
    if params.auth_mode == "none":
        named = requests.withColumn("tenant", F.lit(ANONYMOUS))
    elif params.auth_mode == "api_key":
        named = tenant_by_key(requests, keys)
    elif params.auth_mode == "jwt":
        named = requests.withColumn("tenant", tenant_by_claims(F.col("claims")))
    else:
        return requests.withColumn("tenant", F.lit(None).cast("string")).withColumn(
            "outcome_code", F.lit("CONFIGURATION_ERROR")
        )
    return named.withColumn("outcome_code", F.when(F.col("tenant").isNull(), "UNAUTHORIZED"))
