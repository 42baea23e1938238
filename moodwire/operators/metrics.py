"""Operational metrics over request, call, lookup and transition logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodwire.functions.calls import backoff_ms, is_success, rank_index, retryable, status_class
from moodwire.params import DURATION_SAMPLES, MAX_ATTEMPTS

SALTS = 64

# Quantiles that are published.
QUANTILES = [("0.50", 0.50), ("0.95", 0.95), ("0.99", 0.99)]


def last_samples(
    log: DataFrame, n: int = DURATION_SAMPLES, by: list[str] | None = None
) -> DataFrame:
    """The newest ``n`` rows of the log, or of each group of it.

    Without groups this is a top-n per partition and a merge. A group is cut into salted parts
    first, each of which keeps its newest ``n``, so that a group holding much of the log is sorted
    by many tasks and the last step sees at most ``SALTS`` × ``n`` of its rows.
    """
    newest = [F.col("ts").desc(), F.col("request_id").desc()]
    if not by:
        return log.orderBy(*newest).limit(n)
    salted = log.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(SALTS)))
    for keys in ([*by, "_salt"], by):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
        salted = salted.withColumn("_rn", place).filter(F.col("_rn") <= n)
    return salted.drop("_salt", "_rn")


def duration_quantiles(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank quantiles of the newest samples, 0 when there are none.

    A group holds at most ``DURATION_SAMPLES`` values, so it can be sorted as one array.
    """
    samples = last_samples(log, by=by)
    sorted_ms = F.sort_array(F.collect_list("duration_ms"))
    listed = samples.groupBy(*(by or [])).agg(sorted_ms.alias("_ms"))
    n = F.size("_ms")
    picks = [
        F.coalesce(F.get(F.col("_ms"), rank_index(n, q)), F.lit(0))
        .cast("double")
        .alias(f"p{name[2:]}")
        for name, q in QUANTILES
    ]
    return listed.select(*(by or []), n.alias("samples"), *picks)


def whole_quantiles(log: DataFrame, by: list[str]) -> DataFrame:
    """Nearest-rank quantiles of all durations of each group, 0 when it has none.

    Durations are counted first, so a busy group is one row per value that differs; its running count is read in the
    order of a sort that spills, and no list of a group is built.
    """
    counted = log.groupBy(*by, "duration_ms").agg(F.count("duration_ms").alias("_n"))
    group = Window.partitionBy(*by)
    up_to = group.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"_up_to": F.sum("_n").over(up_to), "_samples": F.sum("_n").over(group)})
    picks = [
        F.coalesce(F.min(F.when(F.col("_up_to") > rank_index(F.col("_samples"), q), F.col("duration_ms"))), F.lit(0))
        .cast("double")
        .alias(f"p{name[2:]}")
        for name, q in QUANTILES
    ]
    return placed.groupBy(*by).agg(F.max("_samples").cast("int").alias("samples"), *picks)


def request_totals(log: DataFrame) -> DataFrame:
    """Sum and count of durations and the exhaustion rate, over all requests, rejected included."""
    return log.agg(
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_sum_ms"),
        F.count("*").alias("requests"),
        F.count_if("exhausted").alias("exhausted_requests"),
        F.coalesce(F.avg(F.col("exhausted").cast("int")), F.lit(0.0)).alias("exhaustion_rate"),
    )


def lookup_totals(lookups: DataFrame) -> DataFrame:
    """Hits by layer and the hit ratio, 0 without lookups; ``layer`` is memory, shared or miss."""
    hits = F.count_if(F.col("layer") != "miss")
    return lookups.agg(
        F.count_if(F.col("layer") == "memory").alias("memory_hits"),
        F.count_if(F.col("layer") == "shared").alias("shared_hits"),
        F.count_if(F.col("layer") == "miss").alias("misses"),
        F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)).alias("hit_ratio"),
    )


def provider_error_rates(call_log: DataFrame) -> DataFrame:
    """Errors of each class per attempt of the provider; retries count as attempts.

    A payload notice arrives as a row of its own with ``error_kind`` payload: an error, not a call.
    """
    notice = F.coalesce(F.col("error_kind") == "payload", F.lit(False))
    calls = call_log.groupBy("provider").agg(F.count_if(~notice).alias("calls"))
    errors = (
        call_log.filter(notice | ~is_success(F.col("status")))
        .groupBy(
            "provider",
            F.when(notice, F.lit("2xx_payload_error"))
            .otherwise(status_class(F.col("status")))
            .alias("status_class"),
        )
        .agg(F.count("*").alias("errors"))
    )
    return errors.join(calls, "provider").select(
        "provider",
        "status_class",
        "errors",
        "calls",
        F.coalesce(F.try_divide("errors", "calls"), F.lit(0.0)).alias("error_rate"),
    )


def transition_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("from_tier", "to_tier").agg(F.count("*").alias("n"))


def call_outcomes(call_log: DataFrame) -> DataFrame:
    """Per call: attempts made, last attempt's status, whether a retry saved it."""
    last = F.max_by(F.struct("status", "error_kind"), "attempt")
    per_call = call_log.groupBy("call_id", "provider").agg(
        F.count("*").alias("attempts"), last.alias("last")
    )
    succeeded = is_success(F.col("last.status"))
    return per_call.select(
        "call_id",
        "provider",
        "attempts",
        F.col("last.status").alias("final_status"),
        F.col("last.error_kind").alias("final_error"),
        succeeded.alias("succeeded"),
        (succeeded & (F.col("attempts") > 1)).alias("saved_by_retry"),
        (
            ~succeeded
            & (F.col("attempts") >= MAX_ATTEMPTS)
            & retryable(F.col("last.status"), F.col("last.error_kind"))
        ).alias("gave_up"),
    )


def backoff_audit(call_log: DataFrame) -> DataFrame:
    """Observed wait before each retry against the schedule; a call has at most three attempts.

    ``jitter_seed`` of the failed attempt gives the expected jitter.
    """
    order = Window.partitionBy("call_id").orderBy("attempt")
    gaps = call_log.select(
        "call_id",
        "provider",
        "attempt",
        F.lag("attempt").over(order).alias("_before"),
        (F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(order))).alias("observed_ms"),
        F.lag("jitter_seed").over(order).alias("_seed"),
    ).filter(F.col("_before").isNotNull())
    expected = backoff_ms(F.col("_before"), F.col("_seed"))
    return gaps.select(
        "call_id",
        "provider",
        "attempt",
        "observed_ms",
        expected.alias("expected_ms"),
        (F.col("observed_ms") >= expected).alias("kept_schedule"),
    )


# Exposition text of each metric family, in output order.
FAMILIES = [
    ("request_duration_ms", "summary", "Request duration summary in milliseconds."),
    ("cache_hit_ratio", "gauge", "Cache hit ratio across in-memory and Redis lookups."),
    ("cache_hit_memory_total", "counter", "Total in-memory (Moka) cache hits."),
    ("cache_hit_redis_total", "counter", "Total Redis cache hits."),
    ("provider_error_rate", "gauge", "Provider error ratio by provider and status class."),
    ("fallback_transition_count", "counter", "Count of fallback transitions between tiers."),
    (
        "tier_exhaustion_rate",
        "gauge",
        "Ratio of analyze requests ending in intelligence exhaustion.",
    ),
]


def _family(name: str) -> int:
    return [f[0] for f in FAMILIES].index(name)


def _sample(family: str, place: int, series: Column, value: Column) -> Column:
    return F.struct(
        F.lit(_family(family)).alias("family"),
        F.lit(place).alias("place"),
        series.alias("series"),
        value.alias("value"),
    )


def _rows(df: DataFrame, samples: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*samples)).alias("s")).select("s.*")


def metrics(
    request_log: DataFrame, call_log: DataFrame, transitions: DataFrame, lookups: DataFrame
) -> DataFrame:
    """(family, place, series, value): all published samples, values already formatted."""
    three, six, whole = "%.3f", "%.6f", "%d"

    def fmt(pattern: str, column: str) -> Column:
        return F.format_string(pattern, F.col(column))

    durations = _rows(
        duration_quantiles(request_log),
        [
            _sample(
                "request_duration_ms",
                i + 1,
                F.lit(f'request_duration_ms{{quantile="{name}"}}'),
                fmt(three, f"p{name[2:]}"),
            )
            for i, (name, _) in enumerate(QUANTILES)
        ],
    )
    totals = _rows(
        request_totals(request_log),
        [
            _sample(
                "request_duration_ms",
                5,
                F.lit("request_duration_ms_sum"),
                fmt(whole, "duration_sum_ms"),
            ),
            _sample(
                "request_duration_ms", 6, F.lit("request_duration_ms_count"), fmt(whole, "requests")
            ),
            _sample(
                "tier_exhaustion_rate", 1, F.lit("tier_exhaustion_rate"), fmt(six, "exhaustion_rate")
            ),
        ],
    )
    cache = _rows(
        lookup_totals(lookups),
        [
            _sample("cache_hit_ratio", 1, F.lit("cache_hit_ratio"), fmt(six, "hit_ratio")),
            _sample(
                "cache_hit_memory_total", 1, F.lit("cache_hit_memory_total"), fmt(whole, "memory_hits")
            ),
            _sample(
                "cache_hit_redis_total", 1, F.lit("cache_hit_redis_total"), fmt(whole, "shared_hits")
            ),
        ],
    )
    errors = _rows(
        provider_error_rates(call_log),
        [
            _sample(
                "provider_error_rate",
                1,
                F.format_string(
                    'provider_error_rate{provider="%s",status_class="%s"}',
                    F.col("provider"),
                    F.col("status_class"),
                ),
                fmt(six, "error_rate"),
            )
        ],
    )
    steps = _rows(
        transition_counts(transitions),
        [
            _sample(
                "fallback_transition_count",
                1,
                F.format_string(
                    'fallback_transition_count{from="%s",to="%s"}',
                    F.col("from_tier"),
                    F.col("to_tier"),
                ),
                fmt(whole, "n"),
            )
        ],
    )
    return reduce(DataFrame.unionByName, [durations, totals, cache, errors, steps])


def metrics_lines(samples: DataFrame) -> DataFrame:
    """Exposition lines as rows (family, place, line), in order when sorted by all three."""
    heads = samples.sparkSession.createDataFrame(
        [
            (i, at, text)
            for i, (name, kind, about) in enumerate(FAMILIES)
            for at, text in ((-1, f"# HELP {name} {about}"), (0, f"# TYPE {name} {kind}"))
        ],
        "family int, place int, line string",
    )
    lines = samples.select("family", "place", F.concat_ws(" ", "series", "value").alias("line"))
    return heads.unionByName(lines)
