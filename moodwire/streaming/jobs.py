"""Streaming forms of admission, reuse, metrics, ingest and redaction.

Event time decides everything. Admission and reuse stand behind ``in_event_order``, so their answers do not depend
on how rows are dealt over micro-batches; windowed metrics are native aggregations. Rows later than the
watermark are dropped and counted. An end marker lets the last rows and windows go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moodwire.functions.calls import is_success, rank_index, status_class
from moodwire.operators.admission import Bucket
from moodwire.operators.metrics import QUANTILES
from moodwire.operators.resolve import local_results
from moodwire.operators.scoring import Scorer, keyword_scorer
from moodwire.operators.security import redact_lines
from moodwire.operators.tenancy import resolve_tenant
from moodwire.operators.validation import request_symbols, with_details
from moodwire.params import Params
from moodwire.plans.waterfall import waterfall
from moodwire.session import cut_lineage
from moodwire.sources.sinks import upsert_batch
from moodwire.streaming.ordered import SHARDS, STRETCH_MS, in_event_order, plain_values

MINUTE_MS = 60_000


def _in_time_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's released rows of this micro-batch; the trigger's input limit bounds them."""
    return pd.concat(list(rows)).sort_values(["t", "request_id"], ignore_index=True)


class _Keyed(StatefulProcessor):
    """One value per key that means nothing any more after some instant, when a timer drops it.

    Rows come a stretch late: when the watermark stands inside a stretch, its rows are still held. So the timer waits
    one stretch longer than the value counts.
    """

    schema = ""
    stretch_ms = STRETCH_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def keep(self, value: tuple, until_ms: int) -> None:
        self.state.update(value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until_ms + self.stretch_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Limit(_Keyed):
    """A token bucket per key over rows in event order; keys with ``limited`` false pass through."""

    schema = "full_at long"

    def __init__(self, per_minute: int, code: str, names: list[str], stretch_ms: int):
        self.bucket, self.code, self.names, self.stretch_ms = Bucket(per_minute), code, names, stretch_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not key[0]:
            for pdf in rows:
                yield pdf[self.names]
            return
        pdf = _in_time_order(rows)
        x = self.state.get()[0] if self.state.exists() else 0
        admitted = []
        for t in pdf["t"].tolist():
            got, x = self.bucket.take(x, t * self.bucket.scale, 1)
            admitted.append(got == 1)
        # Idle for a minute: a full bucket equals no state.
        self.keep((x,), int(pdf["t"].iloc[-1]) // 1000 + MINUTE_MS + 1)
        denied = pd.Series(admitted, index=pdf.index)
        yield pdf.assign(outcome_code=pdf["outcome_code"].where(denied, self.code))[self.names]


def _limited(ordered: DataFrame, key: Column, per_minute: int, code: str, stretch_ms: int) -> DataFrame:
    """Rows without an outcome go through the bucket of their key, the others past all buckets."""
    still_open = F.col("outcome_code").isNull()
    aside = F.concat(F.lit("aside-"), F.pmod(F.xxhash64("request_id"), F.lit(SHARDS)).cast("string"))
    keyed = ordered.withColumns(
        {"is_open": still_open, "by_key": F.when(still_open, key.cast("string")).otherwise(aside)}
    )
    return keyed.groupBy("is_open", "by_key").transformWithStateInPandas(
        _Limit(per_minute, code, ordered.columns, stretch_ms),
        ordered.schema,
        "Append",
        "EventTime",
        eventTimeColumnName="released",
    )


def stream_limit(
    stream: DataFrame, key: Column, per_minute: int, delay: str = "1 minute", stretch_ms: int = STRETCH_MS
) -> DataFrame:
    """(request_id, key, ts, admitted) of a stream with request_id and ts: one bucket per key."""
    asked = stream.select(
        "request_id", "ts", key.cast("string").alias("key"), F.lit(None).cast("string").alias("outcome_code")
    )
    ordered = in_event_order(asked, delay, stretch_ms=stretch_ms)
    decided = _limited(ordered, F.col("key"), per_minute, "DENIED", stretch_ms)
    return decided.select(
        "request_id", "key", F.timestamp_micros("t").alias("ts"), F.col("outcome_code").isNull().alias("admitted")
    )


def stream_admit(
    requests: DataFrame,
    params: Params,
    keys: DataFrame | None = None,
    delay: str = "1 minute",
    stretch_ms: int = STRETCH_MS,
) -> DataFrame:
    """(request_id, ts, tenant, outcome_code) of a stream of requests, the code null when admitted.

    Validation and tenant are row rules (``keys`` is a table of its own); the requests left open pass the
    global limit and then their tenant's, each a keyed operator, with the answers of ``admission.admit``.
    """
    named = resolve_tenant(with_details(requests), params, keys)
    invalid = F.size("details") > 0
    decided = named.select(
        "request_id",
        "ts",
        F.when(~invalid, F.col("tenant")).alias("tenant"),
        F.when(invalid, F.lit("INVALID_REQUEST")).otherwise(F.col("outcome_code")).alias("outcome_code"),
    )
    ordered = in_event_order(decided, delay, stretch_ms=stretch_ms)
    after_global = _limited(ordered, F.lit("all"), params.global_per_minute, "GLOBAL_RATE_LIMITED", stretch_ms)
    after_tenant = _limited(
        after_global, F.col("tenant"), params.tenant_per_minute, "TENANT_RATE_LIMITED", stretch_ms
    )
    return after_tenant.select("request_id", F.timestamp_micros("t").alias("ts"), "tenant", "outcome_code")


class _Sharded(_Keyed):
    """One value per reuse key until some instant, all keys of a shard together: a list of keys, of instants, and one of
    each field of the value. A call, its state and its timer are per shard and micro-batch, not per key.
    """

    def __init__(self, fields: list[T.StructField], stretch_ms: int):
        self.fields, self.stretch_ms = fields, stretch_ms
        named = [T.StructField("by_key", T.StringType()), T.StructField("live_until", T.LongType()), *fields]
        self.schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in named])

    def held(self) -> dict:
        if not self.state.exists():
            return {}
        keys, until, *values = self.state.get()
        return {k: (u, v) for k, u, v in zip(keys, until, zip(*values))}

    def hold(self, held: dict, timerValues) -> None:
        """Keep what still counts; the timer is for the last of it, since rows that come earlier drop the rest."""
        spare = timerValues.getCurrentWatermarkInMs() - self.stretch_ms
        alive = [(k, u, *v) for k, (u, v) in held.items() if u // 1000 + 1 > spare]
        if alive:
            self.keep(tuple(map(list, zip(*alive))), max(row[1] for row in alive) // 1000 + 1)
        else:
            self.state.clear()


class _Windows(_Sharded):
    """Which rows of a key compute and which reuse: a miss opens a window of one TTL."""

    def __init__(self, ttl_us: int, names: list[str], stretch_ms: int):
        super().__init__([T.StructField("computed_by", T.StringType())], stretch_ms)
        self.ttl_us, self.names = ttl_us, names

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_time_order(rows)
        held = self.held()
        hits, sources = [], []
        for k, t, request in zip(_keys(pdf), pdf["t"].tolist(), pdf["request_id"].tolist()):
            until, by = held.get(k, (-1, (None,)))
            hits.append(t < until)
            if t >= until:
                by = (request,)
                held[k] = (t + self.ttl_us, by)
            sources.append(by[0])
        self.hold(held, timerValues)
        yield pdf.assign(hit=hits, computed_by=sources)[[*self.names, "hit", "computed_by"]]


class _Results(_Sharded):
    """The result of the last computing row of a key, handed to the rows that reuse it."""

    def __init__(self, ttl_us: int, results: T.StructType, names: list[str], stretch_ms: int):
        super().__init__(list(results.fields), stretch_ms)
        self.ttl_us, self.names = ttl_us, names

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_time_order(rows)
        held, none, out = self.held(), (None, (None,) * len(self.fields)), []
        values = zip(*[plain_values(pdf[f.name], f.dataType) for f in self.fields])
        for k, hit, t, own in zip(_keys(pdf), pdf["hit"].tolist(), pdf["t"].tolist(), values):
            if not hit:
                held[k] = (t + self.ttl_us, own)
            out.append(held.get(k, none)[1])
        self.hold(held, timerValues)
        fields = [f.name for f in self.fields]
        made = pd.DataFrame(out, columns=fields, index=pdf.index, dtype=object)
        yield pdf.drop(columns=fields).join(made)[self.names]


def _keys(pdf: pd.DataFrame) -> list:
    return plain_values(pdf["by_key"], T.StringType())


def _by_shard(ordered: DataFrame):
    return ordered.withColumn("reuse_shard", F.pmod(F.xxhash64("by_key"), F.lit(SHARDS))).groupBy("reuse_shard")


def stream_reuse(
    stream: DataFrame,
    key: Column,
    ttl_s: int,
    result: Column | None = None,
    delay: str = "1 minute",
    stretch_ms: int = STRETCH_MS,
) -> DataFrame:
    """(request_id, key, ts, hit, computed_by, and ``result``) of a stream with request_id and ts.

    ``result``, a struct of plain columns over the columns of ``stream``, is evaluated for misses only; it is kept
    with its key until its TTL is over and comes back unchanged with the rows that reuse it. Keys are worked through by
    shard, a shard's rows of a micro-batch at once; what is over goes with the next rows of its shard or by an event-time
    timer. Columns of ``stream`` are held until they are released, so keep it narrow.
    """
    ttl_us = ttl_s * 1_000_000
    ordered = in_event_order(stream.withColumn("by_key", key.cast("string")), delay, stretch_ms=stretch_ms)
    decided = _by_shard(ordered).transformWithStateInPandas(
        _Windows(ttl_us, ordered.columns, stretch_ms),
        T.StructType(list(ordered.schema.fields)).add("hit", "boolean").add("computed_by", "string"),
        "Append",
        "EventTime",
        eventTimeColumnName="released",
    )
    named = ["request_id", F.col("by_key").alias("key"), F.timestamp_micros("t").alias("ts"), "hit", "computed_by"]
    if result is None:
        return decided.select(*named)
    computed = decided.withColumn("_result", F.when(~F.col("hit"), result))
    fields = computed.schema["_result"].dataType
    flat = T.StructType([T.StructField(f"result_{i}", f.dataType) for i, f in enumerate(fields)])
    base = ["t", "request_id", "by_key", "hit", "computed_by", "released"]
    asked = computed.select(
        *base, *[F.col("_result")[f.name].alias(f"result_{i}") for i, f in enumerate(fields)]
    )
    attached = _by_shard(asked).transformWithStateInPandas(
        _Results(ttl_us, flat, asked.columns, stretch_ms),
        asked.schema,
        "Append",
        "EventTime",
        eventTimeColumnName="released",
    )
    again = F.struct(*[F.col(f"result_{i}").alias(f.name) for i, f in enumerate(fields)])
    return attached.select(*named, again.alias("result"))


def _windowed(log: DataFrame, delay: str, width: str, *by: Column | str):
    return log.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *by)


def stream_metrics(
    request_log: DataFrame, delay: str = "1 minute", width: str = "1 minute"
) -> DataFrame:
    """Per window: requests, duration sum, exhausted requests."""
    counted = _windowed(request_log, delay, width).agg(
        F.count("*").alias("requests"),
        F.sum("duration_ms").alias("duration_sum_ms"),
        F.count_if("exhausted").alias("exhausted_requests"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"), "requests", "duration_sum_ms", "exhausted_requests"
    )


def stream_quantiles(
    request_log: DataFrame, delay: str = "1 minute", width: str = "1 minute"
) -> DataFrame:
    """Per closed window: samples and exact nearest-rank quantiles of all its durations.

    State is a count per window and value, so a busy window is many keys; when the window closes its distinct
    values, no more than its milliseconds differ, are put in order once.
    """
    values = _windowed(request_log, delay, width, "duration_ms").agg(F.count("*").alias("n"))
    timed = F.col("duration_ms").isNotNull()  # a filter on it would reach the scan and keep markers from the watermark
    listed = values.groupBy("w").agg(
        F.sum(F.when(timed, F.col("n"))).alias("samples"),
        F.sort_array(F.collect_list(F.when(timed, F.struct("duration_ms", "n")))).alias("values"),
    ).where("samples > 0")

    def at_rank(q: float) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("found"))
        rank = rank_index(F.col("samples"), q)
        walked = F.aggregate(
            "values",
            none,
            lambda s, v: F.struct(
                (s["before"] + v["n"]).alias("before"),
                F.coalesce(s["found"], F.when(s["before"] + v["n"] > rank, v["duration_ms"].cast("bigint"))).alias("found"),
            ),
        )
        return walked["found"].cast("double")

    return listed.select(
        F.col("w.start").alias("window_start"),
        "samples",
        *[at_rank(q).alias(f"p{name[2:]}") for name, q in QUANTILES],
    )


def stream_call_metrics(
    call_log: DataFrame, delay: str = "1 minute", width: str = "1 minute"
) -> DataFrame:
    """Per window, provider and outcome class: number of attempts."""
    outcome = F.when(is_success(F.col("status")), F.lit("2xx")).otherwise(
        status_class(F.col("status"))
    )
    counted = _windowed(call_log, delay, width, "provider", outcome.alias("outcome")).agg(
        F.count("*").alias("attempts")
    )
    return counted.select(F.col("w.start").alias("window_start"), "provider", "outcome", "attempts")


def stream_lookup_metrics(
    lookups: DataFrame, delay: str = "1 minute", width: str = "1 minute"
) -> DataFrame:
    """Per window: hits by layer, misses and the hit ratio; ``layer`` is memory, shared or miss."""
    layer = F.col("layer")
    counted = _windowed(lookups, delay, width).agg(
        F.count_if(layer == "memory").alias("memory_hits"),
        F.count_if(layer == "shared").alias("shared_hits"),
        F.count_if(layer == "miss").alias("misses"),
        (F.count_if(layer != "miss") / F.count("*")).alias("hit_ratio"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"), "memory_hits", "shared_hits", "misses", "hit_ratio"
    )


def stream_transitions(
    transitions: DataFrame, delay: str = "1 minute", width: str = "1 minute"
) -> DataFrame:
    """Per window and pair of tiers: number of fallbacks."""
    counted = _windowed(transitions, delay, width, "from_tier", "to_tier").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "from_tier", "to_tier", "n")


def stream_redact(lines: DataFrame, secrets: Iterable[str]) -> DataFrame:
    """Stateless: the batch rule on every line."""
    return redact_lines(lines, secrets)


def requests_with_payloads(
    requests: DataFrame, payloads: DataFrame, wait: str = "5 minutes", delay: str = "1 minute"
) -> DataFrame:
    """Valid requests, each once, with the list of payloads received within ``wait`` of it.

    Two streams under a watermark each: an outer join by request and interval of time, then one row per
    request when no payload of it can come any more. Requests need their columns of ``schemas.REQUESTS``,
    payloads those of ``schemas.PAYLOADS``; a request without payloads comes with an empty list.
    """
    checked = with_details(requests.withWatermark("ts", delay))
    marker = F.col("request_id").isNull()  # a filter that drops markers would be moved below the watermark
    asked = checked.where(marker | (F.size("details") == 0)).select(
        F.col("request_id").alias("asked"), "ts", F.struct("symbols", "max_articles").alias("request")
    )
    given = payloads.withWatermark("received_at", delay).select(
        "request_id",
        "received_at",
        F.struct("request_id", "feed", "ticker", "http_status", "body").alias("payload"),
    )
    in_time = F.expr(f"request_id = asked and received_at >= ts and received_at <= ts + interval {wait}")
    return (
        asked.join(given, in_time, "leftOuter")
        .groupBy("ts", "asked")
        .agg(F.first("request").alias("request"), F.collect_list("payload").alias("payloads"))
        .select(F.col("asked").alias("request_id"), "ts", "request.*", "payloads")
    )


def score_requests(batch: DataFrame, params: Params, scorer: Scorer = keyword_scorer) -> DataFrame:
    """Local results of requests with their payloads; requests without news for a symbol have no row for it.

    The batch is landed first: it is read twice, and what a timer lets go counts as empty in the plan's estimates, by
    which all mentions would be broadcast through the driver. Runs a job.
    """
    batch = cut_lineage(batch)
    symbols = request_symbols(batch.drop("payloads"))
    given = batch.select(F.inline("payloads"))
    states = waterfall(symbols, given, params)
    return local_results(scorer(states.where(F.col("article_count") > 0)))


def stream_ingest(
    requests: DataFrame,
    payloads: DataFrame,
    params: Params,
    out: str,
    checkpoint: str,
    scorer: Scorer = keyword_scorer,
    wait: str = "5 minutes",
    delay: str = "1 minute",
):
    """Writer of the ingest path: validate, wait for payloads, decode, score, upsert by (request_id, idx)."""
    complete = requests_with_payloads(requests, payloads, wait, delay)
    return stream_pipeline(complete, lambda batch: score_requests(batch, params, scorer), out, checkpoint)


def stream_pipeline(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
):
    """Writer that runs a batch plan on every micro-batch.

    A batch is written under the name of its stream and its number, so a batch that is repeated after a failure
    overwrites itself; ``sinks.read_upserted`` gives one row per key over all batches and streams.
    """

    def write(batch: DataFrame, number: int) -> None:
        upsert_batch(step(batch), out, checkpoint, number)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def run_available(frame: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what the source holds now into Parquet and stop. Runs the stream."""
    query = (
        frame.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
