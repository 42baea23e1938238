"""Queries on the streaming jobs: rows arrive late and in slices, and the last rows are let go by a marker.

A table is dealt into slices by time of arrival, its event time plus up to ``jitter`` seconds by hash of the row. The
stream runs once per slice and stops, so every slice after the first is a restart from the checkpoint; the
end marker comes with the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodwire import schemas
from moodwire.functions.labels import keyword_sentiment
from moodwire.operators.scoring import keyword_scorer
from moodwire.params import Params
from moodwire.session import cut_lineage, new_scratch_path
from moodwire.sources.sinks import read_upserted
from moodwire.streaming import jobs
from moodwire.streaming.ordered import Arrivals, end_marker, observed
from workload import adapters as D
from workload import news as N
from workload import ops as O
from workload import requests as Q
from workload import reuse as U
from workload.registry import ORACLES, Tables, query
from workload.results import LOCAL, noted_documents

SLICES = 2
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
AFTER_ALL = "2100-01-01 00:00:00"


def at_arrival(rows: DataFrame, jitter_s: int) -> DataFrame:
    """``rows`` with ``_at``, microseconds of arrival."""
    late = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "symbols"]), F.lit(jitter_s * 1_000_000))
    return rows.withColumn("_at", F.unix_micros("ts") + late)


def in_slices(t: Tables, rows: DataFrame, deliver: Callable, run: Callable, jitter_s: int, slices: int = SLICES) -> None:
    """Cut ``rows`` into slices of arrival time and run after each; ``deliver(slice, last)`` writes one. Runs jobs."""
    dealt = cut_lineage(at_arrival(rows, jitter_s))
    first, last = dealt.agg(F.min("_at"), F.max("_at")).first()
    width = (last - first) // slices + 1
    for k in range(slices):
        here = F.col("_at").between(first + k * width, first + (k + 1) * width - 1)
        deliver(dealt.where(here).drop("_at"), k == slices - 1)
        run()


def streamed(
    t: Tables, rows: DataFrame, name: str, job: Callable[[DataFrame], DataFrame], jitter_s: int,
    slices: int = SLICES,
) -> DataFrame:
    """What ``job`` writes for a stream of ``rows`` (with ``ts``) that arrive in slices, the end included."""
    source, out, state = (new_scratch_path(t.spark, f"{name}-{k}") for k in ("in", "out", "state"))
    stream = lambda: job(t.spark.readStream.schema(rows.schema).parquet(source))

    def deliver(part: DataFrame, last: bool) -> None:
        part.write.mode("append").parquet(source)
        if last:
            end_marker(rows, AFTER_ALL).write.mode("append").parquet(source)

    in_slices(t, rows, deliver, lambda: jobs.run_available(stream(), out, state), jitter_s, slices)
    return t.spark.read.schema(stream().schema).parquet(out)


# ------------------------------------------------------------------------------ admission


@query("st1_stream_admit", ORACLES["t2_tenant_limit"])
def stream_admit(t: Tables):
    asked = D.timed_requests(t).select("request_id", "ts", "tenant")
    limit = lambda s: jobs.stream_limit(s, F.col("tenant"), Q.TENANT_LIMIT)
    return streamed(t, asked, "limit", limit, 50).select(
        "request_id", F.col("key").alias("tenant"), "admitted"
    )


@query("st1_stream_admission_order", ORACLES["t3_admission_order"])
def stream_admission_order(t: Tables):
    """Validation, tenant, global and tenant limit as one chain on rows in shuffled arrival."""
    params = Params(auth_mode="jwt", global_per_minute=Q.GLOBAL_LIMIT, tenant_per_minute=Q.TENANT_LIMIT)
    decided = streamed(t, Q.claimed_requests(t), "admit", lambda s: jobs.stream_admit(s, params), 50, 3)
    return decided.select("request_id", F.coalesce("outcome_code", F.lit("OK")).alias("outcome"))


@query(
    "st1_late_and_repeated",
    """
with sized as (select event_id, epoch_us(ts) as t, epoch_us(min(ts) over ()) as first,
    epoch_us(max(ts) over ()) as last from events),
kinds as (select *, event_id % 10 = 3 as twice, event_id % 10 = 7 and t <= first + (last - first) // 4 as too_late from sized)
select (count(*) + count(*) filter (where twice) + count(*) filter (where too_late))::bigint as arrived,
  (count(*) filter (where twice))::bigint as repeated, (count(*) filter (where too_late))::bigint as late,
  count(*)::bigint as released from kinds""",
)
def late_and_repeated(t: Tables):
    """Rows sent twice and rows sent again under a new id when the watermark has passed them, all counted."""
    rows = t.events.select(F.col("event_id").cast("string").alias("request_id"), "ts", "event_id")
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    half, quarter = first + (last - first) // 2, first + (last - first) // 4
    n, at = F.col("event_id"), F.unix_micros("ts")
    again = rows.where(n % 10 == 3)
    too_late = rows.where((n % 10 == 7) & (at <= quarter)).withColumn(
        "request_id", F.concat("request_id", F.lit("-again"))
    )
    source, out, state = (new_scratch_path(t.spark, f"late-{k}") for k in ("in", "out", "state"))

    def released() -> DataFrame:
        stream = observed(t.spark.readStream.schema(rows.schema).parquet(source))
        return jobs.in_event_order(stream.select("request_id", "ts"), "1 hour", stretch_ms=3_600_000)

    counts = Arrivals()
    t.spark.streams.addListener(counts)
    try:
        for part, marker in (
            (rows.unionByName(again).where(at < half), False),
            (rows.unionByName(again).where(at >= half).unionByName(too_late), True),
        ):
            part.write.mode("append").parquet(source)
            if marker:
                end_marker(rows, AFTER_ALL).write.mode("append").parquet(source)
            jobs.run_available(released(), out, state)
            counts.wait()
    finally:
        t.spark.streams.removeListener(counts)
    found = t.spark.read.schema(released().schema).parquet(out)
    return found.agg(F.count("*").alias("released")).select(
        F.lit(counts.arrived).cast("bigint").alias("arrived"),
        F.lit(counts.repeated).cast("bigint").alias("repeated"),
        F.lit(counts.late).cast("bigint").alias("late"),
        "released",
    )


# ------------------------------------------------------------------------------ reuse


def reuse_rows(t: Tables) -> DataFrame:
    return D.reuse_log(t).select("request_id", "ts", "cache_key")


@query("st2_stream_reuse", ORACLES["c3_replay_hits"])
def stream_reuse(t: Tables):
    job = lambda s: jobs.stream_reuse(s, F.col("cache_key"), U.TTL_S, delay="1 hour", stretch_ms=HOUR_US // 1000)
    return streamed(t, reuse_rows(t), "reuse", job, 3000).select(
        F.col("request_id").cast("bigint").alias("event_id"), "hit"
    )


@query(
    "st2_stream_reused_result",
    f"""
with recursive seq as materialized (
  select event_id, 'U' || user_id as k, epoch_us(ts) as t, value, event_type,
    row_number() over (partition by user_id order by ts, event_id) as rn from events),
fold as (
  select event_id, k, rn, t + {U.TTL_US} as e, false as hit, event_id as by_event, event_type as title from seq where rn = 1
  union all
  select s.event_id, s.k, s.rn, case when s.t < f.e then f.e else s.t + {U.TTL_US} end, s.t < f.e,
    case when s.t < f.e then f.by_event else s.event_id end, case when s.t < f.e then f.title else s.event_type end
  from fold f join seq s on s.k = f.k and s.rn = f.rn + 1)
select event_id, hit, by_event, case when title = 'error' then 'bearish' else 'neutral' end as label,
  case when title = 'error' then -0.5::double else 0.0::double end as sentiment_score,
  length(title)::int as article_count from fold""",
)
def stream_reused_result(t: Tables):
    """Every row comes back with the result of the row that computed it, whatever the order of arrival."""
    title = F.col("event_type")
    text = F.when(title == "error", F.lit("A bear day")).otherwise(title)
    scored = keyword_sentiment(text)
    result = F.struct(
        F.col("request_id").alias("symbol"),
        scored["sentiment_score"].alias("sentiment_score"),
        scored["label"].alias("label"),
        F.length(title).alias("article_count"),
    )
    rows = reuse_rows(t).join(
        t.events.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"), "event_type"),
        "request_id",
    )
    job = lambda s: jobs.stream_reuse(s, F.col("cache_key"), U.TTL_S, result, "1 hour", HOUR_US // 1000)
    return streamed(t, rows, "reused", job, 3000).select(
        F.col("request_id").cast("bigint").alias("event_id"),
        "hit",
        F.col("computed_by").cast("bigint").alias("by_event"),
        "result.label",
        "result.sentiment_score",
        "result.article_count",
    )


# ------------------------------------------------------------------------------ metrics


def window_us(width_us: int) -> str:
    return f"epoch_us(ts) // {width_us} * {width_us} as window_us"


@query(
    "st3_stream_metrics",
    f"""
with {D.REQUEST_LOG}
select {window_us(HOUR_US)}, count(*) as requests, sum(duration_ms)::bigint as duration_sum_ms,
  count(*) filter (where exhausted) as exhausted_requests
from request_log group by 1""",
)
def stream_metrics(t: Tables):
    """Hourly windows, the last ones included."""
    job = lambda s: jobs.stream_metrics(s, "1 hour", "1 hour")
    return streamed(t, D.request_log(t), "metrics", job, 3000).select(
        F.unix_micros("window_start").alias("window_us"), "requests", "duration_sum_ms", "exhausted_requests"
    )


@query(
    "st3_stream_quantiles",
    f"""
with {D.REQUEST_LOG},
placed as (
  select {window_us(DAY_US)}, duration_ms, row_number() over (partition by epoch_us(ts) // {DAY_US} order by duration_ms) - 1 as place,
    count(*) over (partition by epoch_us(ts) // {DAY_US}) as n from request_log)
select window_us, n as samples, {", ".join(
        f"max(duration_ms) filter (where place = floor((n - 1) * {q} + 0.5))::double as p{name[2:]}"
        for name, q in (("0.50", 0.5), ("0.95", 0.95), ("0.99", 0.99)))}
from placed group by 1, 2""",
)
def stream_quantiles(t: Tables):
    job = lambda s: jobs.stream_quantiles(s, "1 hour", "1 day")
    return streamed(t, D.request_log(t), "quantiles", job, 3000).select(
        F.unix_micros("window_start").alias("window_us"), "samples", "p50", "p95", "p99"
    )


WEEK_US = 7 * DAY_US


@query(
    "st3_stream_calls",
    f"""
with {D.CALL_LOG}
select at_ms * 1000 // {WEEK_US} * {WEEK_US} as window_us, provider,
  case when status is null then 'network' else (status // 100) || 'xx' end as outcome, count(*) as attempts
from call_log group by all""",
)
def stream_calls(t: Tables):
    calls = D.call_log(t).select("call_id", "ts", "provider", "attempt", "status")
    job = lambda s: jobs.stream_call_metrics(s, "1 hour", "7 days")
    return streamed(t, calls, "calls", job, 3000).select(
        F.unix_micros("window_start").alias("window_us"), "provider", "outcome", "attempts"
    )


@query(
    "st3_stream_lookups",
    f"""
select {window_us(HOUR_US)}, count(*) filter (where event_type = 'click') as memory_hits,
  count(*) filter (where event_type = 'view') as shared_hits,
  count(*) filter (where event_type not in ('click', 'view')) as misses,
  count(*) filter (where event_type in ('click', 'view')) / count(*) as hit_ratio
from events group by 1""",
)
def stream_lookups(t: Tables):
    rows = O.lookups(t, "event_id", "ts")
    job = lambda s: jobs.stream_lookup_metrics(s, "1 hour", "1 hour")
    return streamed(t, rows, "lookups", job, 3000).select(
        F.unix_micros("window_start").alias("window_us"), "memory_hits", "shared_hits", "misses", "hit_ratio"
    )


@query(
    "st3_stream_transitions",
    f"""
select epoch_us(l_shipdate::timestamp) // {WEEK_US} * {WEEK_US} as window_us,
  case when l_returnflag = 'A' then 'tier_2_news' else 'tier_3_llm' end as from_tier,
  case when l_linestatus = 'O' then 'tier_3_llm' else 'intelligence_exhaustion' end as to_tier, count(*) as n
from lineitem group by all""",
)
def stream_transitions(t: Tables):
    rows = O.line_transitions(t, "l_orderkey", F.col("l_shipdate").cast("timestamp").alias("ts"))
    job = lambda s: jobs.stream_transitions(s, "1 hour", "7 days")
    return streamed(t, rows, "transitions", job, 3000).select(
        F.unix_micros("window_start").alias("window_us"), "from_tier", "to_tier", "n"
    )


# ------------------------------------------------------------------------------ ingest


@query(
    "st4_stream_ingest",
    f"""
with {LOCAL}
select request_id, idx::int as idx, symbol, score as sentiment_score, label,
  0.5::double as confidence, 'tier_1_local_onnx' as source_tier, 'batch_news' as news_provider,
  article_count::int as article_count from local""",
)
def stream_ingest(t: Tables):
    """Requests and their payloads as two streams that stop and start again with every slice."""
    requests = N.landed_requests(t)
    asked, given, out, state = (new_scratch_path(t.spark, f"ingest-{k}") for k in ("asked", "given", "out", "state"))
    waited = F.pmod(F.xxhash64("request_id", "feed", "ticker"), F.lit(240_000_000))
    times = requests.select("request_id", "ts").hint("merge")
    received = D.news_payloads(requests).join(times, "request_id").select(
        "request_id", "feed", "ticker", F.lit(None).cast("string").alias("call_id"), "http_status", "body",
        F.timestamp_micros(F.unix_micros("ts") + waited).alias("received_at"), "ts",
    )
    received = cut_lineage(received)
    read = t.spark.readStream

    def deliver(part: DataFrame, last: bool) -> None:
        part.write.mode("append").parquet(asked)
        mine = received.join(part.select("request_id").hint("merge"), "request_id", "left_semi")
        mine.drop("ts").select(received.drop("ts").columns).write.mode("append").parquet(given)
        if last:
            end_marker(requests, AFTER_ALL).write.mode("append").parquet(asked)
            end = end_marker(received.drop("ts"), AFTER_ALL, "received_at", request_id="end")
            end.write.mode("append").parquet(given)

    def run() -> None:
        streams = [read.schema(requests.schema).parquet(asked), read.schema(received.drop("ts").schema).parquet(given)]
        writer = jobs.stream_ingest(*streams, D.NEWS_PARAMS, out, state, wait="4 minutes", delay="5 minutes")
        writer.start().awaitTermination()

    in_slices(t, requests, deliver, run, 240)
    return read_upserted(t.spark, out, f"request_id string, idx int, {schemas.SENTIMENT}").drop("reasoning")


@query(
    "st4_stream_scoring",
    """
with noted as (select doc_id, case when doc_id % 7 = 0 then 'Bear note ' else '' end || text as text
               from documents)
select doc_id as key, case when contains(lower(text), 'bear') then 'bearish' else 'neutral' end
  as label from noted""",
)
def stream_scoring(t: Tables):
    """Documents as a stream of news texts through the scorer."""
    out = new_scratch_path(t.spark, "scored")
    run = jobs.stream_pipeline(
        noted_documents(streams(t)),
        lambda batch: keyword_scorer(batch).select("key", "label"),
        out,
        new_scratch_path(t.spark, "scored-state"),
    ).start()
    run.awaitTermination()
    return t.spark.read.parquet(out).select("key", "label")


# ------------------------------------------------------------------------------ redaction


class StreamTables(Tables):
    """The given tables, read as streams."""

    def __getattr__(self, name: str):
        schema = self.spark.read.parquet(self.path(name)).schema
        # As a pattern the path may be one file or a folder of parts; a plain path must be a folder.
        stream = self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{{{name}.parquet}}")
        zoneless = [c for c, kind in stream.dtypes if kind == "timestamp_ntz"]
        return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


@query("st5_stream_redact", ORACLES["v10_redaction"])
def stream_redact(t: Tables):
    masked = jobs.stream_redact(D.log_lines(streams(t)), D.SECRETS)
    out = new_scratch_path(t.spark, "redact")
    jobs.run_available(masked, out, new_scratch_path(t.spark, "redact-state"))
    return t.spark.read.schema(masked.schema).parquet(out).select("o_orderkey", "line")
