"""Queries on security rules, call statistics, metrics and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodwire.functions import calls as C
from moodwire.functions import text as X
from moodwire.operators import health, metrics, security
from moodwire.params import ANSWER_PROVIDERS, FEED_NAMES
from workload import adapters as D
from workload.registry import Tables, query

# ------------------------------------------------------------------------------ security

EXTRA_HOSTS = ("spam-farm.example.org", "Blog.ththan.example.net")


def outgoing_urls(t: Tables):
    """Page addresses; some get a port, some a broken form, some one of the always allowed hosts."""
    n, url = F.col("page_id"), F.col("url")
    known = F.concat(F.lit("HTTPS://API.X.AI/v1?p="), n.cast("string"))
    return t.pages.select(
        "page_id",
        F.when(n % 15 == 0, F.concat(F.lit("//"), url))
        .when(n % 15 == 1, F.concat(known, F.lit("#f")))
        .when(n % 15 == 2, F.lit("https://api.openai.com:8443/v1"))
        .when(n % 15 == 3, F.lit("https://api.openai.com:443/v1"))
        .when(n % 15 == 4, F.lit("https:///v1"))
        .when(n % 15 == 5, F.concat(F.lit("mailto:"), n.cast("string")))
        .when(n % 15 == 6, F.lit("https://user:pw@finnhub.io:99999/"))
        .when(n % 15 == 7, F.concat(F.lit("https://spam-farm.example.org/"), n.cast("string")))
        .when(n % 15 == 8, F.lit("https://[::1]/x"))
        .when(n % 15 == 9, F.lit("https:api.openai.com/v1"))
        .when(n % 15 == 10, F.lit("https://api.openai.com\\v1"))
        .when(n % 15 == 11, F.lit("https://a@b@api.x.ai/"))
        .otherwise(url)
        .alias("url"),
    )


@query(
    "v9_egress_check",
    r"""
with urls as (
  select page_id, case page_id % 15 when 0 then '//' || url
    when 1 then 'HTTPS://API.X.AI/v1?p=' || page_id || '#f'
    when 2 then 'https://api.openai.com:8443/v1' when 3 then 'https://api.openai.com:443/v1'
    when 4 then 'https:///v1' when 5 then 'mailto:' || page_id
    when 6 then 'https://user:pw@finnhub.io:99999/'
    when 7 then 'https://spam-farm.example.org/' || page_id when 8 then 'https://[::1]/x'
    when 9 then 'https:api.openai.com/v1' when 10 then 'https://api.openai.com\v1'
    when 11 then 'https://a@b@api.x.ai/' else url end as url from pages)
select page_id, url, case page_id % 15 when 0 then 'EGRESS_INVALID_URL' when 1 then 'ALLOWED'
  when 2 then 'EGRESS_PORT_DENIED' when 3 then 'ALLOWED' when 4 then 'EGRESS_HOST_DENIED'
  when 5 then 'EGRESS_SCHEME_DENIED' when 6 then 'EGRESS_INVALID_URL' when 7 then 'ALLOWED'
  when 8 then 'EGRESS_HOST_DENIED' when 9 then 'ALLOWED' when 10 then 'ALLOWED' when 11 then 'ALLOWED'
  else case when not starts_with(url, 'https:') then 'EGRESS_SCHEME_DENIED'
    when split_part(url, '/', 3) in ('spam-farm.example.org', 'blog.ththan.example.net') then 'ALLOWED'
    else 'EGRESS_HOST_DENIED' end end as code
from urls""",
)
def egress_check(t: Tables):
    checked = security.check_egress(outgoing_urls(t), EXTRA_HOSTS)
    return checked.withColumn("code", F.coalesce("code", F.lit("ALLOWED")))


@query(
    "v10_redaction",
    f"""
with {D.LOG_LINES}
select o_orderkey, {D.sql_redact('line')} as line from log_lines""",
)
def redaction(t: Tables):
    return security.redact_lines(D.log_lines(t), D.SECRETS).select("o_orderkey", "line")


@query(
    "v10_redacted_documents",
    f"""
select doc_id, md5({D.sql_redact("'Bearer ' || text || '&key=' || text")}) as line from documents""",
)
def redacted_documents(t: Tables):
    text = F.col("text")
    line = F.concat(F.lit("Bearer "), text, F.lit("&key="), text)
    lines = t.documents.select("doc_id", line.alias("line"))
    return security.redact_lines(lines, D.SECRETS).select("doc_id", F.md5("line").alias("line"))


@query(
    "v11_leak_audit",
    f"""
with {D.LOG_LINES}
select source, count(*) as lines,
  count(*) filter (where list_bool_or(list_transform({D.SECRETS!r}, lambda s: contains(line, s)))) as before,
  0::bigint as after
from log_lines group by source""",
)
def leak_audit(t: Tables):
    lines = D.log_lines(t)
    before = security.leak_audit(lines, D.SECRETS).withColumnRenamed("leaking_lines", "before")
    after = security.leak_audit(security.redact_lines(lines, D.SECRETS), D.SECRETS)
    return before.join(
        after.select("source", F.col("leaking_lines").alias("after")), "source"
    ).select("source", "lines", "before", "after")


# ------------------------------------------------------------------------------ small functions


@query(
    "f9_f10_time_stamps",
    """
select event_id, strftime(ts - to_hours((1 + event_id % 168)::int), '%Y%m%dT%H%M') as minute_stamp,
  strftime(ts, '%Y-%m-%d') as date_stamp from events""",
)
def time_stamps(t: Tables):
    hours = (F.lit(1) + F.pmod("event_id", F.lit(168))).cast("int")
    return t.events.select(
        "event_id",
        X.stamp_minute(F.col("ts") - F.make_dt_interval(hours=hours)).alias("minute_stamp"),
        X.stamp_date(F.col("ts")).alias("date_stamp"),
    )


@query(
    "f11_f13_call_functions",
    f"""
with {D.CALL_LOG}
select call_id, attempt,
  case when status is null then 'network' else (status // 100) || 'xx' end as status_class,
  coalesce(status >= 500, error_kind is not null) as retryable,
  least(120 * (1 << attempt) + seed % 75, 900)::bigint as backoff_ms from call_log""",
)
def call_functions(t: Tables):
    return D.call_log(t).select(
        "call_id",
        "attempt",
        C.status_class(F.col("status")).alias("status_class"),
        C.retryable(F.col("status"), F.col("error_kind")).alias("retryable"),
        C.backoff_ms(F.col("attempt"), F.col("jitter_seed")).alias("backoff_ms"),
    )


@query("f14_body_preview", "select doc_id, md5(left(text, 512)) as preview from documents")
def body_preview(t: Tables):
    return t.documents.select("doc_id", F.md5(X.preview(F.col("text"))).alias("preview"))


@query(
    "f15_rank_index",
    """
select l_suppkey, count(*) as n, round((count(*) - 1) * 0.5::double)::int as p50,
  round((count(*) - 1) * 0.95::double)::int as p95, round((count(*) - 1) * 0.99::double)::int as p99
from lineitem group by l_suppkey""",
)
def rank_index(t: Tables):
    counted = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return counted.select(
        "l_suppkey",
        "n",
        *[C.rank_index(F.col("n"), q).alias(f"p{name[2:]}") for name, q in metrics.QUANTILES],
    )


@query(
    "f16_request_ids",
    "select event_type, count(*) as ids, count(*) as well_formed from events group by event_type",
)
def request_ids(t: Tables):
    """New ids are random; their number and form are not."""
    named = t.events.select("event_type", X.new_request_id().alias("id"))
    return named.groupBy("event_type").agg(
        F.count("id").alias("ids"),
        F.count_if(F.rlike("id", F.lit("^tp_[0-9a-f]{32}$"))).alias("well_formed"),
    )


# ------------------------------------------------------------------------------ metrics


def _picks_sql() -> str:
    return ", ".join(
        f"list_sort(list(duration_ms))[round((count(*) - 1) * {q}::double)::int + 1]::double as p{n[2:]}"
        for n, q in metrics.QUANTILES
    )


def _quantiles_sql(by: str) -> str:
    part = f"partition by {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
newest as (select *, row_number() over ({part} order by ts desc, request_id desc) as rn
           from request_log),
quantiles as (select {lead}count(*)::int as samples, {_picks_sql()} from newest where rn <= 4096 {group})
"""


@query(
    "w3_last_samples",
    f"""
with {D.REQUEST_LOG}
select request_id, duration_ms from request_log order by ts desc, request_id desc limit 4096""",
)
def last_samples(t: Tables):
    return metrics.last_samples(D.request_log(t)).select("request_id", "duration_ms")


@query(
    "w3_last_samples_by_type",
    f"""
with {D.REQUEST_LOG},
placed as (select *, row_number() over (partition by event_type order by ts desc, request_id desc)
  as rn from request_log)
select event_type, request_id from placed where rn <= 100""",
)
def last_samples_by_type(t: Tables):
    return metrics.last_samples(D.request_log(t), 100, ["event_type"]).select(
        "event_type", "request_id"
    )


@query("m1_duration_quantiles", f"with {D.REQUEST_LOG}, {_quantiles_sql('')} select * from quantiles")
def duration_quantiles(t: Tables):
    return metrics.duration_quantiles(D.request_log(t))


@query(
    "m1_quantiles_by_type",
    f"with {D.REQUEST_LOG}, {_quantiles_sql('event_type')} select * from quantiles",
)
def quantiles_by_type(t: Tables):
    return metrics.duration_quantiles(D.request_log(t), ["event_type"])


TOTALS = """
totals as (
  select sum(duration_ms)::bigint as duration_sum_ms, count(*) as requests,
    count(*) filter (where exhausted) as exhausted_requests, avg(exhausted::int) as exhaustion_rate
  from request_log)
"""


@query(
    "m1_window_quantiles",
    f"""
with request_log as (
  select epoch_us(ts) // 86400000000 * 86400000000 as window_us, ts,
    lpad(event_id::varchar, 12, '0') as request_id, floor(value * 10)::bigint as duration_ms
  from events)
select window_us, count(*)::int as samples, {_picks_sql()} from request_log group by window_us""",
)
def window_quantiles(t: Tables):
    """Over all durations of a day, however many they are."""
    day_us = 86_400_000_000
    at = F.unix_micros("ts")
    return metrics.whole_quantiles(D.request_log(t).withColumn("window_us", at - F.pmod(at, F.lit(day_us))), ["window_us"])


@query(
    "m2_m6_request_totals",
    f"""
with {D.REQUEST_LOG}, {TOTALS}
select duration_sum_ms, requests, exhausted_requests, round(exhaustion_rate, 6) as exhaustion_rate
from totals""",
)
def request_totals(t: Tables):
    return metrics.request_totals(D.request_log(t)).withColumn(
        "exhaustion_rate", F.round("exhaustion_rate", 6)
    )


def lookups(t: Tables, *keep):
    """Symbol lookups by event type: what kind of answer each got."""
    return t.events.select(
        *keep,
        F.when(F.col("event_type") == "click", "memory")
        .when(F.col("event_type") == "view", "shared")
        .otherwise("miss")
        .alias("layer")
    )


LOOKUPS = """
lookups as (
  select count(*) filter (where event_type = 'click') as memory_hits, count(*) filter (where event_type = 'view') as shared_hits,
    count(*) filter (where event_type not in ('click', 'view')) as misses,
    count(*) filter (where event_type in ('click', 'view')) / count(*) as hit_ratio from events)
"""


@query(
    "m3_lookup_totals",
    f"""
with {LOOKUPS}
select memory_hits, shared_hits, misses, round(hit_ratio, 6) as hit_ratio from lookups""",
)
def lookup_totals(t: Tables):
    return metrics.lookup_totals(lookups(t)).withColumn("hit_ratio", F.round("hit_ratio", 6))


def calls_and_notices(t: Tables):
    """The call log, and a notice row for every answered call of provider p0."""
    made = D.call_log(t)
    notices = made.filter((F.col("provider") == "p0") & (F.col("status") == 200)).withColumn(
        "error_kind", F.lit("payload")
    )
    return made.unionByName(notices)


RATES = """
per_provider as (select provider, count(*) as calls from call_log group by provider),
classed as (
  select provider, case when status is null then 'network' else (status // 100) || 'xx' end as c
  from call_log where status is null or status not between 200 and 299
  union all
  select provider, '2xx_payload_error' from call_log where provider = 'p0' and status = 200),
rates as (
  select provider, c as status_class, count(*) as errors, any_value(calls) as calls,
    count(*) / any_value(calls) as error_rate
  from classed join per_provider using (provider) group by provider, c)
"""


@query(
    "m4_provider_error_rates",
    f"""
with {D.CALL_LOG}, {RATES}
select provider, status_class, errors, calls, round(error_rate, 6) as error_rate from rates""",
)
def provider_error_rates(t: Tables):
    return metrics.provider_error_rates(calls_and_notices(t)).withColumn(
        "error_rate", F.round("error_rate", 6)
    )


def line_transitions(t: Tables, *keep):
    return t.lineitem.select(
        *keep,
        F.when(F.col("l_returnflag") == "A", "tier_2_news").otherwise("tier_3_llm").alias(
            "from_tier"
        ),
        F.when(F.col("l_linestatus") == "O", "tier_3_llm")
        .otherwise("intelligence_exhaustion")
        .alias("to_tier"),
    )


STEPS = """
steps as (
  select case when l_returnflag = 'A' then 'tier_2_news' else 'tier_3_llm' end as from_tier,
    case when l_linestatus = 'O' then 'tier_3_llm' else 'intelligence_exhaustion' end as to_tier,
    count(*) as n from lineitem group by 1, 2)
"""


@query("m5_transition_counts", f"with {STEPS} select * from steps")
def transition_counts(t: Tables):
    return metrics.transition_counts(line_transitions(t))


OUTCOMES = """
outcomes as (
  select call_id, provider, count(*) as attempts, max(attempt) as last_attempt,
    arg_max(coalesce(status, -1), attempt) as final_status from call_log group by all)
"""


@query(
    "w6_final_attempts",
    f"""
with {D.CALL_LOG}, {OUTCOMES}
select call_id, attempts, final_status::int as final_status,
  case when final_status = -1 then 'timeout' else '' end as final_error from outcomes""",
)
def final_attempts(t: Tables):
    return metrics.call_outcomes(D.call_log(t)).select(
        "call_id",
        "attempts",
        F.coalesce("final_status", F.lit(-1)).alias("final_status"),
        F.coalesce("final_error", F.lit("")).alias("final_error"),
    )


@query(
    "m7_call_outcomes",
    f"""
with {D.CALL_LOG}, {OUTCOMES}
select provider, attempts, count(*) as calls, count(*) filter (where final_status = 200) as succeeded,
  count(*) filter (where final_status = 200 and attempts > 1) as saved_by_retry,
  count(*) filter (where attempts = 3 and (final_status >= 500 or final_status = -1)) as gave_up
from outcomes group by all""",
)
def call_outcomes(t: Tables):
    return (
        metrics.call_outcomes(D.call_log(t))
        .groupBy("provider", "attempts")
        .agg(
            F.count("*").alias("calls"),
            F.count_if("succeeded").alias("succeeded"),
            F.count_if("saved_by_retry").alias("saved_by_retry"),
            F.count_if("gave_up").alias("gave_up"),
        )
    )


@query(
    "m8_backoff_audit",
    f"""
with {D.CALL_LOG},
gaps as (
  select call_id, provider, attempt, at_ms - lag(at_ms) over w as observed_ms,
    lag(attempt) over w as before, lag(seed) over w as seed0
  from call_log window w as (partition by call_id order by attempt))
select call_id, provider, attempt, observed_ms,
  least(120 * (1 << before) + seed0 % 75, 900)::bigint as expected_ms,
  observed_ms >= least(120 * (1 << before) + seed0 % 75, 900) as kept_schedule
from gaps where before is not null""",
)
def backoff_audit(t: Tables):
    return metrics.backoff_audit(D.call_log(t))


PROVIDERS = [*FEED_NAMES.values(), *ANSWER_PROVIDERS]


READINESS = f"""
with probes as (
  select c_nationkey as deployment, {PROVIDERS!r}[(c_custkey // 3) % 7 + 1] as provider,
    [200, 429, 500][c_custkey % 3 + 1] as status, c_custkey as seen from customer),
configured as (
  select distinct s_nationkey as deployment, {PROVIDERS!r}[s_suppkey % 7 + 1] as provider
  from supplier where s_acctbal > 3000),
primary_up as (
  select deployment, arg_max(status, seen) in (200, 429) as up from probes
  where provider = 'tiingo' group by deployment),
facts as (
  select deployment, bool_or(coalesce(up, false)) as up,
    bool_or(provider in ('marketaux', 'alphavantage', 'finnhub')) as fallback,
    bool_or(provider in ('grok', 'deepseek', 'openai')) as answers
  from (select deployment, up, null as provider from primary_up
        union all select deployment, false, provider from configured
        union all select distinct deployment, false, null from probes)
  group by deployment)
"""


def deployments(t: Tables):
    """Probes by customer, configured providers by supplier, deployments by nation."""
    names = F.array(*[F.lit(p) for p in PROVIDERS])
    key = F.col("c_custkey")
    probes = t.customer.select(
        F.col("c_nationkey").alias("deployment"),
        F.get(names, F.floor(key / 3).cast("int") % 7).alias("provider"),
        F.get(F.array(F.lit(200), F.lit(429), F.lit(500)), (key % 3).cast("int")).alias("status"),
        F.timestamp_seconds(key).alias("ts"),
    )
    listed = F.get(names, (F.col("s_suppkey") % 7).cast("int"))
    configured = t.supplier.select(
        F.col("s_nationkey").alias("deployment"),
        F.when(F.col("s_acctbal") > 3000, listed).otherwise(F.lit("unlisted")).alias("provider"),
    )
    return probes, configured


@query(
    "m9_readiness",
    f"""
{READINESS}
select deployment,
  case when (up or coalesce(fallback, false)) and coalesce(answers, false) then 'operational'
    else 'degraded' end as status,
  'operational' as tier_1_status,
  case when up or coalesce(fallback, false) then 'operational' else 'degraded' end as tier_2_status,
  case when up then '' when fallback then
    'primary_news_provider_unavailable_using_fallback_capacity'
    else 'no_news_provider_available' end as tier_2_reason,
  case when coalesce(answers, false) then 'operational' else 'degraded' end as tier_3_status,
  case when coalesce(answers, false) then '' else 'no_llm_provider_configured' end as tier_3_reason
from facts""",
)
def readiness(t: Tables):
    ready = health.readiness(*deployments(t), ["deployment"])
    return ready.withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("tier_2_reason", "tier_3_reason")}
    )


@query(
    "m9_provider_status",
    f"""
with {READINESS.strip().removeprefix("with ")},
known as (select unnest({PROVIDERS!r}) as provider)
select deployment, case when provider in ('grok', 'deepseek', 'openai') then 'tier_3_llm' else 'tier_2_news' end as tier,
  provider, case when provider = 'tiingo' then case when coalesce(up, false) then 'operational' else 'degraded' end
    when exists (select 1 from configured c where c.deployment = f.deployment and c.provider = k.provider) then 'configured'
    else 'not_configured' end as status,
  'not_configured' as breaker_state
from facts f, known k""",
)
def provider_status(t: Tables):
    return health.provider_status(*deployments(t), ["deployment"])


def stated(names: list[str]) -> str:
    """SQL for the JSON blocks of providers whose states stand in columns of their names."""
    blocks = ["'\"" + p + '":{"status":"\' || ' + p + " || '" + '","breaker_state":"not_configured"}\'' for p in names]
    return " || ',' || ".join(blocks)


@query(
    "m9_readiness_body",
    f"""
with {READINESS.strip().removeprefix("with ")},
marks as (
  select deployment, {", ".join(
        f"case when bool_or(provider = '{p}') then 'configured' else 'not_configured' end as {p}" for p in PROVIDERS[1:])}
  from (select deployment, provider from configured union all select distinct deployment, null from probes) group by 1),
said as (
  select *, case when coalesce(up, false) then 'operational' else 'degraded' end as tiingo,
    case when up or coalesce(fallback, false) then 'operational' else 'degraded' end as two,
    case when coalesce(answers, false) then 'operational' else 'degraded' end as three,
    case when up then 'null' when fallback then '"primary_news_provider_unavailable_using_fallback_capacity"'
      else '"no_news_provider_available"' end as two_why,
    case when coalesce(answers, false) then 'null' else '"no_llm_provider_configured"' end as three_why
  from facts join marks using (deployment))
select deployment, '{{"status":"' || case when two = 'operational' then three else 'degraded' end
  || '","tiers":{{"tier_1_local_onnx":{{"status":"operational","degradation_reason":null,"breaker_state":"not_configured"}},'
  || '"tier_2_news":{{"status":"' || two || '","degradation_reason":' || two_why
  || ',"breaker_state":"not_configured","providers":{{'
  || {stated(PROVIDERS[:4])}
  || '}}}},"tier_3_llm":{{"status":"' || three || '","degradation_reason":' || three_why
  || ',"breaker_state":"not_configured","providers":{{'
  || {stated(PROVIDERS[4:])}
  || '}},"execution_order":["grok","deepseek","openai"]}}}}}}' as body
from said""",
)
def readiness_body(t: Tables):
    return health.readiness_body(*deployments(t), ["deployment"])


def _lines_sql() -> str:
    heads = " union all ".join(
        f"select '# HELP {name} {about}' as line union all select '# TYPE {name} {kind}'"
        for name, kind, about in metrics.FAMILIES
    )
    marks = " union all ".join(
        f"select 'request_duration_ms{{quantile=\"{n}\"}} ' || printf('%.3f', p{n[2:]}) from quantiles"
        for n, _ in metrics.QUANTILES
    )
    return f"""
with {D.REQUEST_LOG}, {_quantiles_sql('')}, {TOTALS}, {LOOKUPS}, {D.CALL_LOG}, {RATES}, {STEPS}
{heads} union all {marks}
union all select 'request_duration_ms_sum ' || duration_sum_ms from totals
union all select 'request_duration_ms_count ' || requests from totals
union all select 'tier_exhaustion_rate ' || printf('%.6f', exhaustion_rate) from totals
union all select 'cache_hit_ratio ' || printf('%.6f', hit_ratio) from lookups
union all select 'cache_hit_memory_total ' || memory_hits from lookups
union all select 'cache_hit_redis_total ' || shared_hits from lookups
union all select 'provider_error_rate{{provider="' || provider || '",status_class="' || status_class
  || '"}} ' || printf('%.6f', error_rate) from rates
union all select 'fallback_transition_count{{from="' || from_tier || '",to="' || to_tier || '"}} ' || n
  from steps"""


@query("s10_metrics_lines", _lines_sql())
def metrics_lines(t: Tables):
    samples = metrics.metrics(
        D.request_log(t), calls_and_notices(t), line_transitions(t), lookups(t)
    )
    return metrics.metrics_lines(samples).select("line")
