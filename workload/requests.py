"""Queries on requests: text functions, validation, tenants, limits, envelopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moodwire.functions import text as X
from moodwire.functions.labels import answer_label, model_label
from moodwire.operators import admission, tenancy, validation
from moodwire.operators.envelope import envelope_json, with_envelope
from moodwire.params import Params
from workload import adapters as D
from workload.registry import Tables, query


@query(
    "f1_f5_text_functions",
    f"""
select doc_id, md5({D.sql_trim("' ' || text || chr(160)")}) as trimmed,
  md5({D.SQL_ASCII_UPPER.format('text')}) as upper_ascii,
  md5({D.SQL_ASCII_LOWER.format('text')}) as lower_ascii,
  md5(upper(replace(text, 'ß', 'SS'))) as upper_unicode,
  strlen(text)::int as bytes,
  md5({D.SQL_ASCII_UPPER.format(D.sql_trim('text'))}) as reuse_key,
  md5('news_only:' || {D.SQL_ASCII_UPPER.format(D.sql_trim('text'))}) as news_only_key
from documents""",
)
def text_functions(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        F.md5(X.utrim(F.concat(F.lit(" "), text, F.lit(" ")))).alias("trimmed"),
        F.md5(X.ascii_upper(text)).alias("upper_ascii"),
        F.md5(X.ascii_lower(text)).alias("lower_ascii"),
        F.md5(X.uni_upper(text)).alias("upper_unicode"),
        X.byte_len(text).alias("bytes"),
        F.md5(X.cache_key(text)).alias("reuse_key"),
        F.md5(X.cache_key(text, news_only=True)).alias("news_only_key"),
    )


WORDING = [" Positive", "BULLISH\t", "negative", "Bearish", "neutral", "Weird Ä"]


@query(
    "f6_f7_label_mapping",
    """
with worded as (
  select event_id, case event_id % 6 when 0 then ' Positive' when 1 then 'BULLISH' || chr(9)
    when 2 then 'negative' when 3 then 'Bearish' when 4 then 'neutral' else 'Weird Ä' end as word
  from events),
folded as (select event_id, lower(trim(word, ' ' || chr(9))) as w from worded)
select event_id,
  case when w in ('positive', 'bullish') then 'bullish'
       when w in ('negative', 'bearish') then 'bearish' else 'neutral' end as answer_label,
  case when w in ('positive', 'bullish') then 'bullish'
       when w in ('negative', 'bearish') then 'bearish' else w end as model_label
from folded""",
)
def label_mapping(t: Tables):
    words = F.array(*[F.lit(w) for w in WORDING])
    word = F.get(words, F.pmod("event_id", F.lit(6)).cast("int"))
    return t.events.select(
        "event_id",
        answer_label(word).alias("answer_label"),
        model_label(word).alias("model_label"),
    )


def _rule(t: Tables, details):
    found = D.word_requests(t).select("request_id", details.alias("details"))
    return found.filter(F.size("details") > 0).select(
        "request_id",
        F.size("details").alias("n"),
        F.md5(F.array_join(F.transform("details", lambda d: d["field"]), ",")).alias("fields"),
    )


def _rule_sql(code: str) -> str:
    return f"""
with {D.WORDS}
select doc_id::varchar as request_id, count(*)::int as n,
  md5(string_agg(field, ',' order by i)) as fields
from word_details where code = '{code}' group by doc_id"""


@query("v1_symbol_count", _rule_sql("INVALID_SYMBOL_COUNT"))
def symbol_count(t: Tables):
    return _rule(t, validation.rule_symbol_count(F.col("symbols")))


@query("v2_ticker_length", _rule_sql("INVALID_TICKER"))
def ticker_length(t: Tables):
    return _rule(t, validation.rule_ticker(F.col("symbols")))


@query("v3_name_length", _rule_sql("INVALID_SYMBOL_NAME"))
def name_length(t: Tables):
    return _rule(t, validation.rule_name(F.col("symbols")))


@query("v4_duplicate_symbol", _rule_sql("DUPLICATE_SYMBOL"))
def duplicate_symbol(t: Tables):
    return _rule(t, validation.rule_duplicate(F.col("symbols")))


BOUNDED = "select event_id, (event_id % 200)::int as hours, (event_id % 25)::int as n from events"


@query(
    "v5_lookback_bounds",
    f"""select event_id, 'INVALID_LOOKBACK_HOURS' as code, 'lookback_hours' as field,
  'lookback_hours must be between 1 and 168' as message
from ({BOUNDED}) where hours not between 1 and 168""",
)
def lookback_bounds(t: Tables):
    hours = F.pmod("event_id", F.lit(200)).cast("int")
    return t.events.select(
        "event_id", F.explode(validation.rule_lookback(hours)).alias("d")
    ).select("event_id", "d.*")


@query(
    "v6_article_bounds",
    f"""select event_id, 'INVALID_MAX_ARTICLES' as code, 'max_articles_per_symbol' as field,
  'max_articles_per_symbol must be between 1 and 20' as message
from ({BOUNDED}) where n not between 1 and 20""",
)
def article_bounds(t: Tables):
    limit = F.pmod("event_id", F.lit(25)).cast("int")
    return t.events.select("event_id", F.explode(validation.rule_articles(limit)).alias("d")).select(
        "event_id", "d.*"
    )


@query(
    "v7_split_all_findings",
    f"""
with {D.WORDS}
select d.doc_id::varchar as request_id, count(w.doc_id)::int as n, count(w.doc_id) = 0 as valid,
  md5(coalesce(string_agg(w.code || '@' || w.field, ',' order by part, w.i, rule), '')) as findings
from documents d left join word_details w on d.doc_id = w.doc_id group by d.doc_id""",
)
def split_all_findings(t: Tables):
    checked = validation.with_details(D.word_requests(t))  # both parts in one pass; a clean request has no findings
    findings = F.array_join(
        F.transform("details", lambda d: F.concat(d["code"], F.lit("@"), d["field"])), ","
    )
    return checked.select(
        "request_id",
        F.size("details").alias("n"),
        (F.size("details") == 0).alias("valid"),
        F.md5(findings).alias("findings"),
    )


@query(
    "v7_split_orders",
    f"""
with {D.ORDER_SYMBOLS},
req as (select okey, count(*) as n from all_symbols group by 1)
select 'r' || okey as request_id,
  okey not in (select okey from repeated) and 1 + okey % 200 between 1 and 168
    and 1 + okey % 25 between 1 and 20 as valid
from req""",
)
def split_orders(t: Tables):
    valid, rejected = validation.split_valid(D.order_requests(t, wide_bounds=True))
    return valid.select("request_id", F.lit(True).alias("valid")).unionByName(
        rejected.select("request_id", F.lit(False).alias("valid"))
    )


@query(
    "v1_v7_customer_requests",
    """
with s as (
  select o_custkey as c, row_number() over (partition by o_custkey order by l_orderkey, l_linenumber,
           l_partkey, l_suppkey, l_extendedprice) - 1 as idx,
         'p' || l_partkey as ticker, p_name as name
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
k as (select *, row_number() over (partition by c, upper(ticker) order by idx) as nth from s),
f as (
  select c, 'INVALID_TICKER' as code, 'symbols[' || idx || '].ticker' as field from k
  where strlen(trim(ticker)) not between 1 and 16
  union all
  select c, 'INVALID_SYMBOL_NAME', 'symbols[' || idx || '].name' from k
  where strlen(trim(name)) not between 1 and 120
  union all
  select c, 'DUPLICATE_SYMBOL', 'symbols[' || idx || '].ticker' from k where nth > 1
  union all
  select c, 'INVALID_SYMBOL_COUNT', 'symbols' from s group by c having count(*) > 50)
select 'c' || r.c as request_id, r.n::bigint as n_symbols, count(f.code) as n_findings,
  count(f.code) = 0 as valid,
  count(*) filter (f.code = 'INVALID_SYMBOL_COUNT')::bigint as n_oversized,
  coalesce(min(field) filter (f.code = 'DUPLICATE_SYMBOL'), '') as first_repeat
from (select c, count(*) as n from s group by c) r left join f on r.c = f.c group by r.c, r.n""",
)
def customer_requests(t: Tables):
    """One request per customer with all lines of all orders: many have more than 50 symbols."""
    order = Window.partitionBy("o_custkey").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    symbols = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("request_id"),
            (F.row_number().over(order) - 1).alias("idx"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("ticker"),
            F.col("p_name").alias("name"),
        )
    )
    per = validation.symbol_findings(symbols).groupBy("request_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("code") == "INVALID_SYMBOL_COUNT").alias("over"),
        F.min(F.when(F.col("code") == "DUPLICATE_SYMBOL", F.col("field"))).alias("repeat"),
    )
    sizes = symbols.groupBy("request_id").agg(F.count("*").alias("n_symbols"))
    zero = F.lit(0).cast("long")
    return sizes.join(per, "request_id", "left").select(
        "request_id",
        "n_symbols",
        F.coalesce("n", zero).alias("n_findings"),
        F.col("n").isNull().alias("valid"),
        F.coalesce("over", zero).alias("n_oversized"),
        F.coalesce("repeat", F.lit("")).alias("first_repeat"),
    )


CODES = [
    "INVALID_REQUEST",
    "UNAUTHORIZED",
    "GLOBAL_RATE_LIMITED",
    "TENANT_RATE_LIMITED",
    "INTELLIGENCE_EXHAUSTION",
    "CONFIGURATION_ERROR",
]


@query(
    "v8_error_envelopes",
    """
with coded as (select event_id, user_id, (event_id % 6)::int as c from events)
select event_id,
  case c when 0 then 400 when 1 then 401 when 2 then 429 when 3 then 429 when 4 then 503
    else 500 end as http_status,
  case c
    when 0 then '{"code":"INVALID_REQUEST","message":"Request validation failed.","retry_after_seconds":null,"request_id":"e'
      || event_id || '","details":[{"code":"INVALID_LOOKBACK_HOURS","field":"lookback_hours","message":"lookback_hours must be between 1 and 168"}]}'
    when 1 then '{"code":"UNAUTHORIZED","message":"Valid authentication credentials are required for this endpoint.","retry_after_seconds":null,"request_id":"e'
      || event_id || '","details":[]}'
    when 2 then '{"code":"GLOBAL_RATE_LIMITED","message":"Global protection guard is active.","retry_after_seconds":1,"request_id":"e'
      || event_id || '","details":[]}'
    when 3 then '{"code":"TENANT_RATE_LIMITED","message":"Tenant ''u' || user_id || ''' exceeded request budget.","retry_after_seconds":1,"request_id":"e'
      || event_id || '","details":[{"field":"tenant_id","message":"u' || user_id || '"}]}'
    when 4 then '{"code":"INTELLIGENCE_EXHAUSTION","message":"All upstream providers are currently rate-limited or unreachable.","retry_after_seconds":300,"request_id":"e'
      || event_id || '","details":[{"tier_1":"exhausted","tier_2":"exhausted","tier_3_llm":"cooldown_active"}]}'
    else '{"code":"CONFIGURATION_ERROR","message":"Unsupported auth mode configured.","retry_after_seconds":null,"request_id":"e'
      || event_id || '","details":[]}' end as body
from coded""",
)
def error_envelopes(t: Tables):
    codes = F.array(*[F.lit(c) for c in CODES])
    rejected = t.events.select(
        "event_id",
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tenant"),
        F.get(codes, F.pmod("event_id", F.lit(6)).cast("int")).alias("outcome_code"),
        validation.rule_lookback(F.lit(0)).alias("details"),
    )
    return with_envelope(rejected).select(
        "event_id", "http_status", envelope_json(F.col("envelope")).alias("body")
    )


@query(
    "j4_tenant_by_key",
    """
select 'r' || o_orderkey as request_id,
  coalesce(c_mktsegment, '') as tenant, c_custkey is null as unauthorized
from (select distinct l_orderkey from lineitem join part on l_partkey = p_partkey)
join orders on l_orderkey = o_orderkey
left join customer on c_custkey = o_custkey + (o_orderkey % 2) * 1000000000""",
)
def tenant_by_key(t: Tables):
    named = tenancy.resolve_tenant(
        D.order_requests(t), Params(auth_mode="api_key"), api_keys(t)
    )
    return named.select(
        "request_id",
        F.coalesce("tenant", F.lit("")).alias("tenant"),
        F.coalesce(F.col("outcome_code") == "UNAUTHORIZED", F.lit(False)).alias("unauthorized"),
    )


def api_keys(t: Tables):
    """Customers as key pairs; every key has a second, later pair that must lose."""
    key = F.concat(F.lit("key-"), F.col("c_custkey").cast("string"))
    first = t.customer.select(
        key.alias("api_key"), F.col("c_mktsegment").alias("tenant"), F.col("c_custkey").alias("ord")
    )
    later = first.select("api_key", F.lit("late").alias("tenant"), (F.col("ord") + 10**12).alias("ord"))
    return first.unionByName(later)


@query(
    "j5_tenant_by_claims",
    """
select 'r' || o_orderkey as request_id,
  case when o_orderkey % 3 = 0 then ''
       when o_orderkey % 3 = 2 then 't' || o_custkey
       when o_orderkey % 5 <> 0 then 's' || o_custkey else '' end as tenant
from (select distinct l_orderkey from lineitem join part on l_partkey = p_partkey)
join orders on l_orderkey = o_orderkey""",
)
def tenant_by_claims(t: Tables):
    named = tenancy.resolve_tenant(D.order_requests(t), Params(auth_mode="jwt"), None)
    return named.select("request_id", F.coalesce("tenant", F.lit("")).alias("tenant"))


GLOBAL_LIMIT, TENANT_LIMIT = 200, 2


@query(
    "t1_global_limit",
    f"""
with recursive {D.TIMED},
{D.sql_bucket("timed", "1", GLOBAL_LIMIT, "bucket")}
select request_id, admitted from bucket""",
)
def global_limit(t: Tables):
    return admission.global_limit(D.timed_requests(t), GLOBAL_LIMIT).select(
        "request_id", "admitted"
    )


@query(
    "t2_tenant_limit",
    f"""
with recursive {D.TIMED},
{D.sql_bucket("timed", "tenant", TENANT_LIMIT, "bucket")}
select request_id, bkey as tenant, admitted from bucket""",
)
def tenant_limit(t: Tables):
    return admission.tenant_limit(D.timed_requests(t), TENANT_LIMIT).select(
        "request_id", "tenant", "admitted"
    )


@query(
    "t3_admission_order",
    f"""
with recursive {D.TIMED},
checked as (
  select *, case when event_id % 200 not between 1 and 168 or 1 + event_id % 22 > 20
                 then 'INVALID_REQUEST'
                 when event_type = 'signup' then 'UNAUTHORIZED' end as early
  from timed),
open_global as (select * from checked where early is null),
{D.sql_bucket("open_global", "1", GLOBAL_LIMIT, "by_global")},
open_tenant as (select o.* from open_global o join by_global g using (request_id)
                where g.admitted),
{D.sql_bucket("open_tenant", "tenant", TENANT_LIMIT, "by_tenant")}
select c.request_id,
  case when early is not null then early
       when not g.admitted then 'GLOBAL_RATE_LIMITED'
       when not n.admitted then 'TENANT_RATE_LIMITED' else 'OK' end as outcome
from checked c left join by_global g using (request_id) left join by_tenant n using (request_id)""",
)
def admission_order(t: Tables):
    params = Params(
        auth_mode="jwt", global_per_minute=GLOBAL_LIMIT, tenant_per_minute=TENANT_LIMIT
    )
    return admission.admit(claimed_requests(t), params).select(
        "request_id", F.coalesce("outcome_code", F.lit("OK")).alias("outcome")
    )


def claimed_requests(t: Tables):
    symbol = F.struct(F.col("event_type").alias("ticker"), F.lit("event").alias("name"))
    tid = F.when(F.col("event_type") == "signup", F.lit(" ")).otherwise(F.col("tenant"))
    return D.timed_requests(t).select(
        "request_id",
        "ts",
        F.lit(None).cast("string").alias("api_key"),
        F.struct(tid.alias("tid"), F.lit("sub").alias("sub")).alias("claims"),
        F.array(symbol).alias("symbols"),
        F.pmod("event_id", F.lit(200)).cast("int").alias("lookback_hours"),
        (F.lit(1) + F.pmod("event_id", F.lit(22))).cast("int").alias("max_articles"),
    )
