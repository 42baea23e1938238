"""Queries on feed payloads, attribution, lookback and the news waterfall."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodwire.operators import attribution as N
from moodwire.operators import lookback as L
from moodwire.operators.answers import chunk
from moodwire.operators.validation import request_symbols
from moodwire.plans import waterfall as W
from moodwire.session import cut_lineage
from moodwire.sources import feeds, payloads
from workload import adapters as D
from workload.registry import Tables, query


def page_payloads(t: Tables):
    status = (
        F.when(F.col("page_id") % 4 == 0, 200)
        .when(F.col("page_id") % 4 == 1, 204)
        .when(F.col("page_id") % 4 == 2, 404)
        .otherwise(503)
    )
    return t.pages.select(
        F.col("page_id").cast("string").alias("request_id"),
        (F.lit(1) + F.pmod("page_id", F.lit(3))).cast("int").alias("feed"),
        status.alias("http_status"),
        F.col("html").alias("body"),
    )


@query(
    "s1_payload_scan",
    """
with landed as (
  select page_id::varchar as request_id, (1 + page_id % 3)::int as feed, html as body,
    case page_id % 4 when 0 then 200 when 1 then 204 when 2 then 404 else 503 end as http_status
  from pages)
select request_id, feed, http_status, md5(body) as digest from landed
where http_status between 200 and 299""",
)
def payload_scan(t: Tables):
    return payloads.successful(page_payloads(t)).select(
        "request_id", "feed", "http_status", F.md5("body").alias("digest")
    )


@query(
    "s1_status_counts",
    """
select (1 + page_id % 3)::int as feed, count(*) as calls, count(*) filter (where page_id % 4 < 2) as usable
from pages group by 1""",
)
def status_counts(t: Tables):
    return payloads.status_counts(page_payloads(t))


def _usable(feed: int) -> str:
    bad = {1: "0, 1, 2", 2: "0, 1", 4: "0, 1"}[feed]
    return f"doc_id % 9 <> 0 and doc_id % 10 not in ({bad})"


def _exact_sql(feed: int) -> str:
    return f"""
with {D.LINES}
select m.doc_id::varchar as request_id, m.ticker as ticker, m.pos::int as pos, md5(m.line) as title
from line_mentions m join wanted w on m.doc_id = w.doc_id and m.ticker = w.ticker
where m.doc_id in (select doc_id from documents where {_usable(feed)})"""


def _attributed(t: Tables, feed: int):
    usable = payloads.successful(D.line_payloads(t, feed))
    decode = {1: feeds.decode_feed1, 2: feeds.decode_feed2}[feed]
    return N.attribute_exact(decode(usable), D.line_symbols(t))


def _digest(articles):
    return articles.select("request_id", "ticker", "pos", F.md5("title").alias("title"))


@query("s2_feed1_decode", _exact_sql(1))
def feed1_decode(t: Tables):
    return _digest(_attributed(t, 1))


@query("s3_feed2_decode", _exact_sql(2))
def feed2_decode(t: Tables):
    return _digest(_attributed(t, 2))


@query(
    "j1_attribute_exact",
    f"""
with {D.LINES}
select m.ticker as ticker, count(*) as articles, count(distinct m.doc_id) as requests,
  sum(strlen(m.line))::bigint as title_bytes
from line_mentions m join wanted w on m.doc_id = w.doc_id and m.ticker = w.ticker
where m.doc_id in (select doc_id from documents where {_usable(1)}) group by m.ticker""",
)
def attribute_exact(t: Tables):
    return (
        _attributed(t, 1)
        .groupBy("ticker")
        .agg(
            F.count("*").alias("articles"),
            F.countDistinct("request_id").alias("requests"),
            F.sum(F.octet_length("title")).alias("title_bytes"),
        )
    )


TITLE3 = D.sql_trim("m.line")


def _folded_sql(docs: str, cap: str = "1 + doc_id % 20") -> str:
    return f"""
with {D.LINES},
kept as (
  select m.doc_id, m.ticker, m.pos, {TITLE3} as title,
    row_number() over (partition by m.doc_id, m.ticker order by m.pos) as place
  from line_mentions m join wanted w on m.doc_id = w.doc_id and m.ticker = w.ticker
  where {TITLE3} <> '' and m.doc_id in (select doc_id from documents where {docs}))
select doc_id::varchar as request_id, ticker, count(*)::int as article_count,
  md5(string_agg(title, ' ' order by pos)) as text
from kept where place <= {cap} group by all"""


def _folded(t: Tables, decode):
    usable = payloads.successful(D.line_payloads(t, 3))
    articles = N.attribute_folded(decode(usable), D.line_symbols(t))
    capped = N.cap_per_ticker(articles, F.greatest("max_articles", F.lit(1)))
    return N.article_text(capped).select(
        "request_id", "ticker", "article_count", F.md5("text").alias("text")
    )


@query("s4_feed3_typed", _folded_sql("doc_id % 9 <> 0 and doc_id % 10 not in (0, 2, 3, 4, 6)"))
def feed3_typed(t: Tables):
    return _folded(t, lambda p: feeds.decode_feed3(p, tolerant=False))


@query("s5_feed3_tolerant", _folded_sql("doc_id % 9 <> 0 and doc_id % 10 in (2, 3)"))
def feed3_tolerant(t: Tables):
    return _folded(t, feeds.decode_feed3_tolerant)


@query("j2_attribute_folded", _folded_sql("doc_id % 9 <> 0 and doc_id % 10 not in (0, 4, 6)"))
def attribute_folded(t: Tables):
    return _folded(t, feeds.decode_feed3)


@query(
    "s6_payload_notice",
    """
select doc_id::varchar as request_id, doc_id % 10 not in (2, 3, 4, 6) as typed,
  doc_id % 10 in (0, 4, 6) as notice
from documents where doc_id % 9 <> 0""",
)
def payload_notice(t: Tables):
    usable = payloads.successful(D.line_payloads(t, 3))
    return feeds.read_feed3(usable).select("request_id", "typed", "notice")


@query(
    "s7_feed4_decode",
    f"""
with {D.LINES}
select doc_id::varchar as request_id, 'P' || (doc_id % 7) as ticker, i::int as pos, md5(line) as title
from doc_lines where i < 1 + doc_id % 20
  and doc_id in (select doc_id from documents where {_usable(4)})""",
)
def feed4_decode(t: Tables):
    usable = payloads.successful(D.line_payloads(t, 4))
    articles = N.attribute_exact(feeds.decode_feed4(usable), D.line_symbols(t))
    return _digest(articles.filter(F.col("pos") < F.col("max_articles")))


MERGED = f"""
{D.LINES},
merged as (
  select m.doc_id, m.ticker, 1 as feed, m.pos, m.line as title
  from line_mentions m join wanted w on m.doc_id = w.doc_id and m.ticker = w.ticker
  where m.doc_id in (select doc_id from documents where {_usable(1)})
  union all
  select m.doc_id, m.ticker, 2, m.pos, m.line
  from line_mentions m join wanted w on m.doc_id = w.doc_id and m.ticker = w.ticker
  where m.doc_id in (select doc_id from documents where {_usable(2)}))
"""


def merged_articles(t: Tables):
    return N.merge_articles(_attributed(t, 1), _attributed(t, 2))


@query(
    "u1_merge_articles",
    f"""
with {MERGED}
select doc_id::varchar as request_id, count(*) filter (where feed = 1) as feed1, count(*) filter (where feed = 2) as feed2
from merged group by doc_id""",
)
def merge_articles(t: Tables):
    return (
        merged_articles(t)
        .groupBy("request_id")
        .agg(
            F.count_if(F.col("feed_rank") == 1).alias("feed1"),
            F.count_if(F.col("feed_rank") == 2).alias("feed2"),
        )
    )


@query(
    "a1_a3_article_text",
    f"""
with {MERGED}
select doc_id::varchar as request_id, ticker, count(*)::int as article_count,
  md5(string_agg(title, ' ' order by feed, pos)) as text
from merged group by all""",
)
def article_text(t: Tables):
    return N.article_text(merged_articles(t)).select(
        "request_id", "ticker", "article_count", F.md5("text").alias("text")
    )


@query(
    "w1_cap_per_ticker",
    f"""
with {MERGED},
placed as (select *, row_number() over (partition by doc_id, ticker order by feed, pos) as place
           from merged)
select doc_id::varchar as request_id, ticker, feed::int as feed_rank, pos::int as pos,
  md5(title) as title
from placed where place <= 3""",
)
def cap_per_ticker(t: Tables):
    return N.cap_per_ticker(merged_articles(t), F.lit(3)).select(
        "request_id", "ticker", "feed_rank", "pos", F.md5("title").alias("title")
    )


@query(
    "j3_unresolved",
    f"""
with {MERGED}
select w.doc_id::varchar as request_id, w.ticker as ticker
from wanted w left join merged m on w.doc_id = m.doc_id and w.ticker = m.ticker
where m.doc_id is null""",
)
def unresolved(t: Tables):
    return N.unresolved(D.line_symbols(t), merged_articles(t)).select("request_id", "ticker")


@query(
    "w2_chunks",
    f"""
with {D.ORDER_SYMBOLS}
select request_id, (idx // 4)::int as chunk, count(*) as n_symbols, sum(pk)::bigint as part_sum
from symbols group by all""",
)
def chunks(t: Tables):
    symbols = request_symbols(D.valid_order_requests(t))
    return (
        chunk(symbols, 4)
        .groupBy("request_id", "chunk")
        .agg(
            F.count("*").alias("n_symbols"), F.sum(D.part_of(F.col("ticker"))).alias("part_sum")
        )
    )


def _lookback_events(t: Tables, feed: int):
    articles = t.events.select(
        F.col("event_id").alias("article_id"),
        F.col("user_id").cast("string").alias("ticker"),
        F.col("ts").alias("published"),
    )
    requests = t.events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("ticker"),
        "ts",
        (F.lit(1) + F.pmod("event_id", F.lit(168))).cast("int").alias("lookback_hours"),
        L.feed_limit(
            feed,
            (F.pmod("event_id", F.lit(3))).cast("int"),
            (F.lit(1) + F.pmod("event_id", F.lit(2))).cast("int"),
        ).alias("row_limit"),
    )
    return articles, requests


def _in_lookback_sql(feed: int) -> str:
    low = "r.ts - to_hours((1 + r.event_id % 168)::int)"
    low = {
        1: "timestamp '1970-01-01'",
        3: f"date_trunc('minute', {low})",
        4: f"date_trunc('day', {low})",
    }[feed]
    return f"""a.user_id = r.user_id and a.ts <= r.ts and a.ts >= {low}"""


def _lookback_sql(feed: int) -> str:
    return f"""
select r.event_id as request_id, count(*) as n_articles
from events r join events a on {_in_lookback_sql(feed)} group by r.event_id"""


def _lookback(t: Tables, feed: int):
    articles, requests = _lookback_events(t, feed)
    return L.in_lookback(articles, requests, feed).select("request_id", "n_articles")


@query("j8_lookback_feed1", _lookback_sql(1))
def lookback_feed1(t: Tables):
    return _lookback(t, 1)


@query("j8_lookback_feed3", _lookback_sql(3))
def lookback_feed3(t: Tables):
    return _lookback(t, 3)


@query("j8_lookback_feed4", _lookback_sql(4))
def lookback_feed4(t: Tables):
    return _lookback(t, 4)


def _limit_sql(feed: int) -> str:
    limit = {
        1: "(event_id % 3) * (1 + event_id % 2)",
        3: "least(1000, greatest(event_id % 3, 1) * (1 + event_id % 2) * 3)",
    }[feed]
    return f"""
with placed as (
  select r.event_id as request_id, a.event_id as article_id,
    row_number() over (partition by r.event_id order by a.ts desc, a.event_id desc) - 1 as pos
  from events r join events a on {_in_lookback_sql(feed)})
select request_id, article_id, pos from placed
where pos < {limit.replace('event_id', 'request_id')}"""


def _limited(t: Tables, feed: int):
    articles, requests = _lookback_events(t, feed)
    return L.batch_limit(articles, requests, feed).select("request_id", "article_id", "pos")


@query("k2_newest_first_feed1", _limit_sql(1))
def newest_first_feed1(t: Tables):
    return _limited(t, 1)


@query("k2_newest_first_feed3", _limit_sql(3))
def newest_first_feed3(t: Tables):
    return _limited(t, 3)


def landed_requests(t: Tables):
    """All valid order requests, written once for a query as a service would have landed them."""
    kept = vars(t)
    if "_landed" not in kept:
        kept["_landed"] = cut_lineage(D.valid_order_requests(t))
    return kept["_landed"]


def order_news(t: Tables):
    """Waterfall over all valid order requests."""
    requests = landed_requests(t)
    return W.waterfall(request_symbols(requests), D.news_payloads(requests), D.NEWS_PARAMS)


@query(
    "n1_waterfall",
    f"""
with {D.NEWS}
select request_id, idx::int as idx, ticker, article_count::int as article_count, md5(text) as text
from titled""",
)
def news_waterfall(t: Tables):
    return order_news(t).select(
        "request_id", "idx", "ticker", "article_count", F.md5("text").alias("text")
    )


@query(
    "n3_request_flags",
    f"""
with {D.NEWS}
select request_id, bool_and(all_attempted) as all_attempted,
  bool_or(budget_exhausted) as budget_exhausted, max(feed_calls)::int as feed_calls,
  count(*) filter (where article_count > 0) as resolved, count(*) filter (where article_count = 0) as missing
from titled group by request_id""",
)
def request_flags(t: Tables):
    return W.request_flags(order_news(t))


@query(
    "a4_resolved_counts",
    f"""
with {D.NEWS}
select okey % 7 as weekday, count(*) filter (where article_count > 0) as resolved,
  count(*) filter (where article_count = 0) as missing from titled group by 1""",
)
def resolved_counts(t: Tables):
    flags = W.request_flags(order_news(t))
    return flags.groupBy(
        F.pmod(D.order_of(F.col("request_id")), F.lit(7)).alias("weekday")
    ).agg(F.sum("resolved").alias("resolved"), F.sum("missing").alias("missing"))


@query(
    "w4_within_budget",
    f"""
with {D.ORDER_SYMBOLS},
missing as (select *, row_number() over (partition by okey order by idx) as call_no
            from symbols)
select request_id, idx::int as idx, call_no::int as call_no from missing
where call_no <= okey % 4""",
)
def within_budget(t: Tables):
    missing = request_symbols(D.valid_order_requests(t))
    remaining = F.pmod(D.order_of(F.col("request_id")), F.lit(4))
    return W.within_budget(missing, remaining).select("request_id", "idx", "call_no")


def single_payloads(t: Tables):
    """Every document's first symbol has its own call of each feed; the others have none."""
    first = F.concat(F.lit("P"), F.pmod(F.col("request_id").cast("bigint"), F.lit(7)).cast("string"))
    calls = [D.line_payloads(t, feed) for feed in (1, 2, 3, 4)]
    merged = calls[0]
    for call in calls[1:]:
        merged = merged.unionByName(call)
    failing = (F.col("feed") < F.pmod(F.col("request_id").cast("bigint"), F.lit(4)) + 1) & (
        F.col("feed") < 4
    )
    return merged.withColumn("ticker", first).withColumn(
        "http_status", F.when(failing, 500).otherwise(F.col("http_status"))
    )


@query(
    "n2_waterfall_single",
    f"""
with {D.LINES},
docs as (
  select doc_id, doc_id % 4 + 1 as first_feed, doc_id % 9 <> 0 as up, doc_id % 10 as digit,
    1 + doc_id % 20 as max_articles from documents),
own3 as (
  select m.doc_id, {TITLE3} as title, m.pos,
    row_number() over (partition by m.doc_id order by m.pos) as place
  from line_mentions m where m.ticker = 'P' || (m.doc_id % 7) and {TITLE3} <> ''),
list3 as (
  select doc_id, count(*) as n, string_agg(title, ' ' order by pos) as titles
  from own3 join docs using (doc_id) where place <= max_articles group by doc_id),
lists as (
  select doc_id, count(*) as n, string_agg(line, ' ' order by i) as titles,
    count(*) filter (where i < 1 + doc_id % 20) as n4,
    string_agg(line, ' ' order by i) filter (where i < 1 + doc_id % 20) as titles4
  from doc_lines group by doc_id),
chosen as (
  select d.*, l.n, l.titles, l.n4, l.titles4, t.n as n3, t.titles as titles3,
    case when up and first_feed <= 1 and digit not in (0, 1, 2) then 1
         when up and first_feed <= 2 and digit not in (0, 1) then 2
         when up and first_feed <= 3 and digit not in (0, 4, 6) and t.n > 0 then 3
         when up and digit not in (0, 1) then 4 else 0 end as feed
  from docs d join lists l using (doc_id) left join list3 t using (doc_id))
select doc_id::varchar as request_id, 'P' || (doc_id % 7) as ticker, feed::int as feed_rank,
  (case feed when 1 then n + case when digit = 3 then 1 else 0 end when 2 then n when 3 then n3
    when 4 then n4 else 0 end)::int as titles,
  md5(case feed when 1 then titles || case when digit = 3 then ' x' else '' end when 2 then titles
    when 3 then titles3 when 4 then titles4 else '' end) as text
from chosen
union all
select doc_id::varchar, ticker, 0, 0, md5('') from wanted where ticker <> 'P' || (doc_id % 7)""",
)
def waterfall_single(t: Tables):
    return W.waterfall_single(D.line_symbols(t), single_payloads(t)).select(
        "request_id",
        "ticker",
        F.coalesce("feed_rank", F.lit(0)).alias("feed_rank"),
        F.size("titles").alias("titles"),
        F.md5(F.array_join("titles", " ")).alias("text"),
    )
