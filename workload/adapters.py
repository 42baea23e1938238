"""Driver tables → the engine's input tables, each next to the SQL that derives the same rows.

Rules use integer arithmetic only, so both sides agree, and give every branch of an operator rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodwire.functions.binding import let, unrolled
from moodwire.operators.validation import split_valid
from moodwire.params import ANSWER_CHUNK, ANSWER_PROVIDERS, Params
from workload.registry import Tables

EPOCH_2024_US = 1_704_067_200_000_000

# Unicode white space, for the trim of the SQL side.
SPACES = "||".join(
    f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)


def sql_trim(x: str) -> str:
    return f"trim({x}, {SPACES})"


SQL_ASCII_UPPER = "translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
SQL_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---------------------------------------------------------------------------------------------
# Requests whose symbols are the words of a document: long, repeated, blank and non-ASCII ones.


def word_requests(t: Tables) -> DataFrame:
    symbols = let(
        F.split("text", " "),
        lambda words: F.transform(
            words,
            lambda w, i: F.struct(
                w.alias("ticker"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("name")
            ),
        ),
    )
    return t.documents.select(
        F.col("doc_id").cast("string").alias("request_id"),
        symbols.alias("symbols"),
        F.pmod("doc_id", F.lit(200)).cast("int").alias("lookback_hours"),
        F.pmod("doc_id", F.lit(25)).cast("int").alias("max_articles"),
    )


WORDS = f"""
words as (select doc_id, unnest(string_split(text, ' ')) as w,
                 unnest(range(len(string_split(text, ' ')))) as i from documents),
word_symbols as (
  select doc_id, i, {sql_trim('w')} as ticker,
         {sql_trim("coalesce(lead(w) over (partition by doc_id order by i), '')")} as name
  from words),
word_keys as (
  select *, row_number() over (
    partition by doc_id, upper(replace(ticker, 'ß', 'SS')) order by i) as nth from word_symbols),
word_details as (
  select doc_id, 0 as part, 0 as i, 0 as rule, 'INVALID_SYMBOL_COUNT' as code, 'symbols' as field
  from words group by doc_id having count(*) not between 1 and 50
  union all
  select doc_id, 1, i, 1, 'INVALID_TICKER', 'symbols[' || i || '].ticker'
  from word_keys where strlen(ticker) not between 1 and 16
  union all
  select doc_id, 1, i, 2, 'INVALID_SYMBOL_NAME', 'symbols[' || i || '].name'
  from word_keys where strlen(name) not between 1 and 120
  union all
  select doc_id, 1, i, 3, 'DUPLICATE_SYMBOL', 'symbols[' || i || '].ticker'
  from word_keys where ticker <> '' and nth > 1
  union all
  select doc_id, 2, 0, 4, 'INVALID_LOOKBACK_HOURS', 'lookback_hours'
  from documents where doc_id % 200 not between 1 and 168
  union all
  select doc_id, 3, 0, 5, 'INVALID_MAX_ARTICLES', 'max_articles_per_symbol'
  from documents where doc_id % 25 not between 1 and 20)
"""

# ---------------------------------------------------------------------------------------------
# Requests from orders: one symbol per line, whatever their number; too many are a finding.


def order_requests(t: Tables, wide_bounds: bool = False) -> DataFrame:
    lookbacks, limits = (200, 25) if wide_bounds else (168, 20)
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    parts = t.part.select("p_partkey", "p_name").hint("merge")  # small files, but a large table in the driver
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name")
    listed = named.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    symbols = F.transform(
        "lines",
        lambda x: F.struct(
            F.concat(
                F.when(x["l_linenumber"] % 2 == 0, F.lit("p")).otherwise(F.lit("P")),
                x["l_partkey"].cast("string"),
            ).alias("ticker"),
            x["p_name"].alias("name"),
        ),
    )
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").hint("merge")
    key = F.col("o_orderkey")
    return listed.join(orders, F.col("l_orderkey") == key).select(
        F.concat(F.lit("r"), key.cast("string")).alias("request_id"),
        F.timestamp_micros(
            F.unix_micros("o_orderdate") + F.pmod(key, F.lit(86400)) * 1_000_000
        ).alias("ts"),
        F.concat(
            F.lit(" key-"), (F.col("o_custkey") + F.pmod(key, F.lit(2)) * 10**9).cast("string"),
            F.lit("\t"),
        ).alias("api_key"),
        F.struct(
            F.when(key % 3 == 0, F.lit(" "))
            .when(key % 3 == 2, F.concat(F.lit("t"), F.col("o_custkey").cast("string")))
            .alias("tid"),
            F.when(key % 5 != 0, F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).alias(
                "sub"
            ),
        ).alias("claims"),
        symbols.alias("symbols"),
        (F.lit(1) + F.pmod(key, F.lit(lookbacks))).cast("int").alias("lookback_hours"),
        (F.lit(1) + F.pmod(key, F.lit(limits))).cast("int").alias("max_articles"),
    )


ORDER_SYMBOLS = """
all_symbols as (
  select l_orderkey as okey, 'r' || l_orderkey as request_id, l_partkey as pk,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, p_name) - 1 as idx,
         case when l_linenumber % 2 = 0 then 'p' else 'P' end || l_partkey as ticker,
         p_name as name, 1 + l_orderkey % 20 as max_articles
  from lineitem join part on l_partkey = p_partkey
  join orders on l_orderkey = o_orderkey),
repeated as (select distinct okey from all_symbols group by okey, upper(ticker)
             having count(*) > 1
             union select okey from all_symbols group by okey having count(*) > 50),
symbols as (select * from all_symbols where okey not in (select okey from repeated))
"""


def valid_order_requests(t: Tables) -> DataFrame:
    return split_valid(order_requests(t))[0]


def part_of(ticker: Column) -> Column:
    return F.substring(ticker, 2, 20).cast("bigint")


def order_of(request_id: Column) -> Column:
    return F.substring(request_id, 2, 20).cast("bigint")


def news_payloads(requests: DataFrame) -> DataFrame:
    """Feed bodies for order requests; each request row makes its own payloads, no shuffle."""
    numbered = F.transform(
        "symbols", lambda s: F.struct(s["ticker"].alias("ticker"), s["name"].alias("name"), part_of(s["ticker"]).alias("pk"))
    )
    staged = requests.select("request_id", order_of(F.col("request_id")).alias("okey"), numbered.alias("numbered"))
    okey = F.col("okey")

    def own(rest: int):
        return F.filter("numbered", lambda s: s["pk"] % 4 == rest)

    def cut_last(body: Column) -> Column:
        return body.substr(F.lit(1), F.length(body) - 1)

    def up(s):
        return F.struct(
            F.concat(s["name"], F.lit(" up")).alias("title"), F.array(s["ticker"], F.lit("ZZ")).alias("tickers")
        )

    def bear(s):
        return F.struct(F.concat(F.lit("Bear note "), s["name"]).alias("title"), F.array(s["ticker"]).alias("tickers"))

    items1 = F.flatten(
        F.transform(own(0), lambda s: F.when(s["pk"] % 8 == 0, F.array(up(s), bear(s))).otherwise(F.array(up(s))))
    )
    body1 = F.to_json(items1)
    body1 = (
        F.when(okey % 11 == 0, F.concat(cut_last(body1), F.lit(',{"title":42,"tickers":["P1"]}]')))
        .when(okey % 13 == 0, cut_last(body1))
        .otherwise(body1)
    )
    items2 = F.transform(
        own(1),
        lambda s: F.struct(
            F.concat(s["name"], F.lit(" steady")).alias("title"),
            F.array(F.struct(s["ticker"].alias("symbol"))).alias("entities"),
        ),
    )
    body2 = F.when(okey % 9 == 0, F.lit('{"data":{}}')).otherwise(
        F.to_json(F.struct(items2.alias("data")))
    )
    def flat(s, j: int):
        return F.struct(
            F.concat(F.lit("  "), s["name"], F.lit(f" flat {j} ")).alias("title"),
            F.array(F.struct(F.lower(s["ticker"]).alias("ticker"))).alias("ticker_sentiment"),
        )

    items3 = F.flatten(F.transform(own(2), lambda s: F.array(*[flat(s, j) for j in range(3)])))
    list3 = F.to_json(items3)
    bad3 = F.when(F.size(items3) > 0, F.lit(",")).otherwise(F.lit(""))
    body3 = (
        F.when(okey % 10 == 0, F.concat(F.lit('{"feed":'), list3, F.lit(',"Note":"limit"}')))
        .when(okey % 10 == 1, F.concat(F.lit('{"feed":'), list3, F.lit(',"Note":null}')))
        .when(
            okey % 10 == 2,
            F.concat(F.lit('{"feed":'), cut_last(list3), bad3, F.lit('{"title":42}]}')),
        )
        .otherwise(F.concat(F.lit('{"feed":'), list3, F.lit("}")))
    )

    def payload(feed: int, status: Column, body: Column) -> Column:
        return F.struct(
            F.lit(feed).alias("feed"),
            F.lit(None).cast("string").alias("ticker"),
            status.alias("http_status"),
            body.alias("body"),
            F.lit(None).cast("string").alias("name"),
        )

    batched = F.array(
        payload(1, F.when(okey % 7 == 0, 503).otherwise(200), body1),
        payload(2, F.when(okey % 8 == 0, 429).otherwise(200), body2),
        payload(3, F.lit(200), body3),
    )
    # Bodies of feed 4 are made behind the explode, where expressions without lambdas are compiled.
    single = F.transform(
        own(3),
        lambda s: F.struct(
            F.lit(4).alias("feed"),
            s["ticker"].alias("ticker"),
            F.lit(200).alias("http_status"),
            F.lit(None).cast("string").alias("body"),
            s["name"].alias("name"),
        ),
    )
    listed = staged.select("request_id", F.concat(batched, single).alias("payloads"))
    rows = unrolled(listed, ["request_id"], F.col("payloads"), "_at", "p").select("request_id", "p.*")
    headlines = F.array(*[F.struct(F.concat(F.col("name"), F.lit(f" h{j}")).alias("headline")) for j in range(3)])
    body4 = F.when(part_of(F.col("ticker")) % 8 == 7, F.lit("[]")).otherwise(F.to_json(headlines))
    body = F.when(F.col("feed") == 4, body4).otherwise(F.col("body"))
    return rows.select("request_id", "feed", "ticker", "http_status", body.alias("body"))


NEWS_BUDGET = 4
NEWS_PARAMS = Params(call_budget=NEWS_BUDGET, answer_keys=frozenset(ANSWER_PROVIDERS))

# Per symbol: titles each feed would give (n1..n4), then the steps of one request after another.
STEPS = f"""
offered as (
  select *,
    case when okey % 7 = 0 or okey % 11 = 0 or okey % 13 = 0 then 0
         when pk % 8 = 0 then 2 when pk % 4 = 0 then 1 else 0 end as n1,
    case when okey % 8 = 0 or okey % 9 = 0 then 0 when pk % 4 = 1 then 1 else 0 end as n2,
    case when okey % 10 = 0 then 0 when pk % 4 = 2 then least(3, max_articles) else 0 end as n3,
    case when pk % 4 = 3 and pk % 8 <> 7 then least(3, max_articles) else 0 end as n4
  from symbols),
after1 as (select *, count(*) filter (where n1 = 0) over (partition by okey) as m1 from offered),
after2 as (
  select *, n1 + case when m1 > 0 then n2 else 0 end as got2,
    case when m1 > 0 then 2 else 1 end as used2 from after1),
after2m as (select *, count(*) filter (where got2 = 0) over (partition by okey) as m2 from after2),
after3 as (
  select *, got2 + case when m2 > 0 then n3 else 0 end as got3,
    used2 + case when m2 > 0 then 1 else 0 end as used3 from after2m),
after3m as (
  select *, count(*) filter (where got3 = 0) over (partition by okey) as m3,
    count(*) filter (where got3 = 0) over (partition by okey order by idx) as place from after3),
news as (
  select *, {NEWS_BUDGET} - used3 as budget_left,
    m1 > 0 and got3 = 0 and place <= {NEWS_BUDGET} - used3 as served4,
    case when m1 = 0 then true
         else m2 > 0 and (m3 = 0 or {NEWS_BUDGET} - used3 >= 1) end as all_attempted,
    case when m1 = 0 then false else m3 > {NEWS_BUDGET} - used3 end as budget_exhausted,
    case when m1 = 0 then 1 else used3 + least({NEWS_BUDGET} - used3, m3) end as feed_calls
  from after3m),
titled as (
  select *, got3 + case when served4 then n4 else 0 end as article_count,
    concat_ws(' ',
      case when n1 >= 1 then name || ' up' end,
      case when n1 = 2 then 'Bear note ' || name end,
      case when m1 > 0 and n2 = 1 then name || ' steady' end,
      case when m2 > 0 and m1 > 0 and n3 >= 1 then name || ' flat 0' end,
      case when m2 > 0 and m1 > 0 and n3 >= 2 then name || ' flat 1' end,
      case when m2 > 0 and m1 > 0 and n3 >= 3 then name || ' flat 2' end,
      case when served4 and n4 >= 1 then name || ' h0' end,
      case when served4 and n4 >= 2 then name || ' h1' end,
      case when served4 and n4 >= 3 then name || ' h2' end) as text
  from news)
"""
NEWS = f"{ORDER_SYMBOLS}, {STEPS}"

# ---------------------------------------------------------------------------------------------
# Answers for the chunks that are asked: three providers with rule-made failures.


def answer_bodies(requests: DataFrame, asked_chunks: DataFrame | None = None) -> DataFrame:
    """Chat-completion bodies of all providers for every chunk a request may ask, or for ``asked_chunks`` only.

    Each answer names all symbols of the request, so it also holds some that were not asked.
    """
    chunks = F.sequence(
        F.lit(0), F.floor((F.size("symbols") - 1) / F.lit(ANSWER_CHUNK)).cast("int")
    )
    listed = unrolled(requests, ["request_id", F.col("symbols").alias("asked")], chunks, "_at", "chunk")
    if asked_chunks is not None:
        listed = listed.join(asked_chunks.select("request_id", "chunk").distinct(), ["request_id", "chunk"], "left_semi")
    okey = order_of(F.col("request_id"))

    def item(symbol: Column, score: Column, pk: Column) -> Column:
        label = (
            F.when(pk % 4 == 0, "Positive")
            .when(pk % 4 == 1, " NEGATIVE ")
            .when(pk % 4 == 2, "neutral")
            .otherwise("weird")
        )
        return F.struct(
            symbol.alias("symbol"),
            score.alias("sentiment_score"),
            F.lit(0.75).alias("confidence"),
            F.concat(F.lit("because "), pk.cast("string")).alias("reasoning"),
            label.alias("label"),
        )

    def of_symbol(a: Column) -> Column:
        pk = part_of(a["ticker"])
        score = (pk % 21 - 10).cast("double") / 10
        once = F.array(item(a["ticker"], score, pk))
        twice = F.array(item(a["ticker"], score, pk), item(a["ticker"], F.lit(0.25), pk))
        return F.when(pk % 5 == 0, F.array()).when(pk % 7 == 0, twice).otherwise(once)

    items = F.concat(
        F.flatten(F.transform("asked", of_symbol)),
        F.array(item(F.lit("ZZ"), F.lit(1.0), F.lit(4))),
    )
    base = listed.select("request_id", "chunk", okey.alias("okey"), F.to_json(items).alias("list"))

    def body(content: Column) -> Column:
        message = F.struct(F.struct(content.alias("content")).alias("message"))
        return F.to_json(F.struct(F.array(message).alias("choices")))

    wrapped = F.concat(F.lit('{"results":'), F.col("list"), F.lit("}"))
    spoiled = F.concat(F.lit('{"results":['), F.lit('{"symbol":"P1","label":"bullish"}'), F.lit("]}"))
    key = F.col("okey")
    answers = {
        "grok": (
            F.when(key % 3 == 0, 429).otherwise(200),
            body(F.when(key % 5 == 0, spoiled).otherwise(wrapped)),
        ),
        "deepseek": (F.when(key % 4 == 0, 500).otherwise(200), body(F.col("list"))),
        "openai": (
            F.when(key % 6 == 0, 502).otherwise(200),
            F.when(key % 10 == 0, F.lit('{"choices":[]}')).otherwise(body(wrapped)),
        ),
    }
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("provider"), s.alias("http_status"), b.alias("body"))
            for p, (s, b) in answers.items()
        ]
    )
    return unrolled(base, ["request_id", "chunk"], rows, "_at", "a").select(
        "request_id", "chunk", "a.*"
    )


ANSWER_STEPS = """
pending as (
  select *, ((row_number() over (partition by okey order by idx) - 1) // 15)::int as chunk
  from titled where article_count = 0),
chunks as (
  select okey, request_id, chunk,
    case when okey % 3 <> 0 and okey % 5 <> 0 then 'grok'
         when okey % 4 <> 0 then 'deepseek'
         when okey % 6 <> 0 and okey % 10 <> 0 then 'openai' end as provider
  from pending group by all),
answered as (
  select p.*, c.provider,
    case when pk % 7 = 0 then 0.25::double else (pk % 21 - 10)::double / 10 end as score,
    case when pk % 4 = 0 then 'bullish' when pk % 4 = 1 then 'bearish' else 'neutral' end as label
  from pending p join chunks c using (okey, request_id, chunk)
  where c.provider is not null and pk % 5 <> 0),
failed as (select * from chunks where provider is null)
"""
ANSWERS = f"{NEWS}, {ANSWER_STEPS}"

# ---------------------------------------------------------------------------------------------
# Feed bodies from the lines of whole documents, for the decoders.


def line_symbols(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    tickers = F.array(
        *[F.concat(F.lit("P"), F.pmod(doc + add, F.lit(7)).cast("string")) for add in (0, 2, 3)]
    )
    return t.documents.select(
        doc.cast("string").alias("request_id"),
        (F.lit(1) + F.pmod(doc, F.lit(20))).cast("int").alias("max_articles"),
        F.posexplode(tickers).alias("idx", "ticker"),
    )


def line_payloads(t: Tables, feed: int) -> DataFrame:
    """One payload per document; the last digit of the document number spoils some of them."""
    digit = F.pmod("doc_id", F.lit(10))

    def names(line: Column, i: Column) -> list[Column]:
        by_length = F.concat(F.lit("P"), (F.length(line) % 7).cast("string"))
        by_place = F.concat(F.lit("P"), (i % 5).cast("string"))
        return [by_length, by_place]

    def item(line: Column, i: Column) -> Column:
        if feed == 1:
            return F.struct(line.alias("title"), F.array(*names(line, i)).alias("tickers"))
        if feed == 2:
            entities = F.array(*[F.struct(n.alias("symbol")) for n in names(line, i)])
            return F.struct(line.alias("title"), entities.alias("entities"))
        if feed == 3:
            mentioned = F.array(*[F.struct(F.lower(n).alias("ticker")) for n in names(line, i)])
            padded = F.concat(F.lit(" \t"), line, F.lit("\n "))
            return F.struct(padded.alias("title"), mentioned.alias("ticker_sentiment"))
        return F.struct(line.alias("headline"))

    listed = F.to_json(F.transform(F.split("text", "\n"), item))
    staged = t.documents.select("doc_id", listed.alias("list"))
    items = F.col("list")
    open_list = items.substr(F.lit(1), F.length(items) - 1)

    def add(json: str) -> Column:
        return F.concat(open_list, F.lit(json + "]"))

    def feed_of(inner: Column, tail: str = "") -> Column:
        return F.concat(F.lit('{"feed":'), inner, F.lit(tail + "}"))

    if feed == 1:
        body = (
            F.when(digit == 0, add(',{"title":42,"tickers":["P1"]}'))
            .when(digit == 1, open_list)
            .when(digit == 2, F.concat(F.lit('{"items":'), items, F.lit("}")))
            .when(digit == 3, add(',{"title":"x","tickers":[],"more":{"a":[1]}}'))
            .otherwise(items)
        )
    elif feed == 2:
        data = F.concat(F.lit('{"data":'), items, F.lit("}"))
        body = (
            F.when(digit == 0, F.concat(F.lit('{"data":'), add(',{"title":"x","entities":[{}]}'), F.lit("}")))
            .when(digit == 1, F.concat(data, F.lit(" x")))
            .when(digit == 2, F.concat(F.lit('{"meta":{"found":3},"data":'), items, F.lit("}")))
            .otherwise(data)
        )
    elif feed == 3:
        body = (
            F.when(digit == 0, feed_of(items, ',"Note":"limit"'))
            .when(digit == 1, feed_of(items, ',"Note":null'))
            .when(digit == 2, feed_of(add(',{"title":42,"ticker_sentiment":[{"ticker":"P1"}]}')))
            .when(digit == 3, feed_of(add(',{"title":"x","ticker_sentiment":{"ticker":"P1"}},7')))
            .when(digit == 4, feed_of(items, ',"Information":5'))
            .when(digit == 5, feed_of(add(',{"title":"only typed"}'), ',"Error Message":null'))
            .when(digit == 6, feed_of(add(',{"title":42}'), ',"Error Message":null'))
            .otherwise(feed_of(items))
        )
    else:
        body = (
            F.when(digit == 0, add(',{"headline":42}')).when(digit == 1, open_list).otherwise(items)
        )
    first_ticker = F.concat(F.lit("P"), F.pmod("doc_id", F.lit(7)).cast("string"))
    return staged.select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.lit(feed).alias("feed"),
        F.when(F.lit(feed == 4), first_ticker).alias("ticker"),
        F.when(F.pmod("doc_id", F.lit(9)) == 0, 503).otherwise(200).alias("http_status"),
        body.alias("body"),
    )


LINES = """
doc_lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
                     unnest(range(len(string_split(text, chr(10))))) as i from documents),
line_mentions as (
  select doc_id, 2 * i as pos, line, 'P' || (length(line) % 7) as ticker from doc_lines
  union all
  select doc_id, 2 * i + 1, line, 'P' || (i % 5) from doc_lines),
wanted as (
  select distinct doc_id, unnest(['P' || (doc_id % 7), 'P' || ((doc_id + 2) % 7),
                         'P' || ((doc_id + 3) % 7)]) as ticker from documents)
"""

# ---------------------------------------------------------------------------------------------
# Event tables.


def timed_requests(t: Tables) -> DataFrame:
    """Events as requests, with time pressed together 1,200-fold so that limits bite."""
    return t.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
        F.expr(
            f"timestamp_micros({EPOCH_2024_US}L + (unix_micros(ts) - {EPOCH_2024_US}L) div 1200)"
        ).alias("ts"),
        F.col("user_id").cast("string").alias("tenant"),
        "event_id",
        "event_type",
    )


TIMED = f"""
timed as (
  select lpad(event_id::varchar, 12, '0') as request_id, event_id, event_type,
         user_id::varchar as tenant,
         {EPOCH_2024_US} + (epoch_us(ts) - {EPOCH_2024_US}) // 1200 as t
  from events)
"""


def sql_bucket(source: str, key: str, per_minute: int, name: str) -> str:
    """Recursive token bucket over ``source(request_id, t, <key>)`` in request order."""
    token = 60_000_000 // per_minute
    assert token * per_minute == 60_000_000
    slack = (per_minute - 1) * token
    return f"""
{name}_seq as materialized (
  select *, {key} as bkey, row_number() over (partition by {key} order by t, request_id) as rn
  from {source}),
{name} as (
  select request_id, bkey, rn, t + {token} as x, true as admitted from {name}_seq where rn = 1
  union all
  select s.request_id, s.bkey, s.rn,
    case when b.x <= s.t + {slack} then greatest(b.x, s.t) + {token} else b.x end,
    b.x <= s.t + {slack}
  from {name} b join {name}_seq s on s.bkey = b.bkey and s.rn = b.rn + 1)
"""


def reuse_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("cache_key"),
        F.pmod("event_id", F.lit(3)).cast("string").alias("node"),
        "ts",
    )


def request_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
        "ts",
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        (F.col("event_type") == "error").alias("exhausted"),
        "event_type",
    )


REQUEST_LOG = """
request_log as (
  select lpad(event_id::varchar, 12, '0') as request_id, ts, floor(value * 10)::bigint as duration_ms,
         event_type = 'error' as exhausted, event_type from events)
"""

STATUSES = [200, 404, 429, 500, 502]


def call_log(t: Tables) -> DataFrame:
    """Each line is a call; attempts follow until one is final or three were made."""
    line = F.col("l_linenumber")

    def outcome(k: Column) -> Column:
        return (F.col("l_partkey") + line * k + k + F.col("l_suppkey")) % 6

    def again(k: Column) -> Column:
        return outcome(k) >= 3

    attempts = F.filter(
        F.sequence(F.lit(0), F.lit(2)),
        lambda k: ((k < 1) | again(F.lit(0))) & ((k < 2) | again(F.lit(1))),
    )
    price = F.floor(F.col("l_extendedprice") * 100).cast("bigint")
    call_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price)
    seed = F.col("l_partkey") + line
    waited = F.when(F.col("attempt") == 0, F.lit(0)).otherwise(
        F.col("attempt") * 100 + F.col("l_suppkey") % 500
    )
    code = outcome(F.col("attempt"))
    status = F.lit(None).cast("int")
    for i, value in enumerate(STATUSES):
        status = F.when(code == i, F.lit(value)).otherwise(status)
    return unrolled(t.lineitem, ["*"], attempts, "_at", "attempt").select(
        call_id.alias("call_id"),
        F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string")).alias("provider"),
        "attempt",
        status.alias("status"),
        F.when(code == 5, F.lit("timeout")).alias("error_kind"),
        F.timestamp_micros(F.unix_micros("l_shipdate") + waited * 1000).alias("ts"),
        seed.alias("jitter_seed"),
    )


CALL_LOG = """
call_attempts as (
  select *, unnest([0, 1, 2]) as attempt from lineitem),
call_codes as (
  select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || floor(l_extendedprice * 100)::bigint as call_id,
         'p' || (l_suppkey % 7) as provider, attempt,
         (l_partkey + l_linenumber * attempt + attempt + l_suppkey) % 6 as code,
         (l_partkey + l_suppkey) % 6 as code0,
         (l_partkey + l_linenumber + 1 + l_suppkey) % 6 as code1,
         case when attempt = 0 then 0 else attempt * 100 + l_suppkey % 500 end as waited,
         l_partkey + l_linenumber as seed, l_shipdate as shipped
  from call_attempts),
call_log as (
  select call_id, provider, attempt,
         case code when 0 then 200 when 1 then 404 when 2 then 429 when 3 then 500
                   when 4 then 502 end as status,
         case when code = 5 then 'timeout' end as error_kind,
         waited, seed, epoch_ms(shipped) + waited as at_ms
  from call_codes
  where attempt = 0 or (code0 >= 3 and (attempt = 1 or code1 >= 3)))
"""


SECRETS = [f"s{i}" for i in range(20)]


def log_lines(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    line = F.concat(
        F.lit("GET /v1/news?symbol=P1&api_token="), key, F.lit("&token=s"), cust,
        F.lit(" auth=Bearer j."), key, F.lit("&x monkey='s"), cust, F.lit("' s"), cust,
    )
    return t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("source"), line.alias("line"),
        F.col("o_orderdate").alias("ts"),
    )


LOG_LINES = """
log_lines as (
  select o_orderkey, o_orderstatus as source, o_orderdate as ts,
    'GET /v1/news?symbol=P1&api_token=' || o_orderkey || '&token=s' || o_custkey
      || ' auth=Bearer j.' || o_orderkey || '&x monkey=''s' || o_custkey || ''' s' || o_custkey
      as line from orders)
"""


def sql_redact(line: str) -> str:
    for secret in SECRETS:
        line = f"replace({line}, '{secret}', '[REDACTED]')"
    names = "token|api_token|api_key|apikey|key|authorization|x-api-key"
    named = f"""regexp_replace({line}, '({names})=[^& ''"\\n]*', '\\1=[REDACTED]', 'g')"""
    return f"""regexp_replace({named}, 'Bearer [^ ''"\\n]*', 'Bearer [REDACTED]', 'g')"""
