"""Queries on scoring, answers, escalation, exhaustion and assembled results."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodwire.functions.labels import DEFAULT_LABELS, score_logits, softmax
from moodwire.operators import answers as A
from moodwire.operators import resolve as R
from moodwire.operators import scoring as S
from moodwire.operators.validation import request_symbols
from moodwire.params import ANSWER_PROVIDERS, Params, failover_order
from moodwire.plans import analyze as P
from moodwire.schemas import RESULT_COLUMNS
from moodwire.session import cut_lineage
from moodwire.sources import sinks
from workload import adapters as D
from workload import news as N
from workload.registry import Tables, query

# ------------------------------------------------------------------------------ scoring


def noted_documents(t: Tables):
    """Whole documents as news text; the raw text never says ``bear``, so some get a note."""
    note = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("Bear note ")).otherwise(F.lit(""))
    return t.documents.select(
        F.col("doc_id").alias("key"), F.concat(note, F.col("text")).alias("text")
    )


@query(
    "i1_keyword_scorer",
    """
with noted as (select doc_id as key,
  case when doc_id % 7 = 0 then 'Bear note ' else '' end || text as text from documents)
select key, case when contains(lower(text), 'bear') then -0.5::double else 0.0::double end
  as sentiment_score,
  case when contains(lower(text), 'bear') then 'bearish' else 'neutral' end as label,
  0.5::double as confidence from noted""",
)
def keyword_scorer(t: Tables):
    return S.keyword_scorer(noted_documents(t)).drop("text")


LOGITS = """
whole as (
  select vec_id, list_transform([0, 1, 2], lambda j: 10 * list_sum(list_transform(
    range(len(embedding)), lambda i: case when i % 3 = j then embedding[i + 1]::double else 0 end)))
    as z from embeddings),
tied as (
  select vec_id, case when vec_id % 10 = 0 then [z[1], z[2], z[2]] else z end as z from whole),
shifted as (select vec_id, list_transform(z, lambda v: exp(v - list_max(z))) as e from tied),
probs as (select vec_id, list_transform(e, lambda v: v / list_sum(e)) as p from shifted),
scored as (
  select vec_id, p[1] - p[2] as score, list_max(p) as confidence,
    case when p[3] = list_max(p) then 'neutral' when p[2] = list_max(p) then 'bearish'
         else 'bullish' end as label from probs)
"""


def class_logits(t: Tables):
    """Three logits from the whole embedding: sums over every third element."""

    def total(j: int):
        own = F.transform(
            "embedding",
            lambda v, i: F.when(i % 3 == j, v.cast("double")).otherwise(F.lit(0.0)),
        )
        return F.lit(10.0) * F.aggregate(own, F.lit(0.0), lambda acc, v: acc + v)

    sums = t.embeddings.select("vec_id", *[total(j).alias(f"z{j}") for j in range(3)])
    third = F.when(F.pmod("vec_id", F.lit(10)) == 0, F.col("z1")).otherwise(F.col("z2"))
    return sums.select("vec_id", F.array("z0", "z1", third).alias("logits"))


@query(
    "i3_logits_score",
    f"""
with {LOGITS}
select vec_id, round(score, 6) + 0.0 as sentiment_score, round(confidence, 6) as confidence, label
from scored""",
)
def logits_score(t: Tables):
    scored = S.logits_scorer(DEFAULT_LABELS)(class_logits(t))
    return scored.select(
        "vec_id",
        (F.round("sentiment_score", 6) + F.lit(0.0)).alias("sentiment_score"),
        F.round("confidence", 6).alias("confidence"),
        "label",
    )


@query(
    "f8_softmax_whole_vector",
    """
with shifted as (
  select vec_id, embedding, list_transform(embedding,
    lambda v: exp(v::double - list_max(embedding)::double)) as e from embeddings),
probs as (select vec_id, list_transform(e, lambda v: v / list_sum(e)) as p from shifted)
select vec_id, round(list_max(p), 6) as confidence, round(p[1] - p[2], 6) + 0.0 as sentiment_score,
  case list_position(p, list_max(p)) when 1 then 'bullish' when 2 then 'bearish' else 'neutral' end
    as label,
  round(list_sum(list_transform(p, lambda v: v * v)), 6) as squares
from probs""",
)
def softmax_whole_vector(t: Tables):
    """All 64 elements as logits: most classes lie beyond the label list and count as neutral."""
    labels = F.array(*[F.lit(x) for x in DEFAULT_LABELS])
    logits = F.transform("embedding", lambda v: v.cast("double"))
    squares = F.aggregate(softmax(F.col("logits")), F.lit(0.0), lambda acc, v: acc + v * v)
    return (
        t.embeddings.select("vec_id", logits.alias("logits"))
        .select("vec_id", score_logits(F.col("logits"), labels).alias("s"), squares.alias("q"))
        .select(
            "vec_id",
            F.round("s.confidence", 6).alias("confidence"),
            (F.round("s.sentiment_score", 6) + F.lit(0.0)).alias("sentiment_score"),
            "s.label",
            F.round("q", 6).alias("squares"),
        )
    )


@query(
    "i4_label_lists",
    f"""
with {LOGITS}
select label, count(*) as n, round(sum(confidence), 6) as confidence from scored group by label""",
)
def label_lists(t: Tables):
    scored = S.logits_scorer(S.load_labels(None))(class_logits(t))
    return scored.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence")
    )


@query(
    "i2_model_scorer",
    """
with counted as (
  select doc_id, len(text) - len(replace(text, 'e', '')) as e,
    len(text) - len(replace(text, 'a', '')) as a, len(text) - len(replace(text, 'o', '')) as o
  from documents)
select doc_id, case when o >= greatest(a, e) then 'neutral' when a >= e then 'bearish'
  else 'bullish' end as label from counted""",
)
def model_scorer(t: Tables):
    """Classifier path with a stand-in model: letter counts as logits."""
    rows = t.documents.select("doc_id", "text")
    return S.model_scorer(letter_model, DEFAULT_LABELS)(rows).select("doc_id", "label")


def letter_model():
    def logits(texts: list[str]) -> list[list[float]]:
        return [[float(x.count(c)) for c in "eao"] for x in texts]

    return logits


@query(
    "i5_drift",
    """
with pairs as (
  select case when quality = 1 then 'neutral' else 'bearish' end as expected,
    case when doc_id % 7 = 0 then 'bearish' else 'neutral' end as predicted
  from labels join documents using (doc_id)),
cells as (select expected, predicted, count(*) as n from pairs group by all)
select expected, predicted, n,
  round(sum(case when expected = predicted then n else 0 end) over (partition by expected)
    / sum(n) over (partition by expected), 6) as class_accuracy from cells""",
)
def drift(t: Tables):
    predicted = S.keyword_scorer(noted_documents(t)).select("key", "label")
    expected = t.labels.select(
        F.col("doc_id").alias("key"),
        F.when(F.col("quality") == 1, "neutral").otherwise("bearish").alias("label"),
    )
    return S.drift(predicted, expected).withColumn(
        "class_accuracy", F.round("class_accuracy", 6)
    )


# ------------------------------------------------------------------------------ local results


def local_sentiment(t: Tables):
    requests = N.landed_requests(t)
    return P.local_sentiment(request_symbols(requests), D.news_payloads(requests), D.NEWS_PARAMS)


LOCAL = f"""
{D.NEWS},
local as (
  select request_id, okey, idx, ticker as symbol,
    case when contains(lower(text), 'bear') then -0.5::double else 0.0::double end as score,
    case when contains(lower(text), 'bear') then 'bearish' else 'neutral' end as label,
    article_count from titled where article_count > 0)
"""


@query(
    "r1_local_results",
    f"""
with {LOCAL}
select request_id, idx::int as idx, symbol, score as sentiment_score, label,
  0.5::double as confidence, 'tier_1_local_onnx' as source_tier, 'batch_news' as news_provider,
  article_count::int as article_count, '' as reasoning from local""",
)
def local_results(t: Tables):
    return local_sentiment(t).withColumn("reasoning", F.coalesce("reasoning", F.lit("")))


@query(
    "s8_result_json",
    f"""
with {LOCAL}
select request_id, idx::int as idx,
  '{{"symbol":"' || symbol || '","sentiment_score":' || case when score < 0 then '-0.5' else '0.0' end
  || ',"label":"' || label || '","confidence":0.5,"source_tier":"tier_1_local_onnx",'
  || '"news_provider":"batch_news","article_count":' || article_count || ',"reasoning":null}}' as body
from local""",
)
def result_json(t: Tables):
    return local_sentiment(t).select("request_id", "idx", sinks.result_json().alias("body"))


@query(
    "s9_responses",
    f"""
with {LOCAL}
select request_id, count(*)::int as n,
  string_agg(symbol || ':' || label || ':' || article_count, ',' order by idx) as results
from local group by request_id""",
)
def responses(t: Tables):
    listed = sinks.to_responses(local_sentiment(t))
    shown = F.transform(
        "results",
        lambda r: F.concat_ws(":", r["symbol"], r["label"], r["article_count"].cast("string")),
    )
    return listed.select(
        "request_id", F.size("results").alias("n"), F.array_join(shown, ",").alias("results")
    )


@query(
    "k1_request_order",
    f"""
with {LOCAL}
select request_id, string_agg(symbol, ',' order by idx) as symbols from local group by request_id""",
)
def request_order(t: Tables):
    return sinks.to_responses(local_sentiment(t)).select(
        "request_id", F.array_join(F.col("results.symbol"), ",").alias("symbols")
    )


# ------------------------------------------------------------------------------ escalation

MODES = {
    "answers": D.NEWS_PARAMS,
    "no_answers": Params(call_budget=D.NEWS_BUDGET),
    "news_only": Params(
        call_budget=D.NEWS_BUDGET, news_only=True, answer_keys=frozenset(ANSWER_PROVIDERS)
    ),
}


def routed(t: Tables, mode: str):
    states = N.order_news(t).withColumn("scored", F.col("article_count") > 0)
    return R.route(states.drop("titles"), MODES[mode])


def _all_modes(t: Tables):
    scored = F.col("article_count") > 0
    routes = [
        F.struct(
            F.lit(mode).alias("mode"),
            R.route_of(scored, F.col("all_attempted"), F.col("budget_exhausted"), params).alias("route"),
        )
        for mode, params in MODES.items()
    ]
    return N.order_news(t).select("request_id", "idx", F.inline(F.array(*routes)))


@query(
    "l1_escalation",
    f"""
with {D.NEWS}
select mode, request_id, idx::int as idx,
  case when article_count > 0 then 'local' when mode = 'news_only' then 'unavailable'
       when mode = 'answers' and (all_attempted or budget_exhausted) then 'answer'
       else 'exhausted' end as route
from titled, (select unnest(['answers', 'no_answers', 'news_only']) as mode)""",
)
def escalation(t: Tables):
    return _all_modes(t).select("mode", "request_id", "idx", "route")


@query(
    "a5_request_rollup",
    f"""
with {D.NEWS}
select request_id, count(*) as symbols, count(*) filter (where article_count > 0) as resolved,
  count(*) filter (where article_count = 0) as missing, count(*) filter (where article_count = 0) > 0 as exhausted
from titled group by request_id""",
)
def request_rollup(t: Tables):
    return R.request_rollup(routed(t, "no_answers"))


@query(
    "r2_unavailable_fill",
    f"""
with {D.NEWS}
select request_id, idx::int as idx, ticker as symbol,
  case when article_count > 0 then 'scored' else 'unavailable' end as state,
  case when article_count > 0 then '' else
    'No usable news-backed analysis; LLM fallback disabled' end as reasoning
from titled""",
)
def unavailable_fill(t: Tables):
    states = cut_lineage(routed(t, "news_only"))  # read by the results and by the search for gaps
    local = R.local_results(S.keyword_scorer(states.filter("scored")))
    filled = R.fill_unavailable(states, local)
    return filled.select(
        "request_id",
        "idx",
        "symbol",
        F.when(F.col("source_tier") == "unavailable", "unavailable").otherwise("scored").alias(
            "state"
        ),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
    )


# ------------------------------------------------------------------------------ answers


def pending_chunks(t: Tables):
    """Chunks that are asked; cut, because answers and their symbols both start from them."""
    return cut_lineage(A.chunk(routed(t, "answers").filter(F.col("route") == "answer")))


@query(
    "w2_answer_chunks",
    f"""
with {D.ANSWERS}
select request_id, idx::int as idx, chunk from pending""",
)
def answer_chunks(t: Tables):
    return pending_chunks(t).select("request_id", "idx", "chunk")


@query(
    "a6_symbols_description",
    f"""
with {D.ANSWERS}
select request_id, chunk, count(*) as n_symbols,
  string_agg(name || ' (' || ticker || ')', ', ' order by idx) as symbols_desc
from pending group by all""",
)
def symbols_description(t: Tables):
    return A.symbols_description(pending_chunks(t))


@query(
    "l3_prompts",
    f"""
with {D.ANSWERS}
select request_id, chunk, '{A.PROMPT_HEAD}'
  || string_agg(name || ' (' || ticker || ')', ', ' order by idx) || '{A.PROMPT_TAIL}' as prompt
from pending group by all""",
)
def prompts(t: Tables):
    return A.prompts(pending_chunks(t))


def order_params(raw: str | None, primary: str, keys: set[str]) -> Params:
    return Params(answer_order=tuple(failover_order(raw, primary)), answer_keys=frozenset(keys))


@query(
    "l2_u3_failover_order",
    """
with picked as (
  select doc_id, case when toxic = 1 then ['openai', 'grok', 'deepseek']
    else ['deepseek', 'openai'] end as usable from labels)
select doc_id, list_position(usable, 'grok') - 1 as grok,
  list_position(usable, 'deepseek') - 1 as deepseek, list_position(usable, 'openai') - 1 as openai
from picked where len(usable) = 3
union all
select doc_id, -1, list_position(usable, 'deepseek') - 1, list_position(usable, 'openai') - 1
from picked where len(usable) = 2""",
)
def failover_orders(t: Tables):
    """Toxic documents use an explicit list with a repeat; the others a primary and two keys."""
    spark = t.spark
    explicit = A.order_table(
        spark, order_params("openai, grok,OPENAI,deepseek", "grok", set(ANSWER_PROVIDERS))
    )
    primary = A.order_table(spark, order_params(None, "deepseek", {"deepseek", "openai"}))
    both = explicit.withColumn("toxic", F.lit(1)).unionByName(
        primary.withColumn("toxic", F.lit(0))
    )
    wide = t.labels.join(F.broadcast(both), "toxic").groupBy("doc_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("provider") == p, F.col("ord"))), F.lit(-1))
            .alias(p)
            for p in ANSWER_PROVIDERS
        ]
    )
    return wide


def label_answers(t: Tables):
    """One answer content per labelled document, in several good and bad shapes."""
    doc = F.col("doc_id")
    item = F.format_string(
        '{"symbol":"D%d","sentiment_score":%s,"confidence":0.5,"reasoning":"q%d","label":"%s","x":1}',
        doc,
        F.when(F.col("quality") == 1, "1").otherwise("-0.25"),
        F.col("quality"),
        F.when(F.col("toxic") == 1, "negative").otherwise(" POSITIVE"),
    )
    short = F.format_string('{"symbol":"D%d","label":"bullish"}', doc)
    worded = F.format_string(
        '{"symbol":"D%d","sentiment_score":"0.1","confidence":0.5,"reasoning":"","label":"x"}', doc
    )
    digit = F.pmod(doc, F.lit(8))
    content = (
        F.when(digit == 0, F.concat(F.lit("["), item, F.lit("]")))
        .when(digit == 1, F.concat(F.lit('{"results":['), item, F.lit(","), short, F.lit("]}")))
        .when(digit == 2, F.concat(F.lit('{"result":['), item, F.lit("]}")))
        .when(digit == 3, F.concat(F.lit('{"results":['), worded, F.lit("]}")))
        .when(digit == 4, F.concat(F.lit('{"results":['), item))
        .when(digit == 5, F.lit("[]"))
        .otherwise(F.concat(F.lit('{"results":['), item, F.lit(","), item, F.lit("]}")))
    )
    return t.labels.select("doc_id", content.alias("content"))


@query(
    "l4_answer_decode",
    """
with shaped as (
  select doc_id, quality, toxic, case doc_id % 8 when 0 then 1 when 1 then -1 when 2 then -1
    when 3 then -1 when 4 then -1 when 5 then 0 else 2 end as n from labels)
select doc_id, n::int as items,
  case when n > 0 then case when quality = 1 then 1.0::double else -0.25::double end
       else 0.0::double end as first_score,
  case when n > 0 then case when toxic = 1 then 'negative' else ' POSITIVE' end else '' end
    as first_label
from shaped""",
)
def answer_decode(t: Tables):
    read = label_answers(t).select("doc_id", A.answer_items(F.col("content")).alias("items"))
    first = F.get(F.col("items"), F.lit(0))
    return read.select(
        "doc_id",
        F.coalesce(F.size("items"), F.lit(-1)).alias("items"),
        F.coalesce(first["sentiment_score"], F.lit(0.0)).alias("first_score"),
        F.coalesce(first["label"], F.lit("")).alias("first_label"),
    )


def answer_bodies(t: Tables, chunks):
    """Answers to the chunks that are really asked; no other body is made or shuffled."""
    return D.answer_bodies(N.landed_requests(t), chunks)


def answer_calls(t: Tables, chunks):
    return A.decode_answers(answer_bodies(t, chunks))


def answer_order(t: Tables):
    return A.order_table(t.spark, D.NEWS_PARAMS)


@query(
    "w5_first_success",
    f"""
with {D.ANSWERS}
select request_id, chunk, coalesce(provider, 'none') as provider from chunks""",
)
def first_success(t: Tables):
    ok, failed = A.first_success(answer_calls(t, pending_chunks(t)), answer_order(t))
    return ok.select("request_id", "chunk", "provider").unionByName(
        failed.select("request_id", "chunk", F.lit("none").alias("provider"))
    )


@query(
    "l5_failure_lists",
    f"""
with {D.ANSWERS}
select request_id, chunk, 'All configured LLM providers failed: '
  || case when okey % 3 = 0 then 'grok non-success status: 429 Too Many Requests body='
     else 'grok response parse error: LLM results must be an array of sentiment objects' end || ' | '
  || 'deepseek non-success status: 500 Internal Server Error body=' || ' | '
  || case when okey % 6 = 0 then 'openai non-success status: 502 Bad Gateway body='
     else 'openai response parse error: Invalid LLM response structure' end as error
from failed""",
)
def failure_lists(t: Tables):
    blank = F.when(F.col("http_status") == 200, F.col("body")).otherwise(F.lit(""))
    calls_made = answer_bodies(t, pending_chunks(t)).withColumn("body", blank)
    _, failed = A.first_success(A.decode_answers(calls_made), answer_order(t))
    return failed


@query(
    "j7_l6_attached_answers",
    f"""
with {D.ANSWERS}
select request_id, idx::int as idx, ticker as symbol, round(score, 6) + 0.0 as sentiment_score,
  label, 0.75::double as confidence, 'tier_3_llm' as source_tier, '' as news_provider,
  0 as article_count, 'because ' || pk as reasoning
from answered""",
)
def attached_answers(t: Tables):
    chunks = pending_chunks(t)
    ok, _ = A.first_success(answer_calls(t, chunks), answer_order(t))
    attached = A.attach_answers(A.answer_results(ok), chunks)
    return attached.select(
        "request_id",
        "idx",
        "symbol",
        (F.round("sentiment_score", 6) + F.lit(0.0)).alias("sentiment_score"),
        "label",
        "confidence",
        "source_tier",
        F.coalesce("news_provider", F.lit("")).alias("news_provider"),
        "article_count",
        "reasoning",
    )


def resolved(t: Tables):
    """(routed, local, answered, failed) of all valid order requests."""
    requests = N.landed_requests(t)
    symbols = request_symbols(requests)
    return P.resolve_misses(
        symbols,
        D.news_payloads(requests),
        D.answer_bodies(requests),
        D.NEWS_PARAMS,
    )


@query(
    "u2_r3_sent_results",
    f"""
with {D.ANSWERS},
stopped as (select distinct okey from failed)
select request_id, idx::int as idx, 'tier_1_local_onnx' as source_tier from titled
where article_count > 0 and okey not in (select okey from stopped)
union all
select request_id, idx::int, 'tier_3_llm' from answered
where okey not in (select okey from stopped)""",
)
def sent_results(t: Tables):
    routed_symbols, local, answered, failed = resolved(t)
    merged = R.merge_results(local, answered)
    return R.apply_exhaustion(merged, routed_symbols, failed).select(
        "request_id", "idx", "source_tier"
    )


@query(
    "r3_exhausted_storable",
    f"""
with {D.NEWS},
stops as (select okey, min(idx) as stop from titled where article_count = 0 group by okey)
select request_id, idx::int as idx, ticker as symbol
from titled left join stops using (okey)
where article_count > 0 and (stop is null or idx < stop)""",
)
def exhausted_storable(t: Tables):
    states = cut_lineage(routed(t, "no_answers"))  # read by the results and by the search for stops
    local = R.local_results(S.keyword_scorer(states.filter("scored")))
    nothing = local.withColumn("chunk", F.lit(0)).filter(F.lit(False))
    failed = nothing.select("request_id", "chunk")
    return R.storable_results(local, nothing, states, failed).select(
        "request_id", "idx", "symbol"
    )


@query(
    "r4_omitted_symbols",
    f"""
with {D.ANSWERS}
select request_id, count(*) as omitted_symbols
from titled where article_count = 0 and (request_id, idx) not in (
  select request_id, idx from answered) group by request_id""",
)
def omitted_symbols(t: Tables):
    routed_symbols, local, answered, _ = resolved(t)
    return R.omitted(routed_symbols, R.merge_results(local, answered))


@query(
    "m10_transitions",
    f"""
with {D.ANSWERS},
steps as (
  select 'answers' as mode, 'tier_2_news' as from_tier, 'tier_3_llm' as to_tier from pending
  union all
  select 'answers', 'tier_3_llm', 'intelligence_exhaustion' from (select distinct okey from failed)
  union all
  select 'no_answers', 'tier_2_news', 'intelligence_exhaustion'
  from (select distinct okey from pending))
select mode, from_tier, to_tier, count(*) as n from steps group by all""",
)
def transition_steps(t: Tables):
    routed_symbols, _, _, failed = resolved(t)
    with_answers = R.transitions(routed_symbols, failed).withColumn("mode", F.lit("answers"))
    without = R.transitions(
        R.route(routed_symbols, MODES["no_answers"]), failed.filter(F.lit(False))
    ).withColumn("mode", F.lit("no_answers"))
    return (
        with_answers.unionByName(without)
        .groupBy("mode", "from_tier", "to_tier")
        .agg(F.count("*").alias("n"))
    )


# ------------------------------------------------------------------------------ whole job

REUSE_DAYS = 30
ANALYZE_PARAMS = Params(
    call_budget=D.NEWS_BUDGET,
    answer_keys=frozenset(ANSWER_PROVIDERS),
    auth_mode="jwt",
    ttl_seconds=REUSE_DAYS * 86400,
    share_run=False,  # the SQL knows stored results only
)


def prior_results(t: Tables):
    """Every line shipped stands for a result of its part, computed on the ship date."""
    symbol = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    values = {
        "symbol": symbol,
        "sentiment_score": F.lit(0.5),
        "label": F.lit("bullish"),
        "confidence": F.lit(0.5),
        "source_tier": F.lit("tier_1_local_onnx"),
        "news_provider": F.lit("batch_news"),
        "article_count": F.lit(1),
        "reasoning": F.lit(None).cast("string"),
    }
    return t.lineitem.select(
        symbol.alias("cache_key"),
        F.col("l_shipdate").alias("computed_at"),
        F.struct(*[values[c].alias(c) for c in RESULT_COLUMNS]).alias("result"),
    )


def analysis(t: Tables) -> P.Analysis:
    """All order requests, good and bad, through the whole job, landed once beforehand."""
    requests = cut_lineage(D.order_requests(t, wide_bounds=True))
    return P.analyze(
        requests,
        D.news_payloads(requests),
        D.answer_bodies(requests),
        prior_results(t),
        ANALYZE_PARAMS,
    )


ANALYZED = f"""
{D.ORDER_SYMBOLS},
requests as (
  select distinct s.okey, s.request_id, o_custkey,
    epoch_us(o_orderdate) + okey % 86400 * 1000000 as t,
    case when okey in (select okey from repeated) or 1 + okey % 200 > 168 or 1 + okey % 25 > 20
           then 'INVALID_REQUEST'
         when okey % 3 = 0 or (okey % 3 = 1 and okey % 5 = 0) then 'UNAUTHORIZED' end as stopped
  from all_symbols s join orders on okey = o_orderkey),
lookups as (
  select s.okey, s.idx, upper(s.ticker) as cache_key, r.t
  from all_symbols s join requests r using (okey) where r.stopped is null),
prior as (select distinct 'P' || l_partkey as cache_key, epoch_us(l_shipdate) as t from lineitem),
looked_up as (
  select l.okey, l.idx, coalesce(p.t > l.t - {REUSE_DAYS * 86400 * 1_000_000}, false) as hit
  from lookups l asof left join prior p on l.cache_key = p.cache_key and l.t >= p.t),
missed as (
  select s.* replace (1 + s.okey % 25 as max_articles)
  from all_symbols s join looked_up u using (okey, idx) where not u.hit),
{D.STEPS.replace("from symbols)", "from missed)")},
{D.ANSWER_STEPS},
dry as (select distinct okey from failed)
"""


@query(
    "analyze_sentiment",
    f"""
with {ANALYZED},
sent as (
  select okey, idx, 'P' || pk as symbol, 0.5::double as score, 'bullish' as label, 1 as n, '' as why
  from all_symbols join looked_up using (okey, idx) where hit
  union all
  select okey, idx, ticker, case when contains(text, 'Bear') then -0.5::double else 0.0::double end,
    case when contains(text, 'Bear') then 'bearish' else 'neutral' end, article_count, ''
  from titled where article_count > 0
  union all
  select okey, idx, ticker, score, label, 0, 'because ' || pk from answered)
select 'r' || okey as request_id, idx::int as idx, symbol, round(score, 6) + 0.0 as sentiment_score,
  label, n::int as article_count, why as reasoning
from sent where okey not in (select okey from dry)""",
)
def analyze_sentiment(t: Tables):
    return analysis(t).sentiment.select(
        "request_id",
        "idx",
        "symbol",
        (F.round("sentiment_score", 6) + F.lit(0.0)).alias("sentiment_score"),
        "label",
        "article_count",
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
    )


@query(
    "analyze_rejects",
    f"""
with {ANALYZED}
select request_id, case stopped when 'INVALID_REQUEST' then 400 else 401 end as http_status,
  stopped as code, '' as retry from requests where stopped is not null
union all
select 'r' || okey, 503, 'INTELLIGENCE_EXHAUSTION', '300' from dry""",
)
def analyze_rejects(t: Tables):
    return analysis(t).rejects.select(
        "request_id",
        "http_status",
        "envelope.code",
        F.coalesce(F.col("envelope.retry_after_seconds").cast("string"), F.lit("")).alias("retry"),
    )


@query(
    "c2_stored_after_analysis",
    f"""
with {ANALYZED},
fresh as (
  select upper(ticker) as cache_key, okey, idx, 'tier_1_local_onnx' as tier from titled
  where article_count > 0
  union all
  select upper(ticker), okey, idx, 'tier_3_llm' from answered),
timed as (select f.*, r.t, r.request_id from fresh f join requests r using (okey))
select cache_key, max(t) as computed_us, arg_max(tier, row(t, request_id, idx)) as source_tier
from timed group by cache_key""",
)
def stored_after_analysis(t: Tables):
    return analysis(t).storable.select(
        "cache_key",
        F.unix_micros("computed_at").alias("computed_us"),
        F.col("result.source_tier").alias("source_tier"),
    )


# ------------------------------------------------------------------------------ reuse inside a run

RUN_TTL_S = 6 * 3600


def user_requests(t: Tables):
    """Every event asks for its user; an error event has no news to go with it."""
    symbol = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ticker"), F.lit("user").alias("name"))
    return t.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
        "ts",
        F.lit(None).cast("string").alias("api_key"),
        F.lit(None).cast("struct<tid:string,sub:string>").alias("claims"),
        F.array(symbol).alias("symbols"),
        F.lit(24).alias("lookback_hours"),
        F.lit(5).alias("max_articles"),
        "event_type",
    )


def user_news(requests):
    title = F.when(F.col("event_type") == "click", F.lit("bear note")).otherwise(F.lit("note"))
    titles = F.array_repeat(
        F.struct(title.alias("title"), F.transform("symbols", lambda s: s["ticker"]).alias("tickers")),
        F.length("event_type"),
    )
    return requests.where("event_type <> 'error'").select(
        "request_id",
        F.lit(1).alias("feed"),
        F.lit(None).cast("string").alias("ticker"),
        F.lit(200).alias("http_status"),
        F.to_json(titles).alias("body"),
    )


@query(
    "c1_run_reuse",
    f"""
with recursive seq as materialized (
  select event_id, 'u' || user_id as k, epoch_us(ts) as t, event_type,
    row_number() over (partition by user_id order by ts, event_id) as rn from events),
fold as (
  select event_id, k, rn, false as hit, event_type as kind, event_type as shown,
    case when event_type <> 'error' then t + {RUN_TTL_S * 1_000_000} else 0 end as e from seq where rn = 1
  union all
  select s.event_id, s.k, s.rn, s.t < f.e,
    case when s.t < f.e or s.event_type = 'error' then f.kind else s.event_type end,
    case when s.t < f.e then f.kind else s.event_type end,
    case when s.t < f.e or s.event_type = 'error' then f.e else s.t + {RUN_TTL_S * 1_000_000} end
  from fold f join seq s on s.k = f.k and s.rn = f.rn + 1)
select event_id, k as symbol, case when hit then 'memory' else 'miss' end as layer,
  case shown when 'error' then 'unavailable' when 'click' then 'bearish' else 'neutral' end as label,
  case shown when 'error' then 0 else length(shown) end::int as article_count from fold""",
)
def run_reuse(t: Tables):
    """One computation per key and TTL in a run without stored results; what has no news serves nobody."""
    requests = cut_lineage(user_requests(t))
    params = Params(news_only=True, ttl_seconds=RUN_TTL_S, tenant_per_minute=10**6, global_per_minute=10**6)
    nothing = prior_results(t).limit(0)
    run = P.analyze(
        requests.drop("event_type"), user_news(requests), D.answer_bodies(requests).limit(0), nothing, params
    )
    return run.sentiment.join(run.lookups, ["request_id", "idx"]).select(
        F.col("request_id").cast("bigint").alias("event_id"), "symbol", "layer", "label", "article_count"
    )
