"""Language-model answers: asking in chunks, decoding, failing over, attaching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodwire.functions import strict_json as J
from moodwire.functions.binding import let, unrolled
from moodwire.functions.calls import is_success, status_text
from moodwire.functions.labels import answer_label
from moodwire.functions.text import preview
from moodwire.params import ANSWER_CHUNK, Params
from moodwire.session import cut_lineage

# Prompt text around the list of symbols.
PROMPT_HEAD = "Analyze market sentiment for the following symbols: "
PROMPT_TAIL = (
    '. Respond ONLY with a JSON object containing a "results" array. Each item must represent one '
    'symbol and have precisely these fields: { "symbol": "ticker", "sentiment_score": float (-1.0 '
    'to 1.0), "confidence": float (0.0 to 1.0), "reasoning": "max 20 words", "label": '
    '"bullish|bearish|neutral" }. Include every requested symbol in the results array.'
)


def chunk(symbols: DataFrame, size: int = ANSWER_CHUNK) -> DataFrame:
    """Adds ``chunk``: the request's symbols in request order, ``size`` at a time.

    A valid request has at most 50 symbols, which bounds the window.
    """
    order = Window.partitionBy("request_id").orderBy("idx")
    return symbols.withColumn(
        "chunk", F.floor((F.row_number().over(order) - 1) / F.lit(size)).cast("int")
    )


def symbols_description(chunks: DataFrame) -> DataFrame:
    """``name (ticker), name (ticker)`` per chunk, in request order."""
    named = F.concat(F.col("name"), F.lit(" ("), F.col("ticker"), F.lit(")"))
    listed = chunks.groupBy("request_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("idx", named.alias("named")))).alias("listed"),
        F.count("*").alias("n_symbols"),
    )
    return listed.select(
        "request_id",
        "chunk",
        "n_symbols",
        F.array_join(F.col("listed.named"), ", ").alias("symbols_desc"),
    )


def prompts(chunks: DataFrame) -> DataFrame:
    return symbols_description(chunks).select(
        "request_id",
        "chunk",
        F.concat(F.lit(PROMPT_HEAD), F.col("symbols_desc"), F.lit(PROMPT_TAIL)).alias("prompt"),
    )


def order_table(spark: SparkSession, params: Params) -> DataFrame:
    """(provider, ord) of the providers that have a key; a handful of rows by construction."""
    usable = [p for p in params.answer_order if p in params.answer_keys]
    return spark.createDataFrame(
        [(p, i) for i, p in enumerate(usable)], "provider string, ord int"
    )


# Fixed value: how the failure of a chunk begins that no provider could be asked for.
NO_PROVIDER = "No configured LLM providers available in TP_LLM_PROVIDER_ORDER="

# Required fields of an answer item.
TEXT_FIELDS = ["symbol", "reasoning", "label"]
NUMBER_FIELDS = ["sentiment_score", "confidence"]


def answer_items(content: Column) -> Column:
    """Items of an answer: a top-level array, or the ``results`` array of an object.

    Null when the answer has neither or when any item lacks a field or has one of a wrong type.
    """
    listed = let(
        J.parse_variant(content),
        lambda root: F.coalesce(J.as_array(root), J.as_array(root, "$.results")),
    )

    def good(item: Column) -> Column:
        checks = [J.is_string(J.at(item, f"$.{f}")) for f in TEXT_FIELDS]
        checks += [J.is_number(J.at(item, f"$.{f}")) for f in NUMBER_FIELDS]
        all_good = checks[0]
        for check in checks[1:]:
            all_good = all_good & check
        return all_good

    def typed(item: Column) -> Column:
        return F.struct(
            J.text_of(J.at(item, "$.symbol")).alias("symbol"),
            J.number_of(J.at(item, "$.sentiment_score")).alias("sentiment_score"),
            J.text_of(J.at(item, "$.label")).alias("label"),
            J.number_of(J.at(item, "$.confidence")).alias("confidence"),
            J.text_of(J.at(item, "$.reasoning")).alias("reasoning"),
        )

    return let(listed, lambda items: F.when(F.forall(items, good), F.transform(items, typed)))


def message_content(body: Column) -> Column:
    """Message text inside a chat-completion body; null when the body has no such text."""
    return let(
        J.at(J.parse_variant(body), "$.choices[0].message.content"),
        lambda content: F.when(J.is_string(content), J.text_of(content)),
    )


# Why an answer with a good status could not be used, from the outside in.
BODY_UNREADABLE = "error decoding response body"
NO_CONTENT = "Invalid LLM response structure"
CONTENT_UNREADABLE = "LLM content must be valid JSON containing sentiment results"
NO_RESULTS = "LLM content must contain a results array"
BAD_RESULTS = "LLM results must be an array of sentiment objects"


def parse_cause(body: Column, content: Column) -> Column:
    """The first thing wrong with an answer without usable items; ``content`` is its message text, if it has one.

    A list that is no list of items counts as content without results, for only an object can name them.
    """
    results = J.at(J.parse_variant(content), "$.results")
    return (
        F.when(~F.coalesce(J.well_formed(body), F.lit(False)), BODY_UNREADABLE)
        .when(content.isNull(), NO_CONTENT)
        .when(~J.well_formed(content), CONTENT_UNREADABLE)
        .when(results.isNull() & J.parse_variant(content).isNotNull(), NO_RESULTS)
        .otherwise(BAD_RESULTS)
    )


def decode_answers(answers: DataFrame) -> DataFrame:
    """Adds ``items`` (null when unusable) and ``failure`` (null when usable)."""
    provider = F.col("provider")
    staged = answers.withColumn(
        "_content", F.when(is_success(F.col("http_status")), message_content(F.col("body")))
    ).withColumn("items", answer_items(F.col("_content")))
    failure = (
        F.when(
            F.col("http_status").isNull(),
            F.concat(provider, F.lit(" request error: "), F.coalesce("body", F.lit(""))),
        )
        .when(
            ~is_success(F.col("http_status")),
            F.concat(
                provider,
                F.lit(" non-success status: "),
                status_text(F.col("http_status")),
                F.lit(" body="),
                preview(F.coalesce("body", F.lit(""))),
            ),
        )
        .when(
            F.col("items").isNull(),
            F.concat(
                provider, F.lit(" response parse error: "), parse_cause(F.col("body"), F.col("_content"))
            ),
        )
    )
    return staged.withColumn("failure", failure).drop("_content")


def first_success(
    decoded: DataFrame, order: DataFrame, land: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(answered chunks with items, failed chunks with the joined failure list).

    A chunk is asked at most once per provider, so a group holds a handful of answers. ``order``
    comes from ``order_table`` and is small by construction. Where both are read, or one more than once, ``land`` them, or
    answers are parsed again each time; that runs a job.
    """
    ranked = decoded.join(F.broadcast(order), "provider")
    usable = F.col("items").isNotNull()
    best = ranked.groupBy("request_id", "chunk").agg(
        F.min_by(
            F.when(usable, F.struct("provider", "items")), F.when(usable, F.col("ord"))
        ).alias("best"),
        F.sort_array(
            F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("ord", "failure")))
        ).alias("failures"),
    )
    if land:
        best = cut_lineage(best)
    ok = best.filter(F.col("best").isNotNull()).select("request_id", "chunk", "best.*")
    failed = best.filter(F.col("best").isNull()).select(
        "request_id",
        "chunk",
        F.concat(
            F.lit("All configured LLM providers failed: "),
            F.array_join(F.col("failures.failure"), " | "),
        ).alias("error"),
    )
    return ok, failed


def answer_results(ok: DataFrame) -> DataFrame:
    """One result row per answer item, in answer order."""
    return unrolled(ok, ["request_id", "chunk"], F.col("items"), "item_pos", "i").select(
        "request_id",
        "chunk",
        "item_pos",
        F.col("i.symbol").alias("symbol"),
        F.col("i.sentiment_score").alias("sentiment_score"),
        answer_label(F.col("i.label")).alias("label"),
        F.col("i.confidence").alias("confidence"),
        F.lit("tier_3_llm").alias("source_tier"),
        F.lit(None).cast("string").alias("news_provider"),
        F.lit(0).alias("article_count"),
        F.col("i.reasoning").alias("reasoning"),
    )


def attach_answers(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answers of the chunk's own symbols; unknown symbols go, of a repeated one the last stays."""
    newest = results.groupBy("request_id", "chunk", "symbol").agg(
        F.max_by(
            F.struct(
                *[
                    c
                    for c in results.columns
                    if c not in ("request_id", "chunk", "symbol", "item_pos")
                ]
            ),
            "item_pos",
        ).alias("r")
    )
    asked = chunks.select("request_id", "chunk", F.col("ticker").alias("symbol"), "idx")
    return asked.join(newest, ["request_id", "chunk", "symbol"]).select(
        "request_id", "idx", "chunk", "symbol", "r.*"
    )
