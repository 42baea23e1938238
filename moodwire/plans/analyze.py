"""The whole job: requests in, one sentiment row per request and symbol out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodwire.operators import answers as A
from moodwire.operators import resolve as R
from moodwire.operators.admission import admit
from moodwire.operators.envelope import with_envelope
from moodwire.operators.reuse import newest_per_key, reuse, with_cache_key
from moodwire.operators.scoring import Scorer, keyword_scorer
from moodwire.operators.validation import request_symbols, with_details
from moodwire.params import Params
from moodwire.plans.sharing import Outcome, share_run
from moodwire.plans.waterfall import waterfall
from moodwire.session import cut_lineage
from moodwire.sources.sinks import to_responses
from moodwire.sources.store import recent


@dataclass
class Analysis:
    """What one run yields."""

    sentiment: DataFrame
    responses: DataFrame
    rejects: DataFrame
    transitions: DataFrame
    storable: DataFrame
    lookups: DataFrame


def local_sentiment(
    symbols: DataFrame, payloads: DataFrame, params: Params, scorer: Scorer = keyword_scorer
) -> DataFrame:
    """News path alone: waterfall, text, score; symbols without news are left out."""
    states = waterfall(symbols, payloads, params)
    return R.local_results(scorer(states.filter(F.col("article_count") > 0)))


def reused_results(hits: DataFrame) -> DataFrame:
    """Stored rows come back unchanged, in the casing they were stored with."""
    return hits.filter("hit").select("request_id", "idx", "reused.*")


def resolve_misses(
    misses: DataFrame,
    payloads: DataFrame,
    answers: DataFrame,
    params: Params,
    scorer: Scorer = keyword_scorer,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(routed symbols, local results, answered results, failed chunks). Runs a job.

    The routed symbols, the local results and the answers that count have several consumers each and are cut once, so
    that neither feeds nor answers are decoded nor texts scored again.
    """
    states = waterfall(misses, payloads, params)
    news = states.withColumn("scored", F.col("article_count") > 0).drop("titles")
    routed = cut_lineage(R.route(news, params))
    local = cut_lineage(R.local_results(scorer(routed.filter("scored"))))
    chunks = A.chunk(routed.filter(F.col("route") == "answer"))
    order = A.order_table(misses.sparkSession, params)
    asked = chunks.select("request_id", "chunk").distinct()
    usable = answers.join(asked, ["request_id", "chunk"], "left_semi")
    ok, errors = A.first_success(A.decode_answers(usable), order, land=True)
    # A chunk that no provider was asked for fails with a text of its own.
    unasked = F.lit(A.NO_PROVIDER + ",".join(params.answer_order))
    failed = (
        asked.join(ok, ["request_id", "chunk"], "left_anti")
        .join(errors, ["request_id", "chunk"], "left")
        .withColumn("error", F.coalesce("error", unasked))
    )
    answered = A.attach_answers(A.answer_results(ok), chunks)
    return routed, local, answered, failed


def analyze(
    requests: DataFrame,
    payloads: DataFrame,
    answers: DataFrame,
    prior: DataFrame,
    params: Params,
    keys: DataFrame | None = None,
    scorer: Scorer = keyword_scorer,
) -> Analysis:
    """Validate, admit, reuse, find news, score, ask, assemble. Runs jobs for the cuts.

    ``prior`` has cache_key, computed_at and a struct ``result`` with the result columns. With
    ``params.share_run`` a result computed in this run serves later requests of it, as stored ones do.
    """
    outcomes = cut_lineage(admit(requests, params, keys))
    decided = requests.join(outcomes.select("request_id", "tenant", "outcome_code"), "request_id")
    admitted = decided.filter(F.col("outcome_code").isNull())
    symbols = with_cache_key(request_symbols(admitted), params.news_only)
    asked = symbols.select(
        "request_id", "ts", "idx", "ticker", "name", "max_articles", "cache_key"
    )
    useful = recent(prior, outcomes.filter(F.col("outcome_code").isNull()), params.ttl_seconds)
    found = cut_lineage(reuse(asked, useful, params.ttl_seconds))

    def compute(misses: DataFrame) -> Outcome:
        # Bodies of requests that are rejected, limited or served from reuse are never parsed.
        wanted = payloads.join(misses.select("request_id").distinct(), "request_id", "left_semi")
        return Outcome(*resolve_misses(misses, wanted, answers, params, scorer))

    open_still = found.filter(~F.col("hit"))
    if params.share_run:
        shared, outcome = share_run(open_still.drop("hit", "reused"), params.ttl_seconds, compute)
        result = F.struct(*[F.col("reused")[f.name].cast(f.dataType).alias(f.name) for f in found.schema["reused"].dataType])
        shared = shared.withColumn("reused", F.when(F.col("hit"), result))
        looked_up = found.filter("hit").unionByName(shared)
    else:
        looked_up, outcome = found, compute(open_still)
    routed, local, answered, failed = outcome.parts()

    merged = R.merge_results(
        reused_results(looked_up), local, answered, R.unavailable_results(routed)
    )
    sent = R.apply_exhaustion(merged, routed, failed)
    exhausted = R.exhausted_requests(routed, failed)
    answered_requests = admitted.select("request_id").join(exhausted, "request_id", "left_anti")
    responses = answered_requests.join(to_responses(sent), "request_id", "left").withColumn(
        "results", F.coalesce("results", F.array())
    )
    stopped = with_details(decided.filter(F.col("outcome_code").isNotNull())).select(
        "request_id", "tenant", "details", "outcome_code"
    )
    ran_dry = admitted.join(exhausted, "request_id", "left_semi").select(
        "request_id",
        "tenant",
        F.array().cast(stopped.schema["details"].dataType).alias("details"),
        F.lit("INTELLIGENCE_EXHAUSTION").alias("outcome_code"),
    )
    times = looked_up.select("request_id", "idx", "cache_key", F.col("ts").alias("computed_at"))
    storable = newest_per_key(
        R.storable_results(local, answered, routed, failed).join(times, ["request_id", "idx"])
    )
    return Analysis(
        sentiment=sent,
        responses=responses,
        rejects=with_envelope(stopped.unionByName(ran_dry)),
        transitions=R.transitions(routed, failed),
        storable=storable,
        lookups=looked_up.select(
            "request_id",
            "idx",
            F.when(F.col("hit"), F.lit("memory")).otherwise(F.lit("miss")).alias("layer"),
        ),
    )
