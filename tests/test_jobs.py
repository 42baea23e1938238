"""Readers, writers, the store, the whole job on small requests, model scoring, late rows."""

from __future__ import annotations

import json
import math
import random
import time

from pyspark.sql import functions as F

from moodwire import schemas
from moodwire.operators import metrics, reuse, scoring
from moodwire.params import Params
from moodwire.plans.analyze import analyze, resolve_misses
from moodwire.session import cut_lineage
from moodwire.sources import payloads, sinks, store
from moodwire.streaming import jobs
from workload import ops
from workload.adapters import answer_bodies
from workload.news import landed_requests
from workload.registry import Tables
from workload.results import letter_model

REQUEST = schemas.REQUESTS
RESULT = "struct<" + schemas.SENTIMENT.replace(" string", ":string").replace(
    " double", ":double"
).replace(" int", ":int") + ">"


def requests(spark, *rows):
    """(id, tickers) rows as valid requests, one second apart."""
    data = [
        (rid, i, None, None, [(t, "name") for t in tickers], 24, 5)
        for i, (rid, tickers) in enumerate(rows)
    ]
    ddl = REQUEST.replace("ts timestamp", "s int")
    return spark.createDataFrame(data, ddl).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def feed1(spark, **titles):
    rows = [
        (rid, 1, None, 200, json.dumps([{"title": t, "tickers": [k]} for k, t in items]))
        for rid, items in titles.items()
    ]
    return spark.createDataFrame(
        rows, "request_id string, feed int, ticker string, http_status int, body string"
    )


def no_answers(spark):
    return spark.createDataFrame([], schemas.ANSWERS)


def no_prior(spark):
    return spark.createDataFrame([], f"cache_key string, computed_at timestamp, result {RESULT}")


def test_news_only_mode_fills_gaps(spark):
    run = analyze(
        requests(spark, ("r1", ["AAPL", "NONE"])),
        feed1(spark, r1=[("AAPL", "bear one"), ("AAPL", "two")]),
        no_answers(spark), no_prior(spark), Params(news_only=True),
    )
    got = {r["symbol"]: r for r in run.sentiment.collect()}
    assert got["AAPL"]["article_count"] == 2 and got["AAPL"]["label"] == "bearish"
    assert got["NONE"]["label"] == "unavailable" and got["NONE"]["confidence"] == 0.0
    assert [r["symbol"] for r in run.responses.first()["results"]] == ["AAPL", "NONE"]
    assert run.storable.select("cache_key").collect()[0][0] == "news_only:AAPL"
    assert run.rejects.count() == 0


def test_no_news_and_no_answers_is_exhaustion(spark):
    run = analyze(
        requests(spark, ("r1", ["AAPL", "NONE", "MSFT"])),
        feed1(spark, r1=[("AAPL", "x"), ("MSFT", "y")]),
        no_answers(spark), no_prior(spark), Params(),
    )
    assert run.sentiment.count() == 0
    reject = run.rejects.first()
    assert (reject["http_status"], reject["envelope"]["retry_after_seconds"]) == (503, 300)
    steps = [tuple(r) for r in run.transitions.select("from_tier", "to_tier").collect()]
    assert steps == [("tier_2_news", "intelligence_exhaustion")]
    assert [r["cache_key"] for r in run.storable.collect()] == ["AAPL"]


def test_answers_fill_missing_symbols_and_prior_is_reused(spark):
    item = {"symbol": "NONE", "sentiment_score": 0.5, "confidence": 1, "reasoning": "w", "label": "Positive"}
    body = json.dumps(
        {"choices": [{"message": {"content": json.dumps({"results": [item, {**item, "symbol": "Q"}]})}}]}
    )
    answers = spark.createDataFrame(
        [("r1", 0, "grok", 500, "down"), ("r1", 0, "openai", 200, body)], schemas.ANSWERS
    )
    prior = spark.createDataFrame(
        [("OLD", ("old", 0.1, "neutral", 0.5, "tier_1_local_onnx", "batch_news", 3, None))],
        f"cache_key string, result {RESULT}",
    ).withColumn("computed_at", F.timestamp_seconds(F.lit(-10)))
    run = analyze(
        requests(spark, ("r1", ["OLD", "NONE"])), feed1(spark, r1=[]), answers, prior,
        Params(answer_keys=frozenset({"grok", "openai"})),
    )
    got = [(r["symbol"], r["source_tier"], r["label"]) for r in run.responses.first()["results"]]
    assert got == [
        ("old", "tier_1_local_onnx", "neutral"), ("NONE", "tier_3_llm", "bullish"),
    ]
    assert {r["layer"] for r in run.lookups.collect()} == {"memory", "miss"}


def test_limits_and_rejects(spark):
    run = analyze(
        requests(spark, ("r1", ["A"]), ("r2", ["A"]), ("r3", [])),
        feed1(spark, r1=[("A", "x")], r2=[("A", "x")]),
        no_answers(spark), no_prior(spark), Params(tenant_per_minute=1),
    )
    codes = {r["request_id"]: r["outcome_code"] for r in run.rejects.collect()}
    assert codes == {"r2": "TENANT_RATE_LIMITED", "r3": "INVALID_REQUEST"}
    run = analyze(
        requests(spark, ("r1", ["A"]), ("r2", ["A"])),
        feed1(spark, r1=[("A", "x")]),
        no_answers(spark), no_prior(spark), Params(global_per_minute=1),
    )
    assert [r["outcome_code"] for r in run.rejects.collect()] == ["GLOBAL_RATE_LIMITED"]


def test_answers_are_parsed_once(spark):
    """What failed and what was answered read the same landed answers."""
    item = {"symbol": "A", "sentiment_score": 0.5, "confidence": 1, "reasoning": "w", "label": "Positive"}
    body = json.dumps({"choices": [{"message": {"content": json.dumps([item])}}]})
    rows = [("r1", 0, "grok", 200, body), ("r2", 0, "grok", 500, "down")]
    asked = requests(spark, ("r1", ["A"]), ("r2", ["A"])).select(
        "request_id", F.lit(0).alias("idx"), F.lit("A").alias("ticker"), F.lit("A").alias("name"), "max_articles"
    )
    empty = feed1(spark, r1=[("B", "x")], r2=[("B", "x")])
    params = Params(answer_keys=frozenset({"grok"}), answer_order=("grok",))
    _, _, answered, failed = resolve_misses(asked, empty, spark.createDataFrame(rows, schemas.ANSWERS), params)
    assert [r.request_id for r in answered.collect()] == ["r1"] and [r.request_id for r in failed.collect()] == ["r2"]
    for part in (answered, failed):
        assert "min_by" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_a_cut_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    cut = cut_lineage(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and cut.count() == 7


def test_store_and_sinks(spark, tmp_path):
    results = spark.createDataFrame(
        [("r1", 0, "K", "a", 0.5, "x", 0.5, "tier_1_local_onnx", "batch_news", 1, None, 5),
         ("r2", 0, "K", "b", 0.5, "x", 0.5, "tier_3_llm", None, 0, "w", 9),
         ("r3", 0, "K", "c", 0.0, "x", 0.0, "unavailable", None, 0, "w", 11)],
        f"request_id string, idx int, cache_key string, {schemas.SENTIMENT}, s int",
    ).withColumn("computed_at", F.timestamp_seconds("s")).drop("s")
    reuse.store(results, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store")).collect()
    assert [r["result"]["symbol"] for r in stored] == ["b"]
    sinks.write_sentiment(results, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert dict(back.dtypes)["sentiment_score"] == "float" and "day" in back.columns
    sinks.write_sentiment_json(results, str(tmp_path / "json"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert all(list(x) == schemas.RESULT_COLUMNS for x in lines)
    log = spark.createDataFrame([("r1", 450)], "request_id string, duration_ms long")
    timed = sinks.with_execution_time(sinks.to_responses(results), log)
    body = json.loads(sinks.response_json(timed.filter("request_id = 'r1'")).first()["body"])
    assert body["execution_time_ms"] == 450 and body["results"][0]["reasoning"] is None


def test_readers_keep_only_successful_payloads(spark, tmp_path):
    rows = [("r1", 1, None, "c1", 200, "[]", None), ("r1", 2, None, "c2", 500, "oops", None)]
    landed = spark.createDataFrame(rows, schemas.PAYLOADS)
    landed.write.parquet(str(tmp_path / "p"))
    landed.write.json(str(tmp_path / "j"))
    assert payloads.read_payloads(spark, str(tmp_path / "p")).count() == 1
    assert payloads.read_payloads(spark, str(tmp_path / "j"), "json").count() == 1
    stream = payloads.stream_payloads(spark, str(tmp_path / "p"))
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_model_scores_each_text_once(spark):
    rows = spark.createDataFrame(
        [(i, "ee a" if i % 2 else "aaa e") for i in range(10)], "k int, text string"
    )
    got = scoring.model_scorer(letter_model, ["bullish", "bearish", "neutral"])(rows).collect()
    assert {(r["k"] % 2, r["label"]) for r in got} == {(1, "bullish"), (0, "bearish")}
    assert len(got) == 10


def test_metrics_without_rows_are_zero(spark):
    empty_log = spark.createDataFrame(
        [], "request_id string, ts timestamp, duration_ms long, exhausted boolean"
    )
    lookups = spark.createDataFrame([], "layer string")
    totals = metrics.request_totals(empty_log).first()
    assert (totals["requests"], totals["exhaustion_rate"]) == (0, 0.0)
    assert metrics.lookup_totals(lookups).first()["hit_ratio"] == 0.0
    quantiles = metrics.duration_quantiles(empty_log).first()
    assert (quantiles["samples"], quantiles["p50"], quantiles["p99"]) == (0, 0.0, 0.0)


def test_window_quantiles_cover_every_row_of_a_window(spark, tmp_path):
    """A day of 6,000 rows, more than the newest 4,096, and a day without durations."""
    n = 6000
    rows = [(k, k * 10, 1, "click", (k * 7919 % n) / 10.0) for k in range(n)] + [(n, 86400, 1, "click", None)]
    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    frame.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.window_us: tuple(r)[1:] for r in ops.window_quantiles(Tables(spark, str(tmp_path))).collect()}
    ms = sorted(math.floor(row[4] * 10) for row in rows[:n])
    want = [float(ms[int((n - 1) * q + 0.5)]) for q in (0.5, 0.95, 0.99)]
    assert got == {0: (n, *want), 86_400_000_000: (0, 0.0, 0.0, 0.0)}


def test_late_rows_are_dropped(spark, tmp_path):
    def land(name, rows):
        df = spark.createDataFrame(rows, "request_id string, k string, s int")
        df.select("request_id", "k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(
            str(tmp_path / "in" / name)
        )

    def drain():
        stream = (
            spark.readStream.schema("request_id string, k string, ts timestamp")
            .option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in"))
        )
        admitted = jobs.stream_limit(stream, F.col("k"), 1)
        jobs.run_available(admitted, str(tmp_path / "out"), str(tmp_path / "state"))
        return {r["request_id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    land("b1", [("1", "A", 1000), ("2", "A", 1010), ("3", "A", 1061)])
    assert drain() == {}  # the watermark has passed no stretch of a minute yet
    land("b2", [("4", "A", 1100), ("5", "A", 2000)])
    assert drain() == {"1": True, "2": False, "3": True, "4": False}
    land("b3", [("6", "A", 1500), ("7", "A", 2030), ("8", "A", 2060), (None, None, 9000)])
    assert drain() == {
        "1": True, "2": False, "3": True, "4": False, "5": True, "7": False, "8": True,
    }


def test_requests_of_a_run_share_results(spark):
    run = analyze(
        requests(spark, ("r1", ["AAPL"]), ("r2", ["aapl"])),
        feed1(spark, r1=[("AAPL", "bear")], r2=[("aapl", "other"), ("aapl", "news")]),
        no_answers(spark), no_prior(spark), Params(news_only=True),
    )
    got = {r["request_id"]: (r["symbol"], r["label"], r["article_count"]) for r in run.sentiment.collect()}
    assert got == {"r1": ("AAPL", "bearish", 1), "r2": ("AAPL", "bearish", 1)}
    assert {r["request_id"]: r["layer"] for r in run.lookups.collect()} == {"r1": "miss", "r2": "memory"}


def one_after_another(rows, news, ttl):
    """Plain service loop: reuse what is live, score what has news, stop at the first symbol without."""
    store, sent, layers = {}, {}, {}
    for i, (rid, tickers) in enumerate(rows):
        live = {t for t in tickers if t in store and i - ttl < store[t][0] <= i}
        layers |= {(rid, k): "memory" if t in live else "miss" for k, t in enumerate(tickers)}
        results = {t: store[t][1] for t in live}
        for t in tickers:
            if t in live:
                continue
            if t not in news[rid]:
                results = None  # nothing left to ask: the whole request is withheld
                break
            store[t] = (i, f"{rid}:{t}")
            results[t] = store[t][1]
        if results is not None:
            sent |= {(rid, k): results[t] for k, t in enumerate(tickers)}
    return sent, layers


def test_sharing_equals_one_request_after_another(spark):
    """Symbols without news end their request, store nothing, and leave the next request to compute."""
    rng = random.Random(11)
    rows, news = [], {}
    for k in range(60):
        tickers = rng.sample("ABCDE", rng.randint(1, 4))
        rows.append((f"r{k:02d}", tickers))
        news[f"r{k:02d}"] = {t for t in tickers if rng.random() < (0.5 if t in "AB" else 0.9)}
    payload_rows = [
        (rid, 1, None, 200, json.dumps([{"title": f"{rid} {t}", "tickers": [t]} for t in sorted(found)]))
        for rid, found in news.items()
    ]
    payloads = spark.createDataFrame(
        payload_rows, "request_id string, feed int, ticker string, http_status int, body string"
    )
    title = lambda df: df.withColumn("label", F.concat_ws(":", F.split("text", " ")[0], F.split("text", " ")[1]))
    scorer = lambda df: title(df).withColumns({"sentiment_score": F.lit(0.5), "confidence": F.lit(0.5)})
    params = Params(ttl_seconds=8, tenant_per_minute=600, feed2=False, feed3=False, feed4=False)
    run = analyze(requests(spark, *rows), payloads, no_answers(spark), no_prior(spark), params, scorer=scorer)
    sent, layers = one_after_another(rows, news, 8)
    assert {(r["request_id"], r["idx"]): r["layer"] for r in run.lookups.collect()} == layers
    assert {(r["request_id"], r["idx"]): r["label"] for r in run.sentiment.collect()} == sent
    assert "memory" in layers.values() and len({rid for rid, _ in sent}) < len(rows)


def test_store_is_compacted_and_pruned(spark, tmp_path):
    path, kind, day = str(tmp_path / "store"), "struct<n:int>", 86_400

    def add(*rows):
        frame = spark.createDataFrame(rows, "cache_key string, s double, n int")
        store.append_newest(
            frame.select("cache_key", F.timestamp_seconds("s").alias("computed_at"), F.struct("n").alias("result")), path
        )

    def held(since=None):
        return sorted((r.cache_key, r.result.n) for r in store.read(spark, path, kind, since).collect())

    add(("A", 10.0, 1), ("B", 20.0, 2), ("C", day + 5.0, 3))
    add(("A", day + 10.0, 4), ("D", 3.0 * day, 5))
    assert len(held()) == 5
    store.compact(spark, path, kind, int((3 * day + 1) * 1e6), 3 * day)
    assert held() == [("A", 4), ("B", 2), ("C", 3), ("D", 5)]
    store.compact(spark, path, kind, int((3 * day + 1) * 1e6), 2 * day)
    store.compact(spark, path, kind, int((3 * day + 1) * 1e6), 2 * day)
    assert held() == [("A", 4), ("C", 3), ("D", 5)]
    assert held(int((day + 5) * 1e6)) == [("A", 4), ("D", 5)]
    plan = store.read(spark, path, kind, int(2 * day * 1e6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    asked = spark.createDataFrame([(3.0 * day,)], "s double").select(F.timestamp_seconds("s").alias("ts"))
    prior = spark.read.parquet(path)
    assert sorted(r.result.n for r in store.recent(prior, asked, day + 10).where("cache_key is not null").collect()) == [5]
    assert store.recent(prior, asked.limit(0), 9).count() == 0


def test_requests_are_landed_once_for_a_query(spark):
    """Symbols, payloads and answers of a query start from the same files; only asked answers are made."""
    t = Tables(spark, "/root/testdata/sf0.001")
    assert landed_requests(t) is landed_requests(t)
    asked = landed_requests(t).limit(1).select("request_id", F.lit(0).alias("chunk"))
    assert answer_bodies(landed_requests(t), asked).count() == 3
