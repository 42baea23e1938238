"""Literal cases: feeds, answers, validation, tenants, redaction, URL policy, failover."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from moodwire import params
from moodwire.functions import calls, labels, strict_json, text
from moodwire.operators import answers, attribution, envelope, scoring, security, tenancy
from moodwire.operators import validation as V
from moodwire.params import Params, failover_order
from moodwire.plans import waterfall
from moodwire.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def bodies(spark, *items, status=200):
    rows = [(str(i), 1, None, status, b) for i, b in enumerate(items)]
    return spark.createDataFrame(
        rows, "request_id string, feed int, ticker string, http_status int, body string"
    )


def asked(spark, *tickers, request="0", max_articles=5):
    rows = [(request, i, t, t, max_articles) for i, t in enumerate(tickers)]
    return spark.createDataFrame(
        rows, "request_id string, idx int, ticker string, name string, max_articles int"
    )


def titles(df):
    rows = df.orderBy("feed_rank", "pos").select("ticker", "title").collect()
    return [tuple(r) for r in rows]


# ------------------------------------------------------------------------------ feeds

def feed3_body(*items, **more):
    """A feed 3 body of (title, tickers) items."""
    listed = [{"title": t, "ticker_sentiment": [{"ticker": n} for n in names]} for t, names in items]
    return json.dumps({"feed": listed, **more})


def test_feed3_item_reaches_each_asked_symbol_once_per_name(spark):
    body = feed3_body(("\t", ["Q.A"]), ("merger", ["zz", "q.a", "Q.B"]), ("late", ["Q.B", "none"]))
    mentions = feeds.decode_feed3(bodies(spark, body), tolerant=False)
    found = attribution.attribute_folded(mentions, asked(spark, "Q.B", "Q.A", "unseen"))
    assert sorted(titles(found)) == [("Q.A", "merger"), ("Q.B", "late"), ("Q.B", "merger")]


@pytest.mark.parametrize("key", ["Note", "Information", "Error Message"])
def test_feed3_notice_hides_the_items_beside_it(spark, key):
    payloads = bodies(spark, feed3_body(("one", ["Q"]), **{key: "come back later"}), feed3_body(("two", ["Q"])))
    assert titles(feeds.decode_feed3(payloads)) == [("Q", "two")]
    assert feeds.feed3_notices(payloads).count() == 1


def test_feed3_tolerant_path_skips_item_by_item(spark):
    good = [{"title": f"g{i}", "ticker_sentiment": [{"ticker": "Q"}, {"ticker": f"R{i}"}]} for i in range(2)]
    odd = [7, None, {"title": ["x"], "ticker_sentiment": [{"ticker": "Q"}]}, {"title": "y", "ticker_sentiment": "Q"}]
    payload = bodies(spark, json.dumps({"feed": [odd[0], good[0], *odd[1:], good[1]]}))
    assert feeds.decode_feed3(payload, tolerant=False).count() == 0
    kept = titles(feeds.decode_feed3_tolerant(payload))
    assert kept == [("Q", "g0"), ("R0", "g0"), ("Q", "g1"), ("R1", "g1")]


@pytest.mark.parametrize(
    "body, typed, notice",
    [
        ('{"feed":[],"Note":null}', True, False),
        ('{"feed":{"a":1},"Note":null}', False, True),
        ('{"Information":"x"}', True, True),
        ('{"Error Message":5}', False, True),
        ("{}", True, False),
        ("[]", False, False),
        ('{"feed":[]} x', False, False),
        ('{"feed":[7]}', False, False),
    ],
)
def test_feed3_notice_rules(spark, body, typed, notice):
    row = feeds.read_feed3(bodies(spark, body)).first()
    assert (row["typed"], row["notice"]) == (typed, notice)


@pytest.mark.parametrize(
    "body",
    [
        '[{"title":42,"tickers":["X"]}]',
        '[{"title":null,"tickers":["X"]}]',
        '[{"tickers":["X"]}]',
        '[{"title":"a","tickers":{"a":1}}]',
        '[{"title":"a","tickers":["X",5]}]',
        '[{"title":"a","tickers":["X",null]}]',
        '[{"title":"a","tickers":["X"]},null]',
        '[{"title":"a","tickers":["X"]},7]',
        '[{"title":"a","tickers":["X"]}] zz',
        '[{"title":"a","tickers":["X"]}],[]',
        "[{'title':'a','tickers':['X']}]",
        '[{"title":"a","tickers":["X"],"unread":NaN}]',
        '[{"title":"a","title":"b","tickers":["X"]}]',
        '[{"title":"a","tickers":["X"]',
        '{"title":"a","tickers":["X"]}',
        "null",
        "",
        None,
    ],
)
def test_feed1_rejects_whole_payload(spark, body):
    assert feeds.decode_feed1(bodies(spark, body)).count() == 0


def test_feed1_is_case_sensitive_and_uncapped(spark):
    body = json.dumps([{"title": f"t{i}", "tickers": ["AAPL", "aapl"], "x": {}} for i in range(7)])
    mentions = feeds.decode_feed1(bodies(spark, body))
    found = attribution.attribute_exact(mentions, asked(spark, "AAPL", max_articles=2))
    assert [t for t, _ in titles(found)] == ["AAPL"] * 7


def test_feed2_and_feed4_shapes(spark):
    two = json.dumps({"data": [{"title": "a", "entities": [{"symbol": "X"}, {"symbol": "Y"}]}]})
    assert titles(feeds.decode_feed2(bodies(spark, two))) == [("X", "a"), ("Y", "a")]
    assert feeds.decode_feed2(bodies(spark, '{"data":[{"title":"a","entities":[{}]}]}')).count() == 0
    four = bodies(spark, '[{"headline":"h"},{"headline":"i"}]').withColumn("ticker", F.lit("X"))
    assert titles(feeds.decode_feed4(four)) == [("X", "h"), ("X", "i")]


# ------------------------------------------------------------------------------ answers

ITEM = {"symbol": "A", "sentiment_score": 1, "confidence": 0.5, "reasoning": "r", "label": "x"}


@pytest.mark.parametrize(
    "content, n",
    [
        ([ITEM, ITEM], 2),
        ({"results": [ITEM, {**ITEM, "label": "Negative"}]}, 2),
        ({"result": [ITEM]}, None),
        ({"results": [{"symbol": "A"}]}, None),
        ({"results": [{**ITEM, "confidence": "0.5"}]}, None),
        ({"results": {}}, None),
        ([], 0),
    ],
)
def test_answer_shapes(spark, content, n):
    items = one(spark, answers.answer_items(F.lit(json.dumps(content))))
    assert (None if items is None else len(items)) == n


def test_answer_labels(spark):
    words = ["Positive", "Negative", " NEUTRAL ", "odd"]
    got = [one(spark, labels.answer_label(F.lit(w))) for w in words]
    assert got == ["bullish", "bearish", "neutral", "neutral"]
    assert one(spark, labels.model_label(F.lit(" Odd "))) == "odd"


def test_failover_order_has_every_provider_once():
    for first in ("grok", "openai", "deepseek"):
        alone = failover_order(None, first)
        assert alone[0] == first and sorted(alone) == ["deepseek", "grok", "openai"]
    told = failover_order(" deepseek , deepseek,openai", "grok")
    assert told[:2] == ["deepseek", "openai"] and len(told) == len(set(told))
    for wrong in ("nobody", "openai,nobody"):
        with pytest.raises(ValueError):
            failover_order(wrong, "openai")


def test_chunks_of_fifteen(spark):
    symbols = asked(spark, *[f"T{i}" for i in range(31)])
    sizes = answers.chunk(symbols).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [15, 15, 1]


# ------------------------------------------------------------------------------ validation


def details(spark, symbols, lookback=24, limit=5):
    row = spark.createDataFrame(
        [("r", symbols, lookback, limit)],
        "request_id string, symbols array<struct<ticker:string,name:string>>, "
        "lookback_hours int, max_articles int",
    )
    found = V.with_details(row).first()["details"]
    return [(d["code"], d["field"]) for d in found]


def test_validation_cases(spark):
    assert details(spark, []) == [("INVALID_SYMBOL_COUNT", "symbols")]
    assert details(spark, None) == [("INVALID_SYMBOL_COUNT", "symbols")]
    assert details(spark, [("AAPL", "a"), ("aapl", "b")]) == [
        ("DUPLICATE_SYMBOL", "symbols[1].ticker")
    ]
    assert details(spark, [("AAPL", "a")], 0, 999) == [
        ("INVALID_LOOKBACK_HOURS", "lookback_hours"),
        ("INVALID_MAX_ARTICLES", "max_articles_per_symbol"),
    ]
    assert details(spark, [("é" * 16, "a")]) == [("INVALID_TICKER", "symbols[0].ticker")]
    assert details(spark, [(" AAPL ", "a")]) == []
    assert details(spark, [("　", " "), (" ", "x")]) == [
        ("INVALID_TICKER", "symbols[0].ticker"),
        ("INVALID_SYMBOL_NAME", "symbols[0].name"),
        ("INVALID_TICKER", "symbols[1].ticker"),
    ]
    assert details(spark, [("straße", "a"), ("STRASSE", "b")]) == [
        ("DUPLICATE_SYMBOL", "symbols[1].ticker")
    ]
    many = [(f"T{i}", "n") for i in range(51)]
    assert details(spark, many) == [("INVALID_SYMBOL_COUNT", "symbols")]


def test_envelope_json(spark):
    rejected = spark.createDataFrame(
        [("r", "acme", "TENANT_RATE_LIMITED", None)],
        "request_id string, tenant string, outcome_code string, "
        "details array<struct<code:string,field:string,message:string>>",
    )
    row = envelope.with_envelope(rejected).select(
        "http_status", envelope.envelope_json(F.col("envelope")).alias("body")
    ).first()
    assert row["http_status"] == 429
    assert json.loads(row["body"]) == {
        "code": "TENANT_RATE_LIMITED",
        "message": "Tenant 'acme' exceeded request budget.",
        "retry_after_seconds": 1,
        "request_id": "r",
        "details": [{"field": "tenant_id", "message": "acme"}],
    }


def test_tenants(spark):
    requests = spark.createDataFrame(
        [("1", " key-b\t"), ("2", "nope"), ("3", None), ("4", "  ")],
        "request_id string, api_key string",
    )
    pairs = params.parse_key_pairs("tenant-a:key-a, tenant-b:key-b ,late:key-b,")
    keys = spark.createDataFrame(
        [(k, t, i) for i, (t, k) in enumerate(pairs)], "api_key string, tenant string, ord int"
    )
    named = tenancy.resolve_tenant(requests, Params(auth_mode="api_key"), keys)
    got = {r["request_id"]: (r["tenant"], r["outcome_code"]) for r in named.collect()}
    assert got["1"] == ("tenant-b", None)
    assert all(got[i] == (None, "UNAUTHORIZED") for i in "234")
    open_to_all = tenancy.resolve_tenant(requests, Params(), None)
    assert {r["tenant"] for r in open_to_all.collect()} == {"anonymous"}
    odd = tenancy.resolve_tenant(requests, Params(auth_mode="odd"), None)
    assert {r["outcome_code"] for r in odd.collect()} == {"CONFIGURATION_ERROR"}
    with pytest.raises(ValueError):
        params.parse_key_pairs("tenant-only")


def test_blank_tid_does_not_fall_through(spark):
    claims = spark.createDataFrame(
        [(" ", "s"), (None, "s"), ("t", None), (None, None)], "tid string, sub string"
    )
    got = claims.select(tenancy.tenant_by_claims(F.struct("tid", "sub")).alias("v")).collect()
    assert [r["v"] for r in got] == [None, "s", "t", None]


# ------------------------------------------------------------------------------ security


@pytest.mark.parametrize(
    "url, code",
    [
        # by class of address: every default host, in any case, with the default port spelled
        *[(f"hTTps://{h.upper()}:443?q#f", None) for h in params.DEFAULT_HOSTS],
        ("https://mood.test", None),
        ("https://mood.test.", "EGRESS_HOST_DENIED"),
        ("https://x.mood.test/", "EGRESS_HOST_DENIED"),
        ("https://mood.test@elsewhere.test/", "EGRESS_HOST_DENIED"),
        ("https://u:p@x@mood.test/", None),
        ("https:mood.test/a", None),
        ("https:/\\mood.test\\a", None),
        ("https://[2001:db8::7]:443/", "EGRESS_HOST_DENIED"),
        ("https:///v1", "EGRESS_HOST_DENIED"),
        ("ftp://mood.test/", "EGRESS_SCHEME_DENIED"),
        ("data:text/plain,x", "EGRESS_SCHEME_DENIED"),
        ("https://mood.test:444/", "EGRESS_PORT_DENIED"),
        ("https://mood.test:65536/", "EGRESS_INVALID_URL"),
        ("mood.test/a", "EGRESS_INVALID_URL"),
        ("https://", "EGRESS_INVALID_URL"),
        ("https://?q", "EGRESS_INVALID_URL"),
        ("  ", "EGRESS_INVALID_URL"),
        (None, "EGRESS_INVALID_URL"),
    ],
)
def test_egress(spark, url, code):
    extra = params.parse_hosts(", Mood.Test ,")
    column = F.lit(url).cast("string")
    assert one(spark, security.egress_code(column, extra)) == code


@pytest.mark.parametrize(
    "line, masked",
    [
        (
            "u?api_token=abc&x=1&token=def api_key='ghi'",
            "u?api_token=[REDACTED]&x=1&token=[REDACTED] api_key=[REDACTED]'ghi'",
        ),
        ("Authorization: Bearer a.b.c", "Authorization: Bearer [REDACTED]"),
        ("monkey=1 s3cret Bearer x&y", "monkey=[REDACTED] [REDACTED] Bearer [REDACTED]"),
        ("Token=1 KEY=2", "Token=1 KEY=2"),
    ],
)
def test_redaction(spark, line, masked):
    secrets = security.secrets_column(["", "s3cret"])
    once = one(spark, security.redact(F.lit(line), secrets))
    assert once == masked
    assert one(spark, security.redact(F.lit(once), secrets)) == once


@pytest.mark.parametrize("many", [False, True])
def test_leak_audit_makes_each_masked_line_once(spark, many):
    """Not once per secret; texts and a column of secrets mask alike, and as the names spelled out do."""
    secrets = ["", "s1", "s12", *(f"none-{k}" for k in range(security.COMPILED_SECRETS if many else 0))]
    rng = random.Random(5)
    parts = [*security.SECRET_NAMES, "=", "==", "&", " ", "'", '"', "\n", "s1", "s12", "Bearer ", "x"]
    texts = ["".join(rng.choices(parts, k=12)) for _ in range(300)] + [None]
    lines = spark.createDataFrame([(str(k % 3), v) for k, v in enumerate(texts)], "source string, line string")

    def masked(v):
        for s in secrets[1:]:
            v = v.replace(s, security.MARKER)
        v = re.sub(f"({'|'.join(security.SECRET_NAMES)})=[^& '\"\n]*", rf"\1={security.MARKER}", v)
        return re.sub("Bearer [^ '\"\n]*", f"Bearer {security.MARKER}", v)

    want = sorted(masked(v) for v in texts if v is not None)
    redacted = security.redact_lines(lines, secrets)
    by_column = lines.select(security.redact(F.col("line"), security.secrets_column(secrets)).alias("line"))
    for found in (redacted, by_column):
        assert sorted(r.line for r in found.collect() if r.line is not None) == want
    held = sum(any(s in v for s in secrets[1:]) for v in texts if v is not None)
    assert sum(r.leaking_lines for r in security.leak_audit(lines, secrets).collect()) == held > 0
    audit = security.leak_audit(redacted, secrets)
    assert sum(r.leaking_lines for r in audit.collect()) == 0 and sum(r.lines for r in audit.collect()) == 301
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    inside = re.findall(r"exists\([^\n]*?lambdafunction\(([^\n]*)", plan)
    assert "regexp_replace" in plan and not any("regexp_replace" in x for x in inside)


# ------------------------------------------------------------------------------ small functions


def test_case_and_keys(spark):
    assert one(spark, text.ascii_upper(F.lit("aßé"))) == "Aßé"
    assert one(spark, text.ascii_lower(F.lit("AÉ"))) == "aÉ"
    plain, news = (one(spark, text.cache_key(F.lit(" aapl "), m)) for m in (False, True))
    assert (plain, news) == ("AAPL", "news_only:AAPL")


@pytest.mark.parametrize(
    "status, kind, again",
    [(429, None, False), (500, None, True), (502, None, True), (404, None, False),
     (None, "timeout", True), (None, "decode", False), (None, None, False)],
)
def test_retryable(spark, status, kind, again):
    got = one(
        spark, calls.retryable(F.lit(status).cast("int"), F.lit(kind).cast("string"))
    )
    assert got is again


def test_backoff_is_capped(spark):
    waits = [one(spark, calls.backoff_ms(F.lit(a), F.lit(80))) for a in range(6)]
    assert waits == [125, 245, 485, 900, 900, 900]


def test_ties_take_the_last_label(spark):
    names = F.array(*[F.lit(x) for x in labels.DEFAULT_LABELS])
    logits = F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(500.0))
    got = one(spark, labels.score_logits(F.slice(logits, 1, 3), names))
    assert got["label"] == "neutral"
    beyond = one(spark, labels.score_logits(logits, names))
    assert (beyond["label"], beyond["confidence"]) == ("neutral", 1.0)


def test_label_file(tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"labels": ["up", "down"]}))
    assert scoring.load_labels(str(path)) == ["up", "down"]
    assert scoring.load_labels(str(tmp_path / "none.json")) == labels.DEFAULT_LABELS
    path.write_text(json.dumps({"labels": []}))
    with pytest.raises(ValueError):
        scoring.load_labels(str(path))


def test_trailing_text_is_not_json(spark):
    assert one(spark, strict_json.parse_variant(F.lit('{"a":1} x')).isNull())
    assert one(spark, strict_json.parse_variant(F.lit('{"a":1},{"b":2}')).isNull())


REPEATS = [
    ("1 unread", 1, '[{"title":"a","u":1,"u":{"v":1,"v":2},"tickers":["Q"]}]', ["a"]),
    ("1 read", 1, '[{"title":"a","title":"b","tickers":["Q"]}]', []),
    ("1 read in one item", 1, '[{"title":"a","tickers":["Q"]},{"title":"b","tickers":["Q"],"tickers":[]}]', []),
    ("1 unread, but bad", 1, '[{"title":7,"u":1,"u":2,"tickers":["Q"]}]', []),
    ("1 cut", 1, '[{"title":"a","u":1,"u":2,"tickers":["Q"]}', []),
    ("2 unread", 2, '{"m":1,"m":2,"data":[{"title":"a","x":1,"x":1,"entities":[{"symbol":"Q","y":1,"y":2}]}]}', ["a"]),
    ("2 root", 2, '{"data":[],"data":[{"title":"a","entities":[{"symbol":"Q"}]}]}', []),
    ("2 entity", 2, '{"data":[{"title":"a","entities":[{"symbol":"Q","symbol":"Q"}]}]}', []),
    ("3 unread", 3, '{"m":1,"m":2,"feed":[{"title":"a","z":1,"z":2,"ticker_sentiment":[{"ticker":"Q"}]}]}', ["a"]),
    ("3 last title", 3, '{"feed":[{"title":"a","title":"b","ticker_sentiment":[{"ticker":"R","ticker":"Q"}]}]}', ["b"]),
    ("3 last is bad", 3, '{"feed":[{"title":"a","title":4,"ticker_sentiment":[{"ticker":"Q"}]}]}', []),
    ("3 last feed", 3, '{"feed":[],"feed":[{"title":"c","ticker_sentiment":[{"ticker":"Q"}]}]}', ["c"]),
    ("3 notice", 3, '{"m":1,"m":1,"Note":"x","feed":[{"title":"a","ticker_sentiment":[{"ticker":"Q"}]}]}', []),
    ("4 unread", 4, '[{"headline":"a","u":1,"u":2}]', ["a"]),
    ("4 read", 4, '[{"headline":"a","headline":"a"}]', []),
]


def test_repeated_keys_count_where_they_are_read(spark):
    """A typed decode refuses a repeated field of its own and ignores others; the tolerant one takes the last."""
    rows = [(name, feed, "Q" if feed == 4 else None, 200, body) for name, feed, body, _ in REPEATS]
    payloads = spark.createDataFrame(rows, "request_id string, feed int, ticker string, http_status int, body string")
    decoders = {1: feeds.decode_feed1, 2: feeds.decode_feed2, 3: feeds.decode_feed3, 4: feeds.decode_feed4}
    got = {}
    for feed, decode in decoders.items():
        for r in decode(payloads.where(F.col("feed") == feed)).where("ticker = 'Q'").collect():
            got.setdefault(r.request_id, []).append(r.title)
    assert got == {name: titles for name, _, _, titles in REPEATS if titles}
    by_waterfall = {}
    for r in waterfall.mentions(payloads).where("ticker = 'Q'").collect():
        if r.title:
            by_waterfall.setdefault(r.request_id, []).append(r.title)
    assert by_waterfall == got
    strict = feeds.decode_feed3(payloads.where("feed = 3"), tolerant=False).where("ticker = 'Q'").collect()
    assert [r.request_id for r in strict] == ["3 unread"]


def test_causes_of_answers_that_cannot_be_used(spark):
    message = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    item = {"symbol": "A", "sentiment_score": 1, "confidence": 0.5, "reasoning": "r", "label": "neutral"}
    cases = [
        ("{", answers.BODY_UNREADABLE),
        (None, answers.BODY_UNREADABLE),
        ("{}", answers.NO_CONTENT),
        (message(7), answers.NO_CONTENT),
        (message("no json"), answers.CONTENT_UNREADABLE),
        (message("[] x"), answers.CONTENT_UNREADABLE),
        (message("7"), answers.NO_RESULTS),
        (message('{"items":[]}'), answers.NO_RESULTS),
        (message('[{"symbol":"A"}]'), answers.NO_RESULTS),
        (message('{"results":null}'), answers.BAD_RESULTS),
        (message('{"results":[{"symbol":"A"}]}'), answers.BAD_RESULTS),
        (message(json.dumps([item])), None),
        (message(json.dumps({"results": [item]})), None),
    ]
    rows = [(f"r{k:02d}", 0, "grok", 200, body) for k, (body, _) in enumerate(cases)]
    found = answers.decode_answers(
        spark.createDataFrame(rows, "request_id string, chunk int, provider string, http_status int, body string")
    )
    got = [r.failure for r in found.orderBy("request_id").collect()]
    assert got == [c and f"grok response parse error: {c}" for _, c in cases]
