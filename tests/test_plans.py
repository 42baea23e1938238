"""Shuffles and passes that the news queries may take, and what their short ways must leave unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodwire.functions import strict_json
from moodwire.operators import validation
from moodwire.params import Params
from moodwire.plans.waterfall import mentions, waterfall
from workload import requests  # noqa: F401
from workload.registry import QUERIES

SYMBOLS = "request_id string, idx int, ticker string, name string, max_articles int"
PAYLOADS = "request_id string, feed int, ticker string, http_status int, body string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_waterfall_shuffles_once(spark):
    symbols = spark.createDataFrame([("r", 0, "A", "a", 5)], SYMBOLS)
    payloads = spark.createDataFrame([("r", 1, None, 200, "[]")], PAYLOADS)
    assert plan_of(waterfall(symbols, payloads, Params())).count("Exchange hashpartitioning") == 1


def test_waterfall_keeps_each_asked_casing_and_takes_nothing_from_strangers(spark):
    symbols = spark.createDataFrame(
        [("r", 0, "A", "a", 5), ("r", 1, "a", "a", 5), ("r", 2, "B", "b", 5), ("q", 0, "B", "b", 5)], SYMBOLS
    )
    bodies = [
        ("r", 1, None, 200, '[{"title":"one","tickers":["a","Z"]}]'),
        ("r", 4, None, 200, '[{"headline":"no ticker"}]'),
        ("s", 1, None, 200, '[{"title":"two","tickers":["B"]}]'),
        (None, 1, None, 200, '[{"title":"three","tickers":["B"]}]'),
    ]
    found = waterfall(symbols, spark.createDataFrame(bodies, PAYLOADS), Params())
    got = {(r.request_id, r.idx): r.titles for r in found.collect()}
    assert got == {("r", 0): [], ("r", 1): ["one"], ("r", 2): [], ("q", 0): []}


def test_all_findings_take_one_pass(spark):
    assert plan_of(QUERIES["v7_split_all_findings"](spark, "/root/testdata/sf0.001")).count("FileScan parquet") == 1


def test_object_test_does_not_spell_out_the_type(spark):
    values = ["{}", '{"a":{"b":1}}', "[]", "[{}]", '"{}"', "1", "null", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    marked = rows.select(strict_json.is_object(F.parse_json("v")).alias("o"))
    assert [r.o for r in marked.collect()] == [True, True, *[False] * 6]
    assert "schemaOfVariant" not in plan_of(marked)


def test_clean_requests_are_those_without_findings(spark):
    wide = "x" * 16
    tickers = [
        [], None, ["A"], ["A", None], ["A", "B"], ["A", "a"], ["A", " a"], ["A", "A "], ["A ", "A"], [" A"], ["é"], ["é", "É"],
        ["ß", "SS"], [""], [" "], [wide], [wide + "y"], [wide + " "], ["é" * 9], [f"T{i}" for i in range(50)], [f"T{i}" for i in range(51)],
    ]
    names = ["n", "", " ", None, "n" * 120, "n" * 121, " " + "n" * 120, "ñ" * 60, "ñ" * 61]
    rows = [([{"ticker": x, "name": "n"} for x in t] if t is not None else None, 1, 1) for t in tickers]
    rows += [([{"ticker": "A", "name": n}], 1, 1) for n in names]
    rows += [([{"ticker": "A", "name": "n"}], h, a) for h in (None, 0, 1, 168, 169) for a in (None, 0, 20, 21)]
    requests = spark.createDataFrame(
        rows, "symbols array<struct<ticker:string,name:string>>, lookback_hours int, max_articles int"
    )
    symbols, hours, articles = (F.col(c) for c in requests.columns)
    by_rule = F.concat(
        validation.rule_symbol_count(symbols),
        F.coalesce(validation.symbol_details(symbols), F.array()),
        validation.rule_lookback(hours),
        validation.rule_articles(articles),
    )
    checked = validation.with_details(requests).select(
        "details", by_rule.alias("by_rule"), validation._without_findings(symbols, hours, articles).alias("clean")
    )
    got = checked.collect()
    assert len(got) == len(rows) and all(r.details == r.by_rule for r in got)
    assert all(not r.by_rule for r in got if r.clean) and sum(r.clean for r in got) > 5


def test_bodies_are_read_before_the_explode(spark):
    """An explode of an expression with lambdas is interpreted as a whole; one of a column is not."""
    payloads = spark.createDataFrame([], PAYLOADS)
    assert "Generate posexplode(pairs" in plan_of(mentions(payloads))


def test_plain_and_other_bodies_give_the_same_mentions(spark):
    title = '"a \\" b"'
    shapes = {
        1: '[{"title":%s,"tickers":["A","B"]}%s]',
        2: '{"data":[{"title":%s,"entities":[{"symbol":"A"},{"symbol":"B"}]}%s]}',
        3: '{"feed":[{"title":%s,"ticker_sentiment":[{"ticker":"A"},{"ticker":"B"}]}%s]}',
        4: '[{"headline":%s}%s]',
    }
    # In feed 3 a bad item is skipped, in the others it spoils the body; null and numbers are no titles.
    bodies, want = [], {}
    for feed, shape in shapes.items():
        one = ["A"] if feed == 4 else ["A", "B"]
        cases = {
            "plain": (shape % (title, ""), one),
            "spaced": ((shape % (title, "")).replace(":", ": "), one),
            "more": ((shape % (title, "")).replace(title, title + ',"url":1'), one),
            "number": (shape % (title, ',{"title":42,"headline":42}'), one if feed == 3 else []),
            "null": ((shape % (title, "")).replace(title, "null"), []),
            "missing": (shape % (title, ",{}"), one if feed == 3 else []),
            "trailing": (shape % (title, "") + " x", []),
            "word": ((shape % (title, "")).replace(title, '"null"'), one),
        }
        for case, (body, tickers) in cases.items():
            bodies.append((f"{case}{feed}", feed, "A" if feed == 4 else None, 200, body))
            want[f"{case}{feed}"] = tickers
    got = {request: [] for request in want}
    for m in mentions(spark.createDataFrame(bodies, PAYLOADS)).orderBy("request_id", "pos").collect():
        assert m.title == ("null" if m.request_id.startswith("word") else 'a " b')
        got[m.request_id].append(m.ticker)
    assert got == want
