"""Distributed folds against plain loops on random histories."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodwire.operators import admission, lookback, reuse
from moodwire.params import Params
from moodwire.plans.waterfall import request_flags, waterfall

SECOND = 1_000_000


def take_all(bucket, ticks, x):
    granted = []
    for t, n in ticks:
        got = 0
        for _ in range(n):
            if x <= t + bucket.slack:
                x, got = max(x, t) + bucket.token, got + 1
        granted.append(got)
    return granted, x


@pytest.mark.parametrize("seed", range(300))
def test_chunk_description_equals_loop_for_every_start(seed):
    rng = random.Random(seed)
    bucket = admission.Bucket(rng.choice([1, 2, 3, 5]))
    bucket.token = rng.choice([3, 5, 10])
    bucket.slack = (bucket.size - 1) * bucket.token
    t, ticks = 0, Counter()
    for _ in range(rng.randint(1, 50)):
        t += rng.randint(0, rng.choice([1, 4, 12, 60]))
        ticks[t] += 1
    ticks = sorted(ticks.items())
    triples = bucket.describe(ticks)
    for start in range(bucket.size * bucket.token + 1):
        assert bucket.apply(triples, start) == take_all(bucket, ticks, start)[1]


@pytest.mark.parametrize("seed", range(200))
def test_composed_chunks_equal_one_chunk_after_another(seed):
    rng = random.Random(seed)
    bucket = admission.Bucket(rng.choice([1, 2, 3, 5]))
    bucket.token = rng.choice([3, 5, 10])
    bucket.slack = (bucket.size - 1) * bucket.token
    width, together, chunks = rng.choice([5, 20, 60]), [], []
    for place in range(rng.randint(1, 12)):
        ticks = Counter(rng.randrange(width) for _ in range(rng.choice([0, 1, 3, 20])))
        if not ticks:
            continue
        chunks.append((place, sorted(ticks.items())))
        at = place * width
        moved = [(a, low + at, high + at) for a, low, high in bucket.describe(chunks[-1][1])]
        together = bucket.composed(together, [(0, at, admission._OPEN), *moved])
        together = [admission._small(bucket, *t) for t in together]
    for start in range(bucket.size * bucket.token + 1):
        x = start
        for place, ticks in chunks:
            x = take_all(bucket, [(place * width + t, n) for t, n in ticks], x)[1]
        assert bucket.apply(together, start) == x


def history(seed, keys, rows, span_s):
    rng = random.Random(seed)
    return [
        (f"{i:06d}", rng.choice(keys), 1_700_000_000 * SECOND + rng.randrange(span_s * SECOND))
        for i in range(rows)
    ]


def as_events(spark, rows, key):
    df = spark.createDataFrame(rows, f"request_id string, {key} string, us long")
    return df.select("request_id", key, F.timestamp_micros("us").alias("ts"))


def test_one_busy_key_is_cut_into_small_chunks(spark, monkeypatch):
    """A key with a dense minute: chunks of some rows each, composed over several levels, in any mix of outcomes."""
    monkeypatch.setattr(admission, "FAN_OUT", 4)
    rows = history(5, ["one"], 1500, 90) + history(6, ["one"], 60, 86_400)
    rows = [(f"{i:06d}", k, us) for i, (_, k, us) in enumerate(rows)]
    events = as_events(spark, rows, "k").withColumn("odd", F.col("request_id").cast("int") % 5 == 1)
    widths = []
    real = admission._chunk_descriptions
    monkeypatch.setattr(admission, "_chunk_descriptions", lambda t, b, w: widths.append((w, t)) or real(t, b, w))
    found = admission.token_bucket(events, F.col("k"), 60, ~F.col("odd"), chunk_rows=50).collect()
    width, ticks = widths[0]
    assert width <= 60 * SECOND // 10
    assert ticks.groupBy("chunk").count().agg(F.max("count")).first()[0] < 150
    bucket, x, want = admission.Bucket(60), 0, {}
    for rid, _, us in sorted(rows, key=lambda r: (r[2], r[0])):
        want[rid] = False
        if int(rid) % 5 != 1:
            n, x = bucket.take(x, us * bucket.scale, 1)
            want[rid] = n == 1
    assert {r["request_id"]: r["admitted"] for r in found} == want
    assert found[0].asDict().keys() == {"request_id", "k", "ts", "odd", "admitted"}


@pytest.mark.parametrize("per_minute, hot", [(7, 0.2), (60, 0.9), (1, 0.5), (2, 0.5)])
def test_token_bucket_equals_loop(spark, per_minute, hot):
    keys = ["hot"] * int(hot * 10) + ["a", "b"]
    rows = history(per_minute, keys, 3000, 900)
    rows += [(f"x{i}", "hot", rows[0][2]) for i in range(80)]
    got = {
        r["request_id"]: r["admitted"]
        for r in admission.token_bucket(
            as_events(spark, rows, "k"), F.col("k"), per_minute, chunk_us=17 * SECOND
        ).collect()
    }
    bucket, states, want = admission.Bucket(per_minute), {}, {}
    for rid, key, us in sorted(rows, key=lambda r: (r[2], r[0])):
        n, states[key] = bucket.take(states.get(key, 0), us * bucket.scale, 1)
        want[rid] = n == 1
    assert got == want
    assert 0 < sum(want.values()) < len(want)


def test_limit_cases(spark):
    rows = [("1", "A", 10), ("2", "A", 10), ("3", "B", 10), ("4", "A", 10 + 60 * SECOND)]
    got = admission.token_bucket(as_events(spark, rows, "k"), F.col("k"), 1).collect()
    assert {r["request_id"]: r["admitted"] for r in got} == {
        "1": True, "2": False, "3": True, "4": True
    }


def chain(instants, ttl):
    e, found = -1, []
    for t in instants:
        if t >= e:
            found.append(t)
            e = t + ttl
    return found


@pytest.mark.parametrize("rows, span_s, ttl_s", [(2000, 100_000, 60), (1500, 3000, 300)])
def test_replay_equals_loop(spark, rows, span_s, ttl_s):
    log = history(rows, ["hot"] * 8 + ["a", "b"], rows, span_s)
    log += [("y", "hot", log[0][2])]
    got = {
        r["request_id"]: r["hit"]
        for r in reuse.replay_reuse(as_events(spark, log, "cache_key"), ttl_s).collect()
    }
    until, want = {}, {}
    for rid, key, us in sorted(log, key=lambda r: (r[2], r[0])):
        want[rid] = us < until.get(key, -1)
        if not want[rid]:
            until[key] = us + ttl_s * SECOND
    assert got == want


@pytest.mark.parametrize("seed", range(60))
def test_merged_blocks_equal_loop(seed):
    rng = random.Random(seed)
    ttl = rng.choice([2, 3, 5])
    width = ttl * reuse.BLOCK_TTLS
    instants = sorted({rng.randint(0, rng.choice([30, 300])) for _ in range(60)})
    blocks = {}
    for t in instants:
        blocks.setdefault(t // width, []).append(t)
    children = [
        (b, *reuse._block_steps(np.array(v), b * width, ttl)) for b, v in sorted(blocks.items())
    ]
    entry, last_miss = reuse._merge_children(iter(children), ttl)
    first = min(blocks) * width
    for e in range(first, first + ttl):
        now = np.array([e])
        state = int(reuse._through(entry, last_miss, now, ttl)[0])
        for t in instants:
            e = t + ttl if t >= e else e
        assert state == e


def test_reuse_reaches_over_slices(spark):
    prior = spark.createDataFrame(
        [("A", 0, "old"), ("A", 4000, "new"), ("B", 100, "b")], "cache_key string, s int, r string"
    ).select("cache_key", F.timestamp_seconds("s").alias("computed_at"), F.struct("r").alias("result"))
    asks = spark.createDataFrame(
        [("A", 3999), ("A", 4000), ("A", 7599), ("A", 7600), ("B", 99), ("C", 5)],
        "cache_key string, s int",
    ).select("cache_key", "s", F.timestamp_seconds("s").alias("ts"))
    got = {
        (r["cache_key"], r["s"]): r["reused"]["r"] if r["hit"] else None
        for r in reuse.reuse(asks, prior, 3600).collect()
    }
    assert got == {
        ("A", 3999): None, ("A", 4000): "new", ("A", 7599): "new", ("A", 7600): None,
        ("B", 99): None, ("C", 5): None,
    }


def test_reuse_with_and_without_slices(spark, monkeypatch):
    """A busy key is spread over slices, others are one shuffle; both say what a plain loop says, for nulls too."""
    rng = random.Random(11)
    prior = [(rng.choice("AB"), rng.randrange(4000), f"r{k}") for k in range(60)] + [(None, 5, "x"), ("A", None, "y")]
    asks = [(k, rng.choice("ABC"), rng.randrange(4000)) for k in range(60)] + [(60, None, 9), (61, "A", None)]
    offered = spark.createDataFrame(prior, "cache_key string, s int, r string").select(
        "cache_key", F.timestamp_seconds("s").alias("computed_at"), F.struct("r").alias("result")
    )
    asked = spark.createDataFrame(asks, "n int, cache_key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    hashes = {r.r: r.h for r in offered.select("result.r", F.xxhash64("result").alias("h")).collect()}
    want = {}
    for n, key, s in asks[:60]:
        seen = [(at, hashes[r], r) for k, at, r in prior if k == key and at is not None and at <= s]
        want[n] = max(seen)[2] if seen and max(seen)[0] > s - 900 else None
    for rows, joined in ((10**6, False), (0, True)):
        monkeypatch.setattr(reuse, "SLICE_ROWS", rows)
        found = reuse.reuse(asked, offered, 900)
        assert {r.n: r.reused.r if r.hit else None for r in found.collect()} == want
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == joined


def test_lookback_counts_across_hours(spark):
    rng = random.Random(5)
    articles = [(i, rng.choice("xy"), rng.randrange(400_000)) for i in range(400)]
    requests = [
        (i, rng.choice("xyz"), rng.randrange(400_000), rng.randint(1, 60)) for i in range(80)
    ]
    a = spark.createDataFrame(articles, "article_id int, ticker string, s int").select(
        "article_id", "ticker", F.timestamp_seconds("s").alias("published")
    )
    r = spark.createDataFrame(requests, "request_id int, ticker string, s int, lookback_hours int")
    r = r.select(
        "request_id", "ticker", "lookback_hours", F.lit(3).alias("row_limit"),
        F.timestamp_seconds("s").alias("ts"),
    )
    counted = {
        x["request_id"]: x["n_articles"] for x in lookback.in_lookback(a, r, 3).collect()
    }
    newest = {}
    for x in lookback.batch_limit(a, r, 3).collect():
        newest.setdefault(x["request_id"], {})[x["pos"]] = x["article_id"]
    for rid, ticker, s, hours in requests:
        low = (s - hours * 3600) // 60 * 60
        inside = sorted(
            ((p, i) for i, t, p in articles if t == ticker and low <= p <= s), reverse=True
        )
        assert counted[rid] == len(inside)
        assert [newest.get(rid, {}).get(k) for k in range(min(3, len(inside)))] == [
            i for _, i in inside[:3]
        ]


def loop_flags(has, params):
    """(all attempted, budget exhausted, calls) of one request, feed by feed."""
    left = params.call_budget
    found = [False] * len(has)
    if left == 0:
        return False, True, 0
    left -= 1
    found = [h[0] for h in has]
    if all(found):
        return True, False, 1
    used3 = tried4 = False
    if params.feed2:
        if left == 0:
            return False, True, params.call_budget - left
        left -= 1
        found = [f or h[1] for f, h in zip(found, has)]
    if params.feed3 and not all(found):
        if left == 0:
            return False, True, params.call_budget - left
        left, used3 = left - 1, True
        found = [f or h[2] for f, h in zip(found, has)]
    need4, out = params.feed4 and not all(found), False
    if params.feed4:
        for f in found:
            if not f:
                if left == 0:
                    out = True
                    break
                left, tried4 = left - 1, True
    tried = (not params.feed3 or used3) and (not need4 or tried4)
    return tried, out, params.call_budget - left


@pytest.mark.parametrize("budget", range(6))
@pytest.mark.parametrize("feeds", ["234", "34", "24", "2", "4", ""])
def test_waterfall_flags_equal_loop(spark, budget, feeds):
    params = Params(
        call_budget=budget, feed2="2" in feeds, feed3="3" in feeds, feed4="4" in feeds
    )
    rng = random.Random(budget * 10 + len(feeds))
    symbols, payloads, want = [], [], {}
    for r in range(25):
        rid, has = f"r{r}", []
        bodies = {1: [], 2: [], 3: []}
        for i in range(rng.randint(1, 6)):
            flags = [rng.random() < p for p in (0.5, 0.3, 0.3)]
            has.append(flags)
            symbols.append((rid, i, f"T{i}", "n", 5))
            for feed, flag in enumerate(flags, 1):
                if flag:
                    bodies[feed].append(f"T{i}")
        one = ",".join(f'{{"title":"t","tickers":["{t}"]}}' for t in bodies[1])
        two = ",".join(f'{{"title":"t","entities":[{{"symbol":"{t}"}}]}}' for t in bodies[2])
        three = ",".join(
            f'{{"title":"t","ticker_sentiment":[{{"ticker":"{t}"}}]}}' for t in bodies[3]
        )
        payloads += [
            (rid, 1, None, 200, f"[{one}]"),
            (rid, 2, None, 200, f'{{"data":[{two}]}}'),
            (rid, 3, None, 200, f'{{"feed":[{three}]}}'),
        ]
        want[rid] = loop_flags(has, params)
    states = waterfall(
        spark.createDataFrame(
            symbols, "request_id string, idx int, ticker string, name string, max_articles int"
        ),
        spark.createDataFrame(
            payloads, "request_id string, feed int, ticker string, http_status int, body string"
        ),
        params,
    )
    got = {
        r["request_id"]: (r["all_attempted"], r["budget_exhausted"], r["feed_calls"])
        for r in request_flags(states).collect()
    }
    assert got == want



def test_groups_are_dealt_anew_behind_a_join_on_their_keys(spark):
    """A shuffle on the keys of the join would be dropped, and the join's own may be read map by map."""
    rows = spark.range(10).select(F.col("id").cast("string").alias("key"), F.col("id").alias("parent"), "id")
    joined = rows.hint("merge").join(rows.drop("id"), ["key", "parent"])
    keys = ["key", "parent"]
    once = {"key": "key string", "parent": "parent long"}
    runs = reuse._per_run(joined, keys, ["id"], lambda name, arrays: {"key": [], "parent": []}, ", ".join(once.values()))
    for grouped in (admission._grouped(joined, keys, ["id"]), runs):
        assert "REPARTITION_BY_COL" in grouped._jdf.queryExecution().executedPlan().toString()
