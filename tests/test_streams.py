"""Streams against plain loops: shuffled arrival, restarts, repeats, late rows, a kill between write and commit."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moodwire import schemas
from moodwire.params import Params
from moodwire.sources.sinks import read_upserted, upsert_batch
from moodwire.streaming import jobs
from moodwire.streaming.ordered import Arrivals, end_marker, in_event_order, observed
from workload import streams  # noqa: F401
from workload.registry import QUERIES

START_S = 1_700_000_000


class Source:
    """A folder that gets rows in slices; every slice is a run of its own."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def put(self, rows, end=False):
        names = [part.split()[0] for part in self.schema.split(", ")]
        ddl = self.schema.replace("ts timestamp", "ts double")
        frame = self.spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_seconds("ts"))
        frame.select(names).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        if end:
            end_marker(frame.select(names), "2100-01-01").write.mode("append").parquet(str(self.path / "in"))

    def run(self, job):
        stream = self.spark.readStream.schema(self.schema).parquet(str(self.path / "in"))
        jobs.run_available(job(stream), str(self.path / "out"), str(self.path / "state"))
        return self.spark.read.parquet(str(self.path / "out")).collect()


def bucket(rows, per_minute):
    """Plain token bucket over (id, seconds) rows."""
    full, token, out = 0.0, 60 / per_minute, {}
    for i, t in sorted(rows, key=lambda r: (r[1], r[0])):
        out[i] = full <= t + (per_minute - 1) * token + 1e-9
        full = max(full, t) + token if out[i] else full
    return out


def test_limits_in_event_order_whatever_the_arrival(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{k:03d}", START_S + k * 4.0, rng.choice("AAB")) for k in range(120)]
    arrived = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 50))
    source = Source(spark, tmp_path, "request_id string, ts timestamp, tenant string")
    job = lambda s: jobs.stream_limit(s, F.col("tenant"), 6)
    source.put(arrived[:70])
    source.run(job)
    source.put(arrived[70:] + arrived[70:75], end=True)  # five rows come twice
    got = source.run(job)
    want = {}
    for tenant in "AB":
        want |= bucket([(i, t) for i, t, own in rows if own == tenant], 6)
    assert len(got) == len(rows) and {r.request_id: r.admitted for r in got} == want
    assert not all(want.values())


def test_admission_order_on_a_stream(spark, tmp_path):
    """Invalid and unknown requests take no token, a global denial takes none of the tenant's."""
    schema = schemas.REQUESTS
    rows = []
    for k in range(30):
        symbols = [] if k % 7 == 0 else [("T", "name")]
        claims = (" ", "s") if k % 5 == 0 else ("t", "s")
        rows.append((f"r{k:03d}", float(START_S + k), None, claims, symbols, 24, 5))
    params = Params(auth_mode="jwt", global_per_minute=12, tenant_per_minute=6)
    source = Source(spark, tmp_path, schema)
    job = lambda s: jobs.stream_admit(s, params)

    def put(rows, end=False):
        frame = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts double"))
        frame = frame.withColumn("ts", F.timestamp_seconds("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if end:
            end_marker(frame, "2100-01-01").write.mode("append").parquet(str(tmp_path / "in"))

    put(rows[20:] + rows[:5])
    source.run(job)
    put(rows[5:20], end=True)
    got = {r.request_id: r.outcome_code for r in source.run(job)}
    open_ids, want = [], {}
    for i, t, _, claims, symbols, *_ in rows:
        want[i] = "INVALID_REQUEST" if not symbols else "UNAUTHORIZED" if claims[0] == " " else None
        if want[i] is None:
            open_ids.append((i, t))
    by_global = bucket(open_ids, 12)
    by_tenant = bucket([(i, t) for i, t in open_ids if by_global[i]], 6)
    for i, _ in open_ids:
        want[i] = "GLOBAL_RATE_LIMITED" if not by_global[i] else None if by_tenant[i] else "TENANT_RATE_LIMITED"
    assert got == want and set(want.values()) >= {None, "TENANT_RATE_LIMITED", "GLOBAL_RATE_LIMITED"}


def test_reused_results_come_from_the_computing_row(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{k:03d}", START_S + rng.uniform(0, 3000), rng.choice("KL"), k if k % 3 else None) for k in range(80)]
    arrived = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 50))
    source = Source(spark, tmp_path, "request_id string, ts timestamp, k string, n long")
    result = F.struct(F.concat(F.lit("by "), "request_id").alias("text"), (F.col("n") * 2).alias("twice"))
    job = lambda s: jobs.stream_reuse(s, F.col("k"), 300, result)
    source.put(arrived[:40])
    source.run(job)
    source.put(arrived[40:], end=True)
    got = {r.request_id: (r.hit, r.computed_by, r.result.text, r.result.twice) for r in source.run(job)}
    want, open_until, by = {}, {}, {}
    for i, t, k, n in sorted(rows, key=lambda r: r[1]):
        hit = t < open_until.get(k, 0)
        if not hit:
            open_until[k], by[k] = t + 300, (i, f"by {i}", None if n is None else 2 * n)
        want[i] = (hit, *by[k])
    assert got == want


MINUTE_S = START_S - START_S % 60


def test_state_outlives_a_watermark_inside_a_stretch(spark, tmp_path):
    """Rows of a stretch the watermark has only entered are still held, so what decides them must be kept."""
    first = [("a1", MINUTE_S + 30.5, "A"), ("b1", MINUTE_S + 170.0, "B")]  # the watermark comes to second 110
    second = [("a2", MINUTE_S + 65.0, "A"), ("a3", MINUTE_S + 119.0, "A")]
    late = [("b2", MINUTE_S + 119.5, "B")]
    schema = "request_id string, ts timestamp, tenant string"
    cases = {
        "limit": (lambda s: jobs.stream_limit(s, F.col("tenant"), 1), "admitted", {"a1": True, "a2": False, "a3": True}),
        "reuse": (lambda s: jobs.stream_reuse(s, F.col("tenant"), 60), "hit", {"a1": False, "a2": True, "a3": False}),
    }
    for name, (job, column, want) in cases.items():
        source = Source(spark, tmp_path / name, schema)
        source.put([*first, second[0]])
        source.run(job)
        source.put([second[1], *late], end=True)
        got = {r.request_id: r[column] for r in source.run(job)}
        assert {k: got[k] for k in want} == want and len(got) == 5


def test_a_watermark_at_the_very_end_of_a_stretch_loses_nothing(spark, tmp_path):
    rows = [("a1", MINUTE_S + 30.0, "A"), ("b1", MINUTE_S + 120.0, "B")]  # the watermark comes to second 60
    source = Source(spark, tmp_path, "request_id string, ts timestamp, tenant string")
    job = lambda s: jobs.stream_limit(s, F.col("tenant"), 1)
    source.put(rows)
    source.run(job)
    source.put([("a2", MINUTE_S + 61.0, "A")], end=True)
    assert {r.request_id: r.admitted for r in source.run(job)} == {"a1": True, "a2": False, "b1": True}


def test_late_and_repeated_rows_are_counted(spark, tmp_path):
    source = Source(spark, tmp_path, "request_id string, ts timestamp")
    counts = Arrivals()
    spark.streams.addListener(counts)
    job = lambda s: in_event_order(observed(s))
    try:
        source.put([("a", START_S + 0.0), ("b", START_S + 500.0), ("b", START_S + 500.0)])
        source.run(job)
        assert counts.wait()
        source.put([("c", START_S + 10.0), ("d", START_S + 480.0), ("e", START_S + 600.0), ("e", START_S + 600.0)], True)
        got = source.run(job)
        assert counts.wait()
    finally:
        spark.streams.removeListener(counts)
    assert sorted(r.request_id for r in got) == ["a", "b", "d", "e"]
    assert (counts.arrived, counts.repeated, counts.late) == (7, 2, 1)


class FakeState:
    """One value with timers, and a watermark, as a processor sees them."""

    def __init__(self):
        self.value, self.timers, self.watermark = None, set(), 0
        self.getValueState = lambda name, schema: self
        self.listTimers = lambda: iter(set(self.timers))
        self.deleteTimer, self.registerTimer = self.timers.discard, self.timers.add
        self.exists, self.get, self.clear = lambda: self.value is not None, lambda: self.value, lambda: self.update(None)
        self.getCurrentWatermarkInMs = lambda: self.watermark

    def update(self, value):
        self.value = value


def test_a_shard_of_reuse_keys_is_one_call():
    """Several keys, a null one among them, are told apart in one call; what is over is dropped with the next rows."""
    state, minute = FakeState(), 60_000_000
    windows = jobs._Windows(10 * minute, ["request_id", "by_key", "t"], 60_000)
    windows.init(state)

    def run(*rows):
        made = pd.concat(windows.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["request_id", "by_key", "t"])]), state))
        return {r.request_id: (r.hit, r.computed_by) for r in made.itertuples()}

    first = run(("b1", "B", 2 * minute), ("a2", "A", 3 * minute), ("a1", "A", minute), ("n1", None, 0), ("n2", None, 5))
    assert first == {
        "a1": (False, "a1"), "a2": (True, "a1"), "b1": (False, "b1"), "n1": (False, "n1"), "n2": (True, "n1"),
    }
    assert sorted(state.value[0], key=str) == ["A", "B", None] and state.timers == {13 * 60_000 + 1}
    state.watermark = 12 * 60_000 + 1
    assert run(("b2", "B", 12 * minute - 1), ("a3", "A", 30 * minute)) == {"b2": (True, "b1"), "a3": (False, "a3")}
    assert sorted(state.value[0]) == ["A", "B"] and state.timers == {41 * 60_000 + 1}


def test_quantiles_of_closed_windows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"r{k}", START_S // 60 * 60 + rng.uniform(0, 180), rng.choice([None, *range(9)])) for k in range(200)]
    source = Source(spark, tmp_path, "request_id string, ts timestamp, duration_ms long")
    source.put(rows, end=True)
    got = {r.window_start.timestamp(): (r.samples, r.p50, r.p95, r.p99) for r in source.run(jobs.stream_quantiles)}
    windows: dict = {}
    for _, t, ms in rows:
        if ms is not None:
            windows.setdefault(t // 60 * 60, []).append(ms)
    want = {}
    for start, ms in windows.items():
        ms.sort()
        want[start] = (len(ms), *[float(ms[int((len(ms) - 1) * q + 0.5)]) for q in (0.5, 0.95, 0.99)])
    assert got == want


def test_ingest_survives_a_kill_between_write_and_commit(spark, tmp_path, monkeypatch):
    requests = [(f"r{k}", float(START_S + 20 * k), None, None, [("AAPL", "n"), ("MSFT", "n")], 24, 5) for k in range(12)]
    titles = lambda t: json.dumps([{"title": t, "tickers": ["AAPL"]}])
    payloads = [(f"r{k}", 1, None, None, 200, titles(f"bear {k}"), float(START_S + 20 * k + 15)) for k in range(0, 12, 2)]
    payloads += [("r1", 1, None, None, 200, titles("too late"), float(START_S + 20 + 100))]
    paths = {k: str(tmp_path / k) for k in ("asked", "given", "out", "state")}

    def put(name, schema, time, rows, **marker):
        frame = spark.createDataFrame(rows, schema.replace(f"{time} timestamp", f"{time} double"))
        frame = frame.withColumn(time, F.timestamp_seconds(time))
        frame.coalesce(1).write.mode("append").parquet(paths[name])
        if marker:
            end_marker(frame, "2100-01-01", time, **marker).write.mode("append").parquet(paths[name])

    def run():
        read = spark.readStream
        writer = jobs.stream_ingest(
            read.schema(schemas.REQUESTS).parquet(paths["asked"]),
            read.schema(schemas.PAYLOADS).parquet(paths["given"]),
            Params(), paths["out"], paths["state"], wait="1 minute",
        )
        writer.start().awaitTermination()

    put("asked", schemas.REQUESTS, "ts", requests[:6])
    put("given", schemas.PAYLOADS, "received_at", payloads[:3])
    writes = []

    def dies(rows, path, stream, number):
        upsert_batch(rows, path, stream, number)
        writes.append(number)
        if len(writes) == 2:
            raise RuntimeError("killed")

    monkeypatch.setattr(jobs, "upsert_batch", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert writes[1] == writes[2]  # the batch that was written but not committed comes again
    put("asked", schemas.REQUESTS, "ts", requests[6:], request_id=None)
    put("given", schemas.PAYLOADS, "received_at", payloads[3:], request_id="end")
    run()
    found = read_upserted(spark, paths["out"], f"request_id string, idx int, {schemas.SENTIMENT}").collect()
    got = sorted((r.request_id, r.idx, r.symbol, r.label, r.article_count) for r in found)
    assert got == sorted((f"r{k}", 0, "AAPL", "bearish", 1) for k in range(0, 12, 2))


def test_upsert_keeps_the_newest_row_of_a_key(spark, tmp_path):
    schema = "request_id string, idx int, label string"
    write = lambda rows, stream, n: upsert_batch(spark.createDataFrame(rows, schema), str(tmp_path / "t"), stream, n)
    write([("r", 0, "old"), ("r", 1, "kept")], "a", 0)
    write([("r", 0, "new")], "a", 3)
    write([("r", 0, "new")], "a", 3)  # the same batch again
    write([("r", 0, "other stream"), ("s", 0, "x")], "b", 0)
    got = sorted(tuple(r) for r in read_upserted(spark, str(tmp_path / "t"), schema).collect())
    assert got == [("r", 0, "new"), ("r", 1, "kept"), ("s", 0, "x")]


def test_table_streams_read_files_and_folders_of_files(spark, tmp_path):
    """A large table is a folder of parts, a small one a file; both are read whole."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a bear").alias("text"))
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for kind in ("parts", "file"):
        assert QUERIES["st4_stream_scoring"](spark, str(tmp_path / kind)).distinct().count() == 40


def test_ingest_never_broadcasts_what_a_timer_lets_go(spark):
    """To the planner a released batch is as small as the empty input that came with it."""
    one = spark.range(1).select(
        F.lit("r").alias("request_id"),
        F.expr("array(named_struct('ticker', 'T', 'name', 'n'))").alias("symbols"),
        F.lit(5).alias("max_articles"),
        F.expr("array(named_struct('request_id', 'r', 'feed', 1, 'ticker', null, 'http_status', 200, 'body',"
               " '[{\"title\":\"bear\",\"tickers\":[\"T\"]}]'))").alias("payloads"),
    )
    scored = jobs.score_requests(one, Params())
    assert [r.label for r in scored.collect()] == ["bearish"]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Range" not in plan
