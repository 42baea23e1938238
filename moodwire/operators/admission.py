"""Rate limits over request history.

A bucket starts full with ``n`` tokens, refills ``n`` per minute continuously, and a request needs
one whole token. The outcome of a request depends on all earlier ones of its key, yet one busy key
must not become one task. Three steps keep every task small:

1. the history of each key is cut into chunks, a minute or so much less that the densest holds about ``CHUNK_ROWS``
   requests; each chunk is reduced to a short description of what it does to *any* state it may start with;
2. descriptions are composed, ``FAN_OUT`` neighbours at a time, level by level, and the starts are handed back down
   the same levels, so that no task reads a key's whole history either;
3. chunks are worked through independently from their known start.

Rows of a chunk are brought together by a hash shuffle and a spilling sort and then streamed, so no
step ever holds a chunk in memory. Rows that take no token stay outside of all this.

State is the instant ``x`` at which the bucket would be full again, in units that make a token a
whole number. A chunk without denials maps ``x`` to ``max(x + a, l)``; denials bring ``x`` down by
whole tokens until it is at most ``h``. One such triple (a, l, h) covers a chunk unless the bucket
nearly refills in between; then the chunk gets another triple behind the first. Two triples make one where no state
that the first leaves is raised by the second's ``l``, and the second alone counts where all of them are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodwire.operators.reuse import replay
from moodwire.operators.tenancy import resolve_tenant
from moodwire.operators.validation import with_details
from moodwire.params import Params
from moodwire.session import cut_lineage

MINUTE_US = 60_000_000
CHUNK_ROWS = 50_000
FAN_OUT = 64
_NEVER = -(2**60)
_OPEN = 2**60


class Bucket:
    """Units of a bucket of ``per_minute`` tokens: time × scale, one token = ``token`` units."""

    def __init__(self, per_minute: int):
        if per_minute < 1:
            raise ValueError("a limit must be at least 1 per minute")
        shared = math.gcd(per_minute, MINUTE_US)
        self.size = per_minute
        self.scale = per_minute // shared
        self.token = MINUTE_US // shared
        self.slack = (per_minute - 1) * self.token

    def take(self, x: int, t: int, n: int) -> tuple[int, int]:
        """(granted, new state) for ``n`` requests at instant ``t``."""
        start = max(x, t)
        granted = min(n, (t + self.slack - start) // self.token + 1) if x <= t + self.slack else 0
        return granted, start + granted * self.token if granted else x

    def describe(self, ticks) -> list[tuple[int, int, int]]:
        """Triples (a, l, h) that equal taking ``n`` at ``t`` for all (t, n) in ``ticks``."""
        description = Description(self)
        for t, n in ticks:
            description.add(t, n)
        return description.triples()

    def composed(self, before: list[tuple], after: list[tuple]) -> list[tuple]:
        """Triples that do what ``before`` and then ``after`` do."""
        out = list(before)
        for a, low, high in after:
            if out and low - a >= out[-1][2]:  # the same from wherever the state stands
                out = [(_NEVER, low, high)]
            elif out and low - a <= out[-1][2] - self.token:
                a1, low1, high1 = out[-1]
                out[-1] = (max(a1 + a, _NEVER), max(low1 + a, low), min(high1 + a, high))
            else:
                out.append((a, low, high))
        return out

    def apply(self, triples, x: int) -> int:
        for a, low, high in triples:
            x = max(x + a, low)
            if x > high:
                x -= -(-(x - high) // self.token) * self.token
        return x


class Description:
    """What the requests added so far do to any starting state."""

    def __init__(self, bucket: Bucket):
        self.bucket = bucket
        self.done: list[tuple[int, int, int]] = []
        self.a, self.low, self.high = 0, _NEVER, _OPEN

    def add(self, t: int, n: int = 1) -> None:
        token = self.bucket.token
        if t >= self.high:  # full whatever came before
            self.done, self.a, self.low, self.high = [], _NEVER, t, _OPEN
        elif t > self.high - token:  # full for some starts only
            self.done.append((self.a, self.low, self.high))
            self.a, self.low, self.high = 0, t, _OPEN
        else:
            self.low = max(self.low, t)
        step = min(n, self.bucket.size) * token
        self.a += step
        self.low += step
        self.high = min(self.high + step, t + self.bucket.slack + token)

    def triples(self) -> list[tuple[int, int, int]]:
        return [_small(self.bucket, *t) for t in (*self.done, (self.a, self.low, self.high))]


def _small(bucket: Bucket, a: int, low: int, high: int) -> tuple[int, int, int]:
    """Same effect on states from 0 on with a small ``a``: shifts far above ``high`` come down by whole tokens."""
    spare = (a - max(high, low) - 1) // bucket.token
    return (a - spare * bucket.token, low, high) if spare > 0 else (a, low, high)


def _triples(flat) -> list[tuple[int, int, int]]:
    values = [int(v) for v in flat]
    return list(zip(values[0::3], values[1::3], values[2::3]))


def _grouped(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a group in one partition, next to each other and in order.

    Dealt by a hash of the keys: behind a join on the keys themselves the optimizer drops the shuffle as one too many, and
    when that join turns out small enough to be broadcast its own shuffle is read map by map, groups torn apart.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _chunk_descriptions(ticks: DataFrame, bucket: Bucket, chunk_us: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, description = None, None
        for pdf in batches:
            rows = []
            for key, chunk, t in zip(pdf["key"].tolist(), pdf["chunk"].tolist(), pdf["t"].tolist()):
                if (key, chunk) != now:
                    if now is not None:
                        rows.append((*now, [v for x in description.triples() for v in x]))
                    now, description = (key, chunk), Description(bucket)
                description.add((t - chunk * chunk_us) * bucket.scale)
            yield pd.DataFrame(rows, columns=["key", "chunk", "flat"])
        if now is not None:
            last = (*now, [v for x in description.triples() for v in x])
            yield pd.DataFrame([last], columns=["key", "chunk", "flat"])

    return _grouped(ticks, ["key", "chunk"], ["t"]).mapInPandas(
        scan, "key string, chunk long, flat array<long>"
    )


def _parents(described: DataFrame, bucket: Bucket, width: int) -> DataFrame:
    """Descriptions of ``FAN_OUT`` neighbouring chunks taken together; ``width`` is that of a chunk."""

    def one(rows: list[tuple[int, list]]) -> list[int]:
        together: list[tuple] = []
        for place, triples in rows:
            at = place * width
            # A chunk is described for a bucket that is full at its start at the earliest.
            moved = [(0, at, _OPEN), *((a, max(low + at, _NEVER), min(high + at, _OPEN)) for a, low, high in triples)]
            together = bucket.composed(together, moved)
        return [v for t in together for v in _small(bucket, *t)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            out = []
            for key, parent, chunk, flat in zip(*(pdf[c].tolist() for c in ("key", "parent", "chunk", "flat"))):
                if (key, parent) != now:
                    if now is not None:
                        out.append((*now, one(held)))
                    now, held = (key, parent), []
                held.append((chunk - parent * FAN_OUT, _triples(flat)))
            yield pd.DataFrame(out, columns=["key", "chunk", "flat"])
        if now is not None:
            yield pd.DataFrame([(*now, one(held))], columns=["key", "chunk", "flat"])

    return _grouped(_with_parent(described), ["key", "parent"], ["chunk"]).mapInPandas(
        scan, "key string, chunk long, flat array<long>"
    )


def _with_parent(described: DataFrame) -> DataFrame:
    return described.withColumn("parent", F.expr(f"(chunk - pmod(chunk, {FAN_OUT}L)) div {FAN_OUT}L"))


def _handed_down(described: DataFrame, parents: DataFrame | None, bucket: Bucket, width: int) -> DataFrame:
    """(key, chunk, x): state at the start of each chunk, from that of its parent or from a full bucket."""
    rows = _with_parent(described).withColumn("x0", F.lit(0).cast("long"))
    if parents is not None:
        starts = parents.select("key", F.col("chunk").alias("parent"), F.col("x").alias("x0"))
        rows = rows.drop("x0").join(starts, ["key", "parent"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before, x = None, 0, 0
        for pdf in batches:
            starts = []
            for key, parent, chunk, flat, x0 in zip(
                *(pdf[c].tolist() for c in ("key", "parent", "chunk", "flat", "x0"))
            ):
                if (key, parent) != now:
                    now, before, x = (key, parent), parent * FAN_OUT, x0
                x = max(0, x - (chunk - before) * width)
                starts.append(x)
                x, before = bucket.apply(_triples(flat), x), chunk
            yield pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "x": starts})

    return _grouped(rows, ["key", "parent"], ["chunk"]).mapInPandas(scan, "key string, chunk long, x long")


def _chunk_starts(described: DataFrame, bucket: Bucket, chunk_us: int) -> DataFrame:
    """State at the start of each chunk, ``FAN_OUT`` chunks or parents of one key to a step. Runs jobs."""
    width, levels = chunk_us * bucket.scale, [cut_lineage(described)]
    first, last = levels[0].agg(F.min("chunk"), F.max("chunk")).first()
    widths = [width]
    while first is not None and first // FAN_OUT != last // FAN_OUT:
        levels.append(cut_lineage(_parents(levels[-1], bucket, widths[-1])))
        widths.append(widths[-1] * FAN_OUT)
        first, last = first // FAN_OUT, last // FAN_OUT
    starts = None
    for level, level_width in zip(reversed(levels), reversed(widths)):
        starts = _handed_down(level, starts, bucket, level_width)
    return starts


def _chunk_width(ticks: DataFrame, rows: int) -> int:
    """Microseconds of a chunk: a minute, or a part of it that holds about ``rows`` of the densest minute. Runs a job."""
    minute = F.expr(f"(t - pmod(t, {MINUTE_US}L)) div {MINUTE_US}L")
    densest = ticks.groupBy("key", minute.alias("minute")).count().agg(F.max("count")).first()[0] or 0
    return max(1, MINUTE_US // max(1, -(-densest // rows)))


def _decide(events: DataFrame, starts: DataFrame, bucket: Bucket, chunk_us: int) -> DataFrame:
    """Walks through each chunk behind its start row; other columns pass through as they are."""
    rows = events.unionByName(
        starts.select(
            F.col("key").alias("_key"),
            F.col("chunk").alias("_chunk"),
            F.col("x").alias("_x"),
            F.lit(0).alias("_kind"),
        ),
        allowMissingColumns=True,
    )
    keep = [f for f in events.schema.fields if f.name not in _WORK_COLUMNS]
    names = [f.name for f in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = 0
        for batch in batches:
            kind, start, t, chunk = (batch.column(c).to_pylist() for c in ("_kind", "_x", "_t", "_chunk"))
            admitted = []
            for i, is_event in enumerate(kind):
                if not is_event:
                    x = start[i]
                    admitted.append(None)
                else:
                    got, x = bucket.take(x, (t[i] - chunk[i] * chunk_us) * bucket.scale, 1)
                    admitted.append(got == 1)
            whole = pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(admitted, pa.bool_())],
                [*names, "admitted"],
            )
            yield whole.filter(pa.array(kind, pa.int32()).cast(pa.bool_()))

    schema = T.StructType([*keep, T.StructField("admitted", T.BooleanType())])
    return _grouped(rows, ["_key", "_chunk"], ["_kind", "_t", "request_id"]).mapInArrow(
        scan, schema
    )


_WORK_COLUMNS = ("_key", "_chunk", "_t", "_x", "_kind")


def token_bucket(
    events: DataFrame,
    key: Column,
    per_minute: int,
    eligible: Column | None = None,
    chunk_us: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``admitted``. ``events`` needs ``ts`` and ``request_id``, which breaks ties. Runs jobs.

    Rows that are not ``eligible`` take no token and are not admitted; they never reach Python. Keep ``events`` narrow
    and landed: its rows are shuffled, sorted and handed to Python and back, and read for the width of a
    chunk (unless given), for the descriptions and for the decisions.
    """
    bucket = Bucket(per_minute)
    counted = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    taking = events if eligible is None else events.filter(counted)
    timed = taking.withColumns(
        {"_key": key.cast("string"), "_t": F.unix_micros("ts"), "_kind": F.lit(1)}
    )
    ticks = timed.select(F.col("_key").alias("key"), F.col("_t").alias("t"))
    if bucket.size == 1:  # each request taken shuts the bucket for a minute: the chain of misses, with short descriptions
        decided = _shut_for(timed, MINUTE_US)
        return decided if eligible is None else _with_others(decided, events.filter(~counted))
    width = chunk_us or _chunk_width(ticks, chunk_rows)
    chunk = lambda t: F.expr(f"({t} - pmod({t}, {width}L)) div {width}L")
    described = _chunk_descriptions(ticks.withColumn("chunk", chunk("t")), bucket, width)
    starts = _chunk_starts(described, bucket, width)
    placed = timed.withColumns({"_chunk": chunk("_t"), "_x": F.lit(None).cast("long")})
    decided = _decide(placed, starts, bucket, width)
    return decided if eligible is None else _with_others(decided, events.filter(~counted))


def _shut_for(timed: DataFrame, us: int) -> DataFrame:
    taken = replay(timed, F.col("_key"), us)
    return taken.withColumn("admitted", ~F.col("hit")).drop("hit", *_WORK_COLUMNS)


def _with_others(decided: DataFrame, others: DataFrame) -> DataFrame:
    return decided.unionByName(others.withColumn("admitted", F.lit(False)))


def global_limit(events: DataFrame, per_minute: int, eligible: Column | None = None) -> DataFrame:
    return token_bucket(events, F.lit("all"), per_minute, eligible)


def tenant_limit(events: DataFrame, per_minute: int, eligible: Column | None = None) -> DataFrame:
    return token_bucket(events, F.col("tenant"), per_minute, eligible)


def admit(requests: DataFrame, params: Params, keys: DataFrame | None = None) -> DataFrame:
    """(request_id, ts, tenant, outcome_code), the code null when admitted. Runs jobs.

    Order: validation, tenant, global limit, tenant limit. A request stopped early takes no token
    of a later limit; one stopped by its tenant's limit has already spent a global token. Only the
    narrow decision table goes through the limits, and it is cut in between so that neither
    validation nor the first limit is worked out twice.
    """
    checked = with_details(requests)
    named = resolve_tenant(checked, params, keys)
    decided = named.select(
        "request_id",
        "ts",
        F.when(F.size("details") == 0, F.col("tenant")).alias("tenant"),
        F.when(F.size("details") > 0, F.lit("INVALID_REQUEST"))
        .otherwise(F.col("outcome_code"))
        .alias("outcome_code"),
    )
    for limit, per_minute, code in (
        (global_limit, params.global_per_minute, "GLOBAL_RATE_LIMITED"),
        (tenant_limit, params.tenant_per_minute, "TENANT_RATE_LIMITED"),
    ):
        open_still = F.col("outcome_code").isNull()
        limited = limit(cut_lineage(decided), per_minute, open_still)
        decided = limited.withColumn(
            "outcome_code",
            F.when(open_still & ~F.col("admitted"), F.lit(code)).otherwise(F.col("outcome_code")),
        ).drop("admitted")
    return decided
