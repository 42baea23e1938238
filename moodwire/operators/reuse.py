"""Reuse of recent results within a time to live.

Two questions are answered here. Given stored results, which requests may reuse one (``reuse``)?
Given only the request history, which requests found a live result and which had to compute one
(``replay_reuse``, ``replay_layers``)? The second is a chain: a miss opens a window of one TTL, the
first request after the window is the next miss. A busy key is worked through in blocks of a few
TTLs; each block is described by a step function "window still open until e → last miss in the
block", blocks are merged level by level, and the known starts are handed back down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodwire.functions.text import cache_key
from moodwire.session import cut_lineage, shuffles_dropped

BLOCK_TTLS = 4
FAN_OUT = 16
SLICE_US = 300_000_000
SLICE_ROWS = 100_000
_CLOSED = -(2**62)


def reuse(request_symbols: DataFrame, prior: DataFrame, ttl_s: int) -> DataFrame:
    """Adds ``hit`` and ``reused``: the newest result of the key not older than the TTL.

    ``request_symbols`` has cache_key and ts; ``prior`` has cache_key, computed_at and a struct
    ``result``. Where a key has more than ``SLICE_ROWS`` rows, rows are spread over slices of time. Inside a slice a window finds the
    newest result so far; the newest result of all slices before comes from one row per slice, so
    a busy key is never sorted in one task. Of results of one instant the one with the largest hash
    counts, inside a slice and across slices alike. Runs a job.
    """
    at = F.unix_micros("ts")
    asks = request_symbols.withColumns({"_at": at, "_side": F.lit(1)})
    offers = prior.select(
        "cache_key",
        F.unix_micros("computed_at").alias("_at"),
        F.lit(0).alias("_side"),
        F.xxhash64("result").alias("_tie"),
        F.struct(F.unix_micros("computed_at").alias("at"), F.col("result")).alias("_offer"),
    )
    both = asks.unionByName(offers, allowMissingColumns=True).dropna(subset=["cache_key", "_at"])
    if _busiest(request_symbols, prior) > SLICE_ROWS:
        seen = _newest_over_slices(both)
    else:
        seen = both.withColumn("_seen", F.last("_offer", ignorenulls=True).over(_so_far("cache_key"))).filter(
            F.col("_side") == 1
        )
    oldest = F.col("_at") - F.lit(ttl_s * 1_000_000)
    hit = F.coalesce(F.col("_seen.at") > oldest, F.lit(False))
    return (
        seen.withColumn("hit", hit)
        .withColumn("reused", F.when(hit, F.col("_seen.result")))
        .select(*request_symbols.columns, "hit", "reused")
    )


def _busiest(asks: DataFrame, offers: DataFrame) -> int:
    """Most rows of both that any key has. Runs a job."""
    keys = asks.select("cache_key").union(offers.select("cache_key"))
    with shuffles_dropped(asks.sparkSession):
        return keys.groupBy("cache_key").count().agg(F.max("count")).first()[0] or 0


def _so_far(*keys: str):
    return (
        Window.partitionBy(*keys)
        .orderBy("_at", "_side", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _newest_over_slices(both: DataFrame) -> DataFrame:
    """Rows that ask, with ``_seen``, the newest offer before them in their slice or in one before."""
    both = both.withColumn("_slice", F.expr(f"_at div {SLICE_US}L"))
    before = Window.partitionBy("cache_key").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        both.groupBy("cache_key", "_slice")
        .agg(F.max_by("_offer", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_newest"))
        .select(
            "cache_key",
            "_slice",
            F.last("_newest", ignorenulls=True).over(before).alias("_carried"),
        )
    )
    here = F.last("_offer", ignorenulls=True).over(_so_far("cache_key", "_slice"))
    return (
        both.withColumn("_here", here)
        .filter(F.col("_side") == 1)
        .join(carried, ["cache_key", "_slice"])
        .withColumn("_seen", F.coalesce("_here", "_carried"))
    )


def with_cache_key(symbols: DataFrame, news_only: bool = False) -> DataFrame:
    return symbols.withColumn("cache_key", cache_key(F.col("ticker"), news_only))


def newest_per_key(results: DataFrame) -> DataFrame:
    """What the store holds: per key the newest result of a tier that may be stored."""
    storable = results.filter(F.col("source_tier").isin("tier_1_local_onnx", "tier_3_llm"))
    return storable.groupBy("cache_key").agg(
        F.max("computed_at").alias("computed_at"),
        F.max_by(
            F.struct(*[c for c in results.columns if c not in ("cache_key", "computed_at")]),
            F.struct("computed_at", "request_id", "idx"),
        ).alias("result"),
    )


def store(results: DataFrame, path: str) -> None:
    """Append this run's storable results, by day; readers take the newest per key. Runs a job.

    A reader that asks for ``day`` from the oldest useful result on skips the folders before.
    """
    newest = newest_per_key(results).withColumn("day", F.to_date("computed_at"))
    newest.write.mode("append").partitionBy("day").parquet(path)


def _block_steps(t: np.ndarray, block_start: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one block of sorted instants: (open until ≤ entry) → last miss."""
    after = np.searchsorted(t, t + ttl)
    last = np.where(after < len(t), after, np.arange(len(t)))
    while True:  # follow the chain, doubling the stride
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    usable = min(int(np.searchsorted(t, block_start + ttl)) + 1, len(t))
    return _compact(t[:usable], t[last[:usable]])


def _compact(entry: np.ndarray, last_miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep the highest entry of each run of equal outcomes."""
    keep = np.append(last_miss[1:] != last_miss[:-1], True)
    return entry[keep], last_miss[keep]


def _through(entry: np.ndarray, last_miss: np.ndarray, e: np.ndarray, ttl: int) -> np.ndarray:
    """Where windows that are open until ``e`` stand after the block."""
    at = np.searchsorted(entry, e)
    return np.where(at < len(entry), last_miss[np.minimum(at, len(entry) - 1)] + ttl, e)


def _runs(
    batches: Iterator[pd.DataFrame], keys: list[str]
) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Consecutive rows with equal ``keys``, also across batch borders, as arrays."""
    held: list[dict[str, np.ndarray]] = []
    now: tuple | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        changes = np.zeros(len(pdf), dtype=bool)
        changes[0] = True
        for k in keys:
            changes[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = [*np.flatnonzero(changes), len(pdf)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            name = tuple(columns[k][start] for k in keys)
            if name != now and now is not None:
                yield now, _joined(held)
                held = []
            now = name
            held.append({c: v[start:end] for c, v in columns.items()})
    if now is not None:
        yield now, _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _per_run(df: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """``work(key values, arrays)`` for each group, many groups per Python batch.

    Groups are formed by one hash shuffle and a spilling sort; ``work`` gives the output columns
    as a dict of equal-length lists or arrays. Rows are dealt by a hash of the keys, since a shuffle on the keys
    themselves is dropped behind a join on them, and that of the join may be read map by map.
    """
    columns = [part.split()[0] for part in schema.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, size = [], 0
        for name, arrays in _runs(batches, keys):
            out = work(name, arrays)
            ready.append(out)
            size += len(out[columns[-1]])
            if size >= 10_000:
                yield _stacked(ready, columns)
                ready, size = [], 0
        if ready:
            yield _stacked(ready, columns)

    dealt = df.repartition(F.xxhash64(*keys))
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)


def _stacked(parts: list[dict], columns: list[str]) -> pd.DataFrame:
    """Outputs of many groups as one frame; a single value stands for all rows of its group."""
    rows = [len(part[columns[-1]]) for part in parts]

    def whole(column: str) -> np.ndarray:
        values = [part[column] for part in parts]
        if isinstance(values[0], (list, np.ndarray)):
            return np.concatenate([np.asarray(v, dtype="int64") for v in values])
        kind = object if isinstance(values[0], str) else "int64"
        return np.repeat(np.array(values, dtype=kind), rows)

    return pd.DataFrame({c: whole(c) for c in columns})


def _children(arrays: dict[str, np.ndarray]):
    """(block, entries, last misses) of each block in a run sorted by block and entry."""
    block = arrays["block"]
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield int(block[start]), arrays["entry"][start:end], arrays["last_miss"][start:end]


_STEPS = "key string, block long, entry long, last_miss long"
_STARTS = "key string, block long, e long"


def _describe_blocks(ticks: DataFrame, ttl: int) -> DataFrame:
    def one_block(name, arrays):
        key, block = name
        entry, last_miss = _block_steps(arrays["t"], int(block) * ttl * BLOCK_TTLS, ttl)
        return {"key": key, "block": block, "entry": entry, "last_miss": last_miss}

    return _per_run(ticks, ["key", "block"], ["t"], one_block, _STEPS)


def _merge_children(children, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of neighbouring blocks taken together."""
    entry = e = None
    extended = False
    for _, child_entry, child_miss in children:
        if entry is None:
            entry, e = child_entry, child_miss + ttl
            continue
        e = _through(child_entry, child_miss, e, ttl)
        if not extended:  # a window that outlasts the first block's entries
            entry, e = np.append(entry, child_entry[:1]), np.append(e, child_miss[:1] + ttl)
            extended = True
    return _compact(entry, e - ttl)


def _merge_blocks(steps: DataFrame, ttl: int) -> DataFrame:
    """Step functions of ``FAN_OUT`` neighbouring blocks at a time."""

    def one_parent(name, arrays):
        entry, last_miss = _merge_children(_children(arrays), ttl)
        return {"key": name[0], "block": name[1], "entry": entry, "last_miss": last_miss}

    return _per_run(_with_parent(steps), ["key", "parent"], ["block", "entry"], one_parent, _STEPS)


def _with_parent(df: DataFrame) -> DataFrame:
    return df.withColumn("parent", F.expr(f"block div {FAN_OUT}"))


def _walk(children, e: int, ttl: int) -> tuple[list[int], list[int]]:
    """Blocks and the window end each of them starts with."""
    blocks, starts, now = [], [], np.array([e], dtype="int64")
    for block, entry, last_miss in children:
        blocks.append(block)
        starts.append(int(now[0]))
        now = _through(entry, last_miss, now, ttl)
    return blocks, starts


def _hand_down(steps: DataFrame, starts: DataFrame | None, ttl: int) -> DataFrame:
    """(key, block, e) of the blocks in ``steps`` from the starts of their parents."""
    if starts is None:

        def from_the_first(name, arrays):
            blocks, e = _walk(_children(arrays), _CLOSED, ttl)
            return {"key": name[0], "block": blocks, "e": e}

        return _per_run(steps, ["key"], ["block", "entry"], from_the_first, _STARTS)

    def below_parent(name, arrays):
        blocks, e = _walk(_children(arrays), int(arrays["e"][0]), ttl)
        return {"key": name[0], "block": blocks, "e": e}

    parents = starts.withColumnRenamed("block", "parent")
    return _per_run(
        _with_parent(steps).join(parents, ["key", "parent"]),
        ["key", "parent"],
        ["block", "entry"],
        below_parent,
        _STARTS,
    )


def _misses(ticks: DataFrame, starts: DataFrame, ttl: int) -> DataFrame:
    def one_block(name, arrays):
        t, e, found = arrays["t"], int(arrays["e"][0]), []
        at = int(np.searchsorted(t, e))
        while at < len(t):
            found.append(int(t[at]))
            at = int(np.searchsorted(t, found[-1] + ttl))
        return {"key": name[0], "t": np.array(found, dtype="int64")}

    return _per_run(
        ticks.join(starts, ["key", "block"]), ["key", "block"], ["t"], one_block, "key string, t long"
    )


def miss_instants(ticks: DataFrame, ttl_us: int) -> DataFrame:
    """(key, t) of the misses among the distinct instants (key, t). Runs jobs.

    The number of merge levels follows from the first and last instant of the history, read as one
    row; block descriptions are cut so that going down does not describe the blocks again.
    """
    blocked = ticks.withColumn("block", F.expr(f"t div {ttl_us * BLOCK_TTLS}L"))
    levels = [cut_lineage(_describe_blocks(blocked, ttl_us))]
    first, last = levels[0].agg(F.min("block"), F.max("block")).first()
    while first is not None and last - first + 1 > FAN_OUT:
        levels.append(cut_lineage(_merge_blocks(levels[-1], ttl_us)))
        first, last = first // FAN_OUT, last // FAN_OUT
    starts = None
    for steps in reversed(levels):
        starts = _hand_down(steps, starts, ttl_us)
    return _misses(blocked, starts, ttl_us)


def replay(log: DataFrame, key: Column, ttl_us: int) -> DataFrame:
    """Adds ``hit`` to a log of ts and request_id: false where a window of one TTL opens. Runs jobs."""
    keyed = log.withColumns({"_key": key.cast("string"), "_t": F.unix_micros("ts")})
    ticks = keyed.select(F.col("_key").alias("key"), F.col("_t").alias("t")).distinct()
    misses = miss_instants(ticks, ttl_us).select(
        F.col("key").alias("_key"), F.col("t").alias("_t"), F.lit(True).alias("_miss")
    )
    place = F.row_number().over(Window.partitionBy("_key", "_t").orderBy("request_id"))
    return (
        keyed.join(misses, ["_key", "_t"], "left")
        .withColumn("hit", ~(F.coalesce(F.col("_miss"), F.lit(False)) & (place == 1)))
        .drop("_key", "_t", "_miss")
    )


def replay_reuse(log: DataFrame, ttl_s: int) -> DataFrame:
    """Adds ``hit`` to a log of (cache_key, ts, request_id). Runs jobs."""
    return replay(log, F.col("cache_key"), ttl_s * 1_000_000)


def replay_layers(log: DataFrame, ttl_s: int) -> DataFrame:
    """Adds ``layer``: memory, shared or miss. The log also has ``node``. Runs jobs.

    A node's memory is refilled for a full TTL by whatever answers a memory miss, so memory misses
    are the chain of (node, key); the shared layer sees only those, and its misses are the chain
    of the key over them.
    """
    ttl_us = ttl_s * 1_000_000
    by_node = cut_lineage(replay(log, F.to_json(F.struct("node", "cache_key")), ttl_us))
    from_memory = by_node.filter("hit").drop("hit").withColumn("layer", F.lit("memory"))
    passed_on = replay(by_node.filter(~F.col("hit")).drop("hit"), F.col("cache_key"), ttl_us)
    below = passed_on.withColumn(
        "layer", F.when(F.col("hit"), F.lit("shared")).otherwise(F.lit("miss"))
    ).drop("hit")
    return from_memory.unionByName(below)
