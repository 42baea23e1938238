"""Near duplicates by min-max hashing, confirmed on whole shingle sets.

A document's set holds the distinct ``width``-word shingles of its whole lower-cased (A-Z) text, each
as a 64-bit hash; shorter texts are one shingle, texts without words an empty set. Equal sets are one
node. Under each permutation both the smallest and the largest hash are kept, so ``permutations``
evaluations give twice as many signature values. The values are banded; nodes that meet in any band
form candidate clusters, and inside a cluster every pair is compared on its whole sets.

With the defaults (96 permutations, 192 values, 32 bands of 6) two sets at similarity 0.85 meet
with probability 1 - (1 - 0.85^6)^32 = 1 - 3e-7.

Skew: copies collapse in partial aggregates; a bucket of any size yields one edge per node to its
smallest node, never pairs. Clusters above ``unit`` shingles are cut into blocks and each pair of
blocks is a task of its own, so a task holds at most two blocks; smaller clusters are packed by hash,
``unit`` shingles or fewer to a pack on average. It emits a spanning forest of the confirmed links and not the links.

Defined cases: null, empty or blank text has the empty set, is linked with nothing and is its own
class (a null id: a null class, kept). Repeated rows and equal texts share a class. Rows with a null
id take part; the class is the smallest id that is not null, or null if there is none, and a row
with a null id is kept only in such a class. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, landed

#: Columns of one block of permuted values, sized for a processor's cache.
COLUMNS = 4096
#: Bytes of text that are hashed at once; one longer text is hashed alone.
CHUNK = 1 << 18
#: Packs of small clusters that there are at least.
PACKS = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def weights(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same on every machine."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


class Shingles:
    """Sorted distinct shingle hashes of whole texts, hashed byte-wise for many texts at once.

    A word's hash is a polynomial over random values of its bytes, read off prefix sums.
    """

    def __init__(self, width: int = 5):
        self.width = width
        codes = np.arange(256)
        self.value = weights(256, 7)[np.where((codes >= 65) & (codes <= 90), codes + 32, codes)]
        self.blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        self.base = weights(1, 13)[0]
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(0, np.uint64)
        self.shift = weights(width, 11)

    def _words(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of bytes that begin and end with a blank."""
        n = len(joined)
        if len(self.up) < n:
            size = max(n, CHUNK + 2)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        edges = np.flatnonzero(np.diff(self.blank[joined]))
        starts, ends = edges[0::2] + 1, edges[1::2]
        sums = np.cumsum(self.value[joined] * self.up[:n])
        return mixed((sums[ends] - sums[starts - 1]) * self.down[starts]), starts

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts one after the other, and where each text's words begin."""
        joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        begins = np.cumsum([1] + [len(t) + 1 for t in texts])
        words, at = self._words(joined)
        return words, np.searchsorted(at, begins)

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        words, first = self.words(texts)
        n = max(0, len(words) - self.width + 1)
        total = np.zeros(n, np.uint64)
        for k, w in enumerate(self.shift):
            total += words[k : k + n] * w
        total = mixed(total)
        sets = []
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= self.width:
                sets.append(np.unique(total[lo : hi - self.width + 1]))
            else:  # the whole sequence, told apart by its length
                short = (words[lo:hi] * self.shift[: hi - lo]).sum(keepdims=True)
                sets.append(mixed(short + np.uint64(hi - lo)) if hi > lo else words[:0])
        return sets

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        sets, some, size = [], [], 0
        for text in texts:
            some.append(text or b"")
            size += len(some[-1])
            if size >= CHUNK:
                sets += self._chunk(some)
                some, size = [], 0
        return sets + (self._chunk(some) if some else [])


class MinMax:
    """Band keys of a set from the least and the greatest permuted hash of each permutation."""

    def __init__(self, permutations: int, bands: int):
        self.a = (weights(permutations, 23) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
        self.b = (weights(permutations, 29) >> np.uint64(32)).astype(np.uint32)
        self.bands, self.rows = bands, 2 * permutations // bands
        self.salt, self.mult = weights(bands, 31), weights(self.rows, 37)
        # A band takes minima and maxima of different permutations.
        order = np.arange(permutations)
        self.order = np.stack([order, permutations + np.roll(order, self.rows)], 1).reshape(-1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(short), COLUMNS):
            values = self.a[:, None] * short[None, k : k + COLUMNS] + self.b[:, None]
            np.minimum(low, values.min(1), out=low)
            np.maximum(high, values.max(1), out=high)
        return np.concatenate([low, high])

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        values = self.signature(hashes)[self.order].astype(np.uint64).reshape(self.bands, -1)
        return mixed((mixed(values + np.uint64(1)) * self.mult).sum(1) + self.salt).view(np.int64)


def _features(width: int, permutations: int, bands: int):
    def run(batches):
        shingles, minmax = Shingles(width), MinMax(permutations, bands)
        for batch in batches:
            counts, nodes, keys = [], [], []
            for own in shingles(batch.column("text").to_pylist()):
                counts.append(len(own))
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                keys.append(minmax.keys(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(counts, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "node", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            sets = [s.view(np.int64) for s in shingles(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"]
            )

    return run


def linked(sets: list[np.ndarray], block: np.ndarray, across: bool, percent: int) -> np.ndarray:
    """Component labels (smallest position) of the sets with ``100 * shared >= percent * union``.

    ``across``: only pairs from different blocks count. Sets hold distinct integers.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    by_token = np.argsort(token, kind="stable")
    holders = owner[by_token]
    first = np.searchsorted(token[by_token], np.arange(token.max() + 2))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(n)
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        mine = token[starts[i] : starts[i + 1]]
        spans = first[mine], first[mine + 1]
        lengths = spans[1] - spans[0]
        at = np.repeat(spans[0] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        shared = np.bincount(holders[at + np.arange(lengths.sum())], minlength=n)
        hit = 100 * shared >= percent * (sizes + sizes[i] - shared)
        hit[: i + 1] = False
        if across:
            hit &= block != block[i]
        joined = np.unique(label[hit])
        joined = joined[joined != label[i]]
        if len(joined):
            label[np.isin(label, np.append(joined, label[i]))] = min(label[i], joined.min())
    return label


def _forest(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")])
        names = table.column("node").to_pylist()
        cluster = table.column("cluster").to_pylist()
        block = table.column("block").to_numpy()
        across = table.column("high")[0].as_py() != table.column("low")[0].as_py()
        items = table.column("items").combine_chunks()
        offsets, values = items.offsets.to_numpy(), items.values.to_numpy()
        a, b, begin = [], [], 0
        for end in range(1, len(names) + 1):
            if end < len(names) and cluster[end] == cluster[begin]:
                continue
            if end - begin > 1:
                sets = [values[offsets[k] : offsets[k + 1]] for k in range(begin, end)]
                for k, root in enumerate(linked(sets, block[begin:end], across, percent)):
                    if root != k:
                        a.append(names[begin + k])
                        b.append(names[begin + root])
            begin = end
        whole = pa.array([table.column("whole")[0].as_py()] * len(a), pa.bool_())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "whole": whole})

    return run


def packs(shingles: int, unit: int) -> int:
    """Packs over which whole clusters of so many shingles together are spread."""
    return max(PACKS, -(-shingles // unit))


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 85,
    permutations: int = 96,
    bands: int = 32,
    unit: int = 250_000,
    by_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``by_text``: also text_key (``xxhash64`` of the text), and of texts that share the smallest id of a class
    only the one with the smallest key is kept. ``unit``: shingles of one block of a cluster, which bounds the memory of a task.
    """
    own = docs.select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key")
    )
    features = landed(
        own.mapInArrow(
            _features(width, permutations, bands),
            "doc_id long, text_key long, n_shingles long, node binary, bands array<long>",
        ),
        "minmax",
    )
    # Of all rows, which is no less than what the clusters hold, and read from one landed column.
    n_packs = packs(features.agg(F.sum("n_shingles")).first()[0] or 0, unit)
    keyed = features.where("node is not null")
    rows = keyed.select("node", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"))
    near = rows.join(buckets.where("hub <> top"), "key").where("node <> hub")
    clusters = components(near.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    clusters = clusters.withColumnRenamed("root", "cluster")

    no_id = F.col("doc_id").isNull().alias("no_id")  # a null id would come first
    nodes = keyed.groupBy("node").agg(
        F.min(F.struct(no_id, "doc_id", "text_key")).alias("at"), F.min("n_shingles").alias("weight")
    )
    members = nodes.join(clusters, "node")
    total = members.groupBy("cluster").agg(F.sum("weight").alias("total"))
    placed = members.join(total, "cluster").withColumn("m", F.ceil(F.col("total") / unit))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), "m"))
    pairs = placed.select("node", "at", "cluster", "m", "block")
    texts = (
        own.join(
            pairs.select("node", F.col("at.doc_id").alias("at_id"), F.col("at.text_key").alias("at_key")),
            (F.col("text_key") == F.col("at_key")) & F.col("doc_id").eqNullSafe(F.col("at_id")),
        )
        .groupBy("node")
        .agg(F.first("text").alias("text"))
    )
    sets = texts.mapInArrow(_sets(width), "node binary, items array<long>")
    spread = F.when(F.col("m") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    )
    # Whole clusters are packed by hash; blocks of a large one meet two by two.
    loads = pairs.select("node", "cluster", "m", "block", F.explode(spread).alias("other")).select(
        "node",
        "cluster",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        F.when(F.col("m") == 1, F.pmod(F.xxhash64("cluster"), F.lit(n_packs).cast("long")).cast("string"))
        .otherwise(F.hex("cluster"))
        .alias("pack"),
        (F.col("m") == 1).alias("whole"),
    )
    forest = landed(
        loads.join(sets, "node")
        .groupBy("pack", "low", "high")
        .applyInArrow(_forest(percent), "a binary, b binary, whole boolean"),
        "forest",
    )
    # Trees inside a whole cluster already end in their smallest node; others meet across blocks.
    found = forest.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    parts = forest.where("not whole")
    if not parts.isEmpty():
        found = found.unionByName(components(parts))
    classes = (
        nodes.join(found, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), F.col("at").alias("least"))
    )
    smallest = classes.groupBy("root").agg(F.min("least").alias("first"))
    ids = classes.join(smallest, "root").select(
        "node", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_key")
    )
    marked = features.select("doc_id", "text_key", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    if by_text:
        kept &= F.col("node").isNull() | F.col("doc_id").isNull() | (F.col("text_key") == F.col("first_key"))
    return marked.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        kept.alias("kept"),
        *(["text_key"] if by_text else []),
    )
