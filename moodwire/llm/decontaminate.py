"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's phrases.

Texts are lower-cased (A-Z); words are runs of a-z, 0-9 and characters beyond ASCII. A window is
``window`` consecutive words of an item; an item of fewer, but not none, is one window. Rows of a
partition are gathered into shards of about ``shard_words`` words. A shard's words become numbers;
words that no item has cannot be part of an occurrence and become separators, and stretches between
separators that are shorter than the shortest window are left out of the index, which loses no
occurrence. Windows are found by backward search through wavelet-tree ranks, occurrences are placed by
sampled suffix positions, and overlapping occurrences merge into removal spans.

There is no shuffle: a shard's results belong to its own rows. Items are sent to the executors
in blocks of at most about ``block_bytes`` of text; with several blocks the documents pass once
per block and are landed in between, so nothing that grows with the benchmark is held whole.

Defined cases: null, empty or word-less texts have zero counts and no spans. Items without
words or with a null id take no part; equal ids are one item. Repeated rows and null ids of
documents each get their own result. Extra columns are kept; one named like ``into`` is replaced.
Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import landed
from .fm_index import FMIndex

#: Keeps a-z, 0-9 and bytes beyond ASCII; lowers A-Z; all else parts words.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
#: Occurrences placed at once.
PLACED = 1 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Phrases:
    """The windows of some items as rows of word numbers, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: k for k, name in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            if name is None:
                continue
            own = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(text)]
            for k in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[k : k + window]), set()).add(place[name])
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)
        for k, phrase in enumerate(owners):
            self.rows[k, : len(phrase)] = phrase
        lists = [sorted(x) for x in owners.values()]
        self.first = np.cumsum([0] + [len(x) for x in lists])
        self.owner = np.array([k for x in lists for k in x], np.int64)
        self.shortest = int(self.lengths.min()) if len(owners) else 0


def search_shard(texts: list[bytes | None], phrases: Phrases, every: int = 8):
    """For each text: words, hit words, names of its items (sorted), span starts and ends."""
    get, numbers, ends = phrases.numbers.get, [], [0]
    for text in texts:
        words = words_of(text)
        numbers += [get(w, 1) for w in words]
        ends.append(len(numbers))
    ends, text = np.array(ends), np.array(numbers, np.int64)
    sizes = np.diff(ends)
    change = np.zeros(len(text) + 1, np.int64)
    pairs = np.empty((0, 2), np.int64)
    at, symbols = _stretches(text, ends, phrases.shortest) if phrases.shortest else ([], [])
    if len(at):
        index = FMIndex(symbols, every)
        low, high = index.search(phrases.rows, phrases.lengths)
        some = np.flatnonzero(high > low)
        total = np.cumsum(np.concatenate([[0], (high - low)[some]]))
        seen = []
        for begin in range(0, int(total[-1]), PLACED):
            k = np.arange(begin, min(begin + PLACED, int(total[-1])))
            which = np.searchsorted(total, k, "right") - 1
            phrase = some[which]
            start = at[index.locate(low[phrase] + k - total[which])]
            np.add.at(change, start, 1)
            np.subtract.at(change, start + phrases.lengths[phrase], 1)
            doc = np.searchsorted(ends, start, "right") - 1
            seen.append(np.unique(np.stack([doc, phrase], 1), axis=0))
        if seen:
            pairs = np.unique(np.concatenate(seen), axis=0)
    hit = np.cumsum(change)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(hit)])
    items = _items(pairs, phrases)
    out = []
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        n_hit, starts, stops = int(before[hi] - before[lo]), [], []
        if n_hit:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].view(np.int8), [0]])))
            starts, stops = edge[0::2].tolist(), edge[1::2].tolist()
        out.append((int(sizes[k]), n_hit, items.get(k, []), starts, stops))
    return out


def _stretches(text: np.ndarray, ends: np.ndarray, shortest: int):
    """Positions and symbols of the stretches that can hold a window, each closed by a separator."""
    known = text > 1
    # A document's first word opens a stretch even if the word before it is known.
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    borders = ends[1:-1]
    borders = borders[borders < len(text)]
    opens[borders] = known[borders]
    starts = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    length = np.bincount(run[known], minlength=len(starts))
    keep = known & (length[np.maximum(run, 0)] >= shortest) if len(starts) else known
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    gaps = np.flatnonzero(opens[at])[1:]
    return np.insert(at, gaps, -1), np.insert(text[at], gaps, 1)


def _items(pairs: np.ndarray, phrases: Phrases) -> dict[int, list[str]]:
    if not len(pairs):
        return {}
    doc, phrase = pairs.T
    n = phrases.first[phrase + 1] - phrases.first[phrase]
    skip = np.repeat(phrases.first[phrase] - np.cumsum(n) + n, n)
    item = phrases.owner[skip + np.arange(n.sum())]
    both = np.unique(np.stack([np.repeat(doc, n), item], 1), axis=0)
    out: dict[int, list[str]] = {}
    for d, k in both.tolist():
        out.setdefault(d, []).append(phrases.names[k])
    return out


def _merged(old: dict | None, new: tuple) -> tuple:
    """The results of two blocks of items for one text."""
    if old is None:
        return new
    spans, out = sorted([*zip(old["starts"], old["ends"]), *zip(new[3], new[4])]), []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    items = sorted({*old["items"], *new[2]})
    return new[0], sum(b - a for a, b in out), items, [a for a, _ in out], [b for _, b in out]


def _pass(sent, shard_words: int, every: int):
    def run(batches):
        phrases, waiting, size = sent.value, [], 0

        def done():
            texts = [t for b in waiting for t in b.column("text").to_pylist()]
            found = search_shard(texts, phrases, every)
            k = 0
            for b in waiting:
                old = b.column("old").to_pylist()
                rows = [_merged(o, f) for o, f in zip(old, found[k : k + b.num_rows])]
                k += b.num_rows
                columns = [
                    pa.array(c, kind.type) for c, kind in zip(zip(*rows) if rows else [[]] * 5, _ARROW)
                ]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), pa.StructArray.from_arrays(columns, fields=list(_ARROW))],
                    names=["row", "old"],
                )

        for batch in batches:
            waiting.append(batch)
            size += batch.column("text").nbytes
            if size >= 6 * shard_words:  # about six bytes a word
                yield from done()
                waiting, size = [], 0
        yield from done()

    return run


def benchmark_overlap(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    window: int = 10,
    shard_words: int = 500_000,
    every: int = 8,
    block_bytes: int = 32 << 20,
    into: str = "overlap",
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, items, and merged word spans (starts, ends).

    ``items`` has item_id and text.
    """
    spark = docs.sparkSession
    tests = items.select(
        F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text")
    ).where("name is not null and length(text) > 0")
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != into])
    kind = T.StructType([f for f in docs.schema.fields if f.name != into])
    out = T.StructType([T.StructField("row", kind), T.StructField("old", RESULT)])
    rows = docs.select(row.alias("row"), F.lit(None).cast(RESULT).alias("old"))
    block = F.pmod(F.xxhash64("name"), F.lit(blocks))
    for k in range(blocks):
        chosen = [(r["name"], bytes(r["text"])) for r in tests.where(block == k).collect()]
        sent = spark.sparkContext.broadcast(Phrases(chosen, window))
        held = rows.select("row", "old", F.col(f"row.`{text}`").cast("binary").alias("text"))
        rows = held.mapInArrow(_pass(sent, shard_words, every), out)
        if blocks > 1:
            rows = landed(rows, "overlap")
            sent.unpersist()
    return rows.select("row.*", F.col("old").alias(into))


def without_spans(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    edges = np.diff(
        np.frombuffer(b" " + text.translate(_WORDS) + b" ", np.uint8) != 32, prepend=False
    )
    at = np.flatnonzero(edges) - 1
    begin, end, kept, last = at[0::2], at[1::2], [], 0
    for a, b in zip(starts, ends):
        kept.append(text[last : begin[a]])
        last = end[b - 1]
    return b"".join([*kept, text[last:]])
