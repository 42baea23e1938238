"""Runs of repeated words at every period, by tiles whose size follows the period.

A run is a stretch of words with smallest period q, at least ``shortest`` words and ``repeats`` periods long, that no
neighbouring word extends. Periods are taken by octave: those of [S, 2S) are looked for with tiles around the
boundaries 0, S, 2S, ... A run of such a period has w[i] = w[i + q] for at least 2q >= 2S words i, so it holds a
boundary c, and one with a step of room behind or before it. Tiles of one octave overlap, so neighbouring
boundaries of one run always see a common piece of it:

1. **explode**: a document's words become numbers, and the numbers become tiles per octave. Documents of up to
   ``tile_words`` words are solved where they are read; the tiles of a longer one are rows of their own that
   are dealt over the cluster, small periods together, each large octave with tiles of its own size;
2. **solve**: at a boundary, two Z-functions (to the right from c, to the left from c) give for every period of
   the octave at once how far words agree with those q further on. Only tiles where some eight words recur
   at a period of the octave are solved. A stretch whose root is a power of a shorter one is left to that one;
3. **stitch**: pieces are shuffled by document and period, and pieces that touch become one run. Of equal
   stretches the smallest period counts, so what step 2 left in place goes here.

Python keeps one document's words, or one tile, at a time; what is shuffled are pieces, and tiles of long documents.

Words are what stands between ASCII white space. Defined cases: a null or empty text has no words and no runs.
Rows are told apart by id and text: repeated rows get equal results each, a null id is an id like any other.
Bytes that are not UTF-8 are words like others, and read as U+FFFD in the collapsed text. Only the two named
columns are read, others may have any name. ``collapsed`` holds the kept words with one space between
them; a word goes if some run contains it behind the run's first period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import landed

#: Words that must recur at a period for a tile to be solved; every run holds as many at a boundary.
PROBE = 8
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_PIECE = "array<struct<period:bigint,start:bigint,stop:bigint>>"
_TILE = "struct<low_step:bigint,high_step:bigint,first:bigint,low:bigint,high:bigint,words:array<int>>"
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many items from i on agree with those from the start; z[0] is the length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=100_000)
def _primes_of(n: int) -> tuple[int, ...]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*found, n) if n > 1 else tuple(found)


def _probes(words: np.ndarray) -> np.ndarray:
    """A number for the ``PROBE`` words from each place on; equal words have equal numbers."""
    own = words.astype(np.uint64) * np.uint64(_MIX[0]) + np.uint64(1)
    for k, mix in enumerate(_MIX):
        further = own[1 << k :]
        own = own[: len(further)] * np.uint64(mix) ^ (further + (further >> np.uint64(29)))
    return own


def steps_of(n: int, repeats: int, shortest: int) -> list[int]:
    """Steps S of the octaves of a stretch of n words; the first one has all periods below 2 * ``PROBE``."""
    if n < shortest:
        return []
    steps = [PROBE]
    while 2 * steps[-1] * repeats <= n:
        steps.append(2 * steps[-1])
    return steps


def _recurring(probes: np.ndarray, step: int, first: int, low: int, high: int) -> dict[int, np.ndarray]:
    """{boundary: periods} at which the words of a boundary recur, with a step of room on one side.

    Boundaries and ``low``, ``high`` are places in the document, ``probes`` begin at ``first``.
    """
    n = len(probes)
    start = max(low, -(-first // step) * step)
    found: dict[int, np.ndarray] = {}
    count = -(-(min(high, first + n) - start) // step)
    if count <= 0:
        return found
    at = start - first
    padded = np.concatenate([probes[at:], np.zeros(step * (count + 1) - min(n - at, step * (count + 1)), np.uint64)])
    blocks = padded[: step * (count + 1)].reshape(count + 1, step)
    head = blocks[:-1, :1]
    hits = [(j, q) for near, blocks_q in ((0, blocks[:-1]), (1, blocks[1:]))
            if near or step == PROBE
            for j, q in [np.nonzero(blocks_q == head)]
            for q in [q + near * step]]
    j = np.concatenate([h[0] for h in hits])
    q = np.concatenate([h[1] for h in hits])
    c = at + j * step
    sure = (q > 0) & (c + q < n)
    j, q, c = j[sure], q[sure], c[sure]
    ahead, behind = c + step - PROBE, c - step
    on = np.zeros(len(c), bool)
    ok = ahead + q < n
    on[ok] = probes[ahead[ok]] == probes[(ahead + q)[ok]]
    ok = behind >= 0
    on[ok] |= probes[behind[ok]] == probes[(behind + q)[ok]]
    order = np.lexsort((q[on], j[on]))
    j, q = j[on][order], q[on][order]
    cuts = np.flatnonzero(np.diff(j)) + 1
    for own_j, own_q in zip(np.split(j, cuts), np.split(q, cuts)):
        if len(own_j):
            found[start + int(own_j[0]) * step] = own_q
    return found


def _solved(words: np.ndarray, first: int, step: int, c: int, periods, repeats: int, shortest: int):
    """(period, start, stop) of the stretches around boundary c, as far as its tile of 2S to each side shows them."""
    n, at, reach = len(words), c - first, 2 * step
    right = z_function(words[at : at + 2 * reach].tolist())
    before = words[max(0, at - reach) : at][::-1].tolist()
    around = words[max(0, at - reach) : at + reach - 1][::-1].tolist()
    left = z_function([*before, -1, *around])
    end = len(before) + 1 + len(around) - (at - max(0, at - reach))  # where the reversed c - 1 stands
    for q in periods.tolist():
        r, b = min(right[q], reach), left[end - q]
        clipped = r == reach or b == reach
        if not clipped and b + r + q < max(shortest, repeats * q):
            continue
        # Pieces that are cut off are over q long, so they show the root whole.
        if any(
            right[q // p] >= r + q - q // p and left[end - q // p] >= b
            for p in _primes_of(q)
        ):
            continue
        yield q, c - b, c + r + q


def pieces(words: np.ndarray, first: int, low: int, high: int, steps, repeats: int, shortest: int):
    """Pieces of the boundaries in [low, high) for the octaves with the given steps."""
    probes = _probes(words) if len(words) >= PROBE else np.zeros(0, np.uint64)
    for step in steps:
        for c, periods in _recurring(probes, step, first, low, high).items():
            yield from _solved(words, first, step, c, periods, repeats, shortest)


def tiles(n: int, tile_words: int, repeats: int, shortest: int):
    """(lowest step, highest step, first word, end word, low, high) of the tiles of a document of n words."""
    steps = steps_of(n, repeats, shortest)
    small = [s for s in steps if 16 * s <= tile_words] or steps[:1]
    for band in [small, *[[s] for s in steps[len(small) :]]] if steps else []:
        body = max(tile_words // band[-1], 4) * band[-1]
        for low in range(0, n, body):
            yield band[0], band[-1], max(0, low - 2 * band[-1]), min(n, low + body + 4 * band[-1]), low, min(n, low + body)


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word of a document, the same for equal words."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    return np.fromiter((number(w, len(known)) for w in words), np.int32, len(words))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words).decode("utf-8", "replace").encode("utf-8")).digest()


class _Rows:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 1000, bytes_most: int = 8_000_000):
        self.schema, self.most, self.bytes_most = schema, most, bytes_most
        self.rows, self.size = [], 0

    def add(self, row: dict, size: int = 100) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= self.most or self.size >= self.bytes_most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self.rows, self.size = [], 0


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, tile_words: int, repeats: int, shortest: int):
    """A row per document: words, digest, pieces, and its text if a later step may need it; and rows of tiles."""
    out = _Rows(schema)
    for batch in batches:
        for own, text in zip(batch.column("own"), batch.column("text")):
            own, raw = own.as_py(), text.as_py() or b""
            words = raw.split()
            n = len(words)
            found, long = [], n > tile_words
            if n >= shortest:
                numbers = _numbered(words)
                if not long:
                    steps = steps_of(n, repeats, shortest)
                    found = [
                        dict(zip(("period", "start", "stop"), p))
                        for p in pieces(numbers, 0, 0, n, steps, repeats, shortest)
                    ]
                for a, b, first, end, low, high in tiles(n, tile_words, repeats, shortest) if long else ():
                    tile = {"low_step": a, "high_step": b, "first": first, "low": low, "high": high,
                            "words": numbers[first:end]}
                    yield from out.add({"own": own, "tile": tile}, 4 * (end - first))
            text = raw if found or long else None
            row = {"own": own, "n_words": n, "digest": _digest(words), "pieces": found, "text": text}
            yield from out.add(row, 200 + len(text or b"") + 50 * len(found))
    yield from out.rest()


def _solve(batches: Iterator[pa.RecordBatch], schema: pa.Schema, repeats: int, shortest: int):
    """Pieces of the tiles of long documents."""
    out = _Rows(schema, 10_000)
    for batch in batches:
        for own, tile in zip(batch.column("own"), batch.column("tile")):
            own, words = own.as_py(), tile["words"].values.to_numpy()
            a, b, first, low, high = (tile[k].as_py() for k in ("low_step", "high_step", "first", "low", "high"))
            steps = [a << k for k in range(b.bit_length()) if a << k <= b]
            for q, start, stop in pieces(words, first, low, high, steps, repeats, shortest):
                yield from out.add({"own": own, "period": q, "start": start, "stop": stop})
    yield from out.rest()


def _collapse(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """Kept words of documents with runs, and their digest."""
    out = _Rows(schema)
    for batch in batches:
        for own, text, runs in zip(batch.column("own"), batch.column("text"), batch.column("runs")):
            words, runs = (text.as_py() or b"").split(), runs.as_py()
            change = np.zeros(len(words) + 1, np.int64)
            for run in runs:
                change[run["start"] + run["period"]] += 1
                change[run["start"] + run["length"]] -= 1
            gone = (np.cumsum(change[:-1]) > 0).tolist()
            kept = b" ".join([w for w, g in zip(words, gone) if not g]).decode("utf-8", "replace")
            row = {"own": own.as_py(), "n_words": len(words), "runs": runs, "collapsed": kept,
                   "collapsed_sha256": hashlib.sha256(kept.encode("utf-8")).hexdigest()}
            yield from out.add(row, 100 + len(kept) + 60 * len(runs))
    yield from out.rest()


def stitched(found: DataFrame, repeats: int, shortest: int) -> DataFrame:
    """(doc_id, text_key, start, length, period) of the runs whose pieces (doc_id, text_key, period, start, stop) are given.

    Pieces of one document and period that overlap by the period or more belong together: as stretches
    of words q apart they touch.
    """
    own = ["doc_id", "text_key"]
    earlier = Window.partitionBy(*own, "period").orderBy("start", "stop")
    reached = F.max("stop").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") > reached - F.col("period"), 1).otherwise(0)
    opened = found.withColumn("fresh", F.when(reached.isNull(), 1).otherwise(fresh))
    joined = (
        opened.withColumn("run", F.sum("fresh").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*own, "period", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    long = joined.where(F.col("stop") - F.col("start") >= F.greatest(F.lit(shortest), repeats * F.col("period")))
    return (
        long.groupBy(*own, "start", "stop")
        .agg(F.min("period").alias("period"))
        .select(*own, "start", (F.col("stop") - F.col("start")).alias("length"), "period")
    )


def periodic_runs(
    docs: DataFrame, repeats: int = 3, shortest: int = 24, tile_words: int = 65_536
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_sha256, collapsed) of every row of ``docs`` (doc_id, text). Runs a job.

    ``runs`` is an array of (start, length, period) by start and period. ``collapsed`` is null where no
    word goes, so that texts without runs are not written again; the digest is of the collapsed text always.
    """
    if repeats < 3 or shortest < 3 * PROBE:
        raise ValueError(f"runs have at least three periods and {3 * PROBE} words")
    key = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    texts = docs.select(F.struct("doc_id", key.alias("text_key")).alias("own"), F.col("text").cast("binary"))

    def schema(**columns: str) -> T.StructType:
        made = T.StructType([texts.schema["own"]])
        for name, kind in columns.items():
            made = made.add(name, T._parse_datatype_string(kind))
        return made

    cut_to = schema(n_words="bigint", digest="binary", pieces=_PIECE, text="binary", tile=_TILE)
    solve_to = schema(period="bigint", start="bigint", stop="bigint")
    collapse_to = schema(n_words="bigint", runs=_RUNS, collapsed_sha256="string", collapsed="string")
    a, b, c = (to_arrow_schema(x) for x in (cut_to, solve_to, collapse_to))

    cut = landed(texts.mapInArrow(lambda x: _cut(x, a, tile_words, repeats, shortest), cut_to), "tiles")
    near = cut.select("own.*", F.inline("pieces"))
    dealt = cut.where("tile is not null").select("own", "tile").repartition("own", "tile.low_step", "tile.low")
    far = dealt.mapInArrow(lambda x: _solve(x, b, repeats, shortest), solve_to)
    found = stitched(near.unionByName(far.select("own.*", "period", "start", "stop")), repeats, shortest)
    runs = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")
    )
    runs = runs.select(
        F.struct("doc_id", "text_key").alias("found"),
        F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(_RUNS).alias("runs"),
    )
    rows = cut.where("tile is null")
    maybe = rows.where("text is not null").select("own", "n_words", "digest", "text")
    judged = maybe.join(runs, F.col("own").eqNullSafe(F.col("found")), "left")
    with_runs = judged.where("runs is not null").select("own", "text", "runs")
    collapsed = with_runs.mapInArrow(lambda x: _collapse(x, c), collapse_to)
    without = rows.where("text is null").select("own", "n_words", "digest").unionByName(
        judged.where("runs is null").select("own", "n_words", "digest")
    )
    plain = without.select(
        "own",
        "n_words",
        F.array().cast(_RUNS).alias("runs"),
        F.lower(F.hex("digest")).alias("collapsed_sha256"),
        F.lit(None).cast("string").alias("collapsed"),
    )
    return collapsed.unionByName(plain).select("own.doc_id", "n_words", "runs", "collapsed_sha256", "collapsed")


def strongest(runs: Column) -> Column:
    """Of ``runs``, the one with the greatest length / period, compared exactly; ties to the smallest start, period."""
    def order(a, b):
        more = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when(more != 0, F.signum(more.cast("double"))).when(
            a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double"))
        ).otherwise(F.signum((a["period"] - b["period"]).cast("double"))).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))
