"""Quality by nearest-neighbour voting over labelled latent-semantic vectors.

Terms are hashed byte trigrams of the lower-cased text, pairs of byte classes, and words that repeat
the word 1 to 16 places before, over whole texts.
The model is fitted on a bounded sample: of the labelled rows that may be learned from, the ``per_class``
of each label that come first in the order of a hash of their id. Their weighted term counts give,
by singular value decomposition, a projection to ``rank`` latent dimensions. Projection and labelled
vectors (2 * per_class * rank numbers) are broadcast; every document is projected, multiplied with all
labelled vectors in blocks of rows, and the labels of its ``k`` nearest (all, where the k-th ties) are
averaged with weights that grow with the cosine. Scoring is row by row: no shuffle, no text leaves its task.

Defined cases: a null or empty text, or one shorter than a pair of bytes, has no terms and gets the mean
label of the sample; without any labelled row every score is 0.5. Labels that are null or belong to
no row are ignored; an id with several labels counts with their mean. Repeated rows score alike. Rows
with a null id are scored and never learned from. Extra columns are kept; those named like the
results are replaced.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .near_dups import Shingles

#: Buckets of hashed trigrams, classes of bytes, and with both the number of terms.
BUCKETS, CLASSES, LAGS = 1024, 32, 16
TERMS = BUCKETS + CLASSES * CLASSES + LAGS
#: Weight of a repeated word against other terms.
REPEATED = 3.0
#: Bytes and texts whose terms are counted at once.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 18, 256

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.int64)


def _classes() -> np.ndarray:
    """Letters, capitals, digits and bytes beyond ASCII are a class each, other signs share 28."""
    kind = 4 + _BYTES % (CLASSES - 4)
    kind[(_BYTES >= 97) & (_BYTES <= 122)] = 0
    kind[(_BYTES >= 65) & (_BYTES <= 90)] = 1
    kind[(_BYTES >= 48) & (_BYTES <= 57)] = 2
    kind[_BYTES >= 128] = 3
    return kind


_KIND = _classes()
_SHINGLES = Shingles()


def term_counts(texts: list[bytes | None]) -> np.ndarray:
    """Counts of all terms, one row per text."""
    out, some, size = [], [], 0
    for text in texts:
        some.append(text or b"")
        size += len(some[-1])
        if size >= CHUNK_BYTES or len(some) >= CHUNK_TEXTS:
            out.append(_counted(some))
            some, size = [], 0
    out.append(_counted(some))
    return np.concatenate(out)


def _counted(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)) * TERMS, sizes)
    low, kind = _LOWER[joined], _KIND[joined]
    three = (low[:-2] * 961 + low[1:-1] * 31 + low[2:]) * 40503 >> 6 & BUCKETS - 1
    two = BUCKETS + kind[:-1] * CLASSES + kind[1:]
    inside = owner[:-2] == owner[2:], owner[:-1] == owner[1:]
    codes = [(owner[:-1] + two)[inside[1]]]
    if len(joined) > 2:
        codes.append((owner[:-2] + three)[inside[0]])
    words, first = _SHINGLES.words(texts)
    of = np.repeat(np.arange(len(texts)) * TERMS, np.diff(first))
    for lag in range(1, LAGS + 1):
        same = (words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag])
        codes.append(of[lag:][same] + (TERMS - lag))
    counts = np.bincount(np.concatenate(codes), minlength=len(texts) * TERMS)
    return counts.reshape(-1, TERMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Neighbours:
    """A fitted projection, the labelled vectors and their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int, k: int):
        self.k, self.labels = min(k, len(labels)), labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = (counts > 0).sum(0)
        self.weight = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + np.float32(1)
        self.weight[-LAGS:] *= REPEATED
        terms = self._terms(counts)
        self.mean = terms.mean(0) if len(terms) else np.zeros(TERMS, np.float32)
        spread = np.zeros((TERMS, TERMS))
        for k in range(0, len(terms), 512):
            centred = (terms[k : k + 512] - self.mean).astype(np.float64)
            spread += centred.T @ centred
        values, vectors = np.linalg.eigh(spread)
        self.axes = vectors[:, np.argsort(values)[::-1][:rank]].astype(np.float32)
        self.vectors = self._latent(terms)

    def _terms(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.sqrt(counts) * self.weight)

    def _latent(self, terms: np.ndarray) -> np.ndarray:
        return _unit((terms - self.mean) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        full = np.flatnonzero(counts.any(1))
        if not self.k or not len(full):
            return out
        near = np.round(self._latent(self._terms(counts[full])) @ self.vectors.T, 5)
        last = np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k, None]
        vote = np.where(near >= last, np.maximum(near, 1e-4) ** 4, np.float32(0))
        out[full] = np.clip(vote @ self.labels / vote.sum(1), 0, 1)
        return out


def fit(
    docs: DataFrame, labels: DataFrame, *, label: str, per_class: int = 2048, rank: int = 64, k: int = 15
) -> Neighbours:
    """Learn from the labelled rows whose crc32(doc_id as text) is not divisible by 5."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.avg(label).alias("mark"))
    )
    parts = [
        marks.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for side in (F.col("mark") >= 0.5, F.col("mark") < 0.5)
    ]
    # At most 2 * per_class rows.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")

    def run(batches):
        for batch in batches:
            rows = term_counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array([zlib.compress(r.tobytes(), 1) for r in rows[: batch.num_rows]], pa.binary()),
                ],
                names=["doc_id", "mark", "terms"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"doc_id {kind}, mark double, terms binary")

    def learn(batches):
        """All of these rows are one task's, 4 * per_class at most; only the model goes to the driver."""
        rows, own = [np.zeros((0, TERMS), np.float32)], []
        for batch in batches:
            packed = batch.column("terms").to_pylist()
            rows.append(np.array([np.frombuffer(zlib.decompress(r), np.float32) for r in packed]).reshape(-1, TERMS))
            own += batch.column("mark").to_pylist()
        model = Neighbours(np.concatenate(rows), np.array(own, np.float64), rank, k)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    sample = found.orderBy(F.xxhash64("doc_id", "terms")).limit(4 * per_class)
    made = sample.coalesce(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(made["model"]) if made else Neighbours(np.zeros((0, TERMS), np.float32), np.zeros(0), rank, k)


def held_out(doc_id: str = "doc_id"):
    """True for rows that no model may learn from; false for a null id, which has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Neighbours, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` (with a column text) plus score (0 to 1) and predicted (1 from ``threshold`` on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    row = F.struct(*[F.col(f"`{f.name}`") for f in kept])

    def run(batches):
        for batch in batches:
            texts, scores = batch.column("text").to_pylist(), []
            for k in range(0, len(texts), CHUNK_TEXTS):
                part = texts[k : k + CHUNK_TEXTS]
                scores.append(sent.value.scores(term_counts(part)[: len(part)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.concatenate([[], *scores]))], names=["row", "score"]
            )

    out = T.StructType([T.StructField("row", T.StructType(kept)), T.StructField("score", T.DoubleType())])
    scored = docs.select(row.alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(run, out)
    return scored.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
