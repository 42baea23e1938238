"""Byte-level BPE through a sentencepiece model that is written straight from the ranks.

A rank file gives byte strings with ranks 0, 1, 2, ... Each becomes one piece of a BPE model: its
bytes mapped to 256 distinct letters, its score the negative rank, so the best-scored merge is the one
of lowest rank; normalisation is the identity. A text is cut into pre-tokens by a pattern; a pre-token
that is itself in the vocabulary is that id, any other is encoded by the model. Decoding joins the byte
strings of the ids. Texts are independent of each other: no shuffle, and what a worker remembers
of encoded pre-tokens is bounded by ``REMEMBERED``.

Defined cases: a null or empty text has no ids, and no ids decode to empty bytes. Bytes that are not UTF-8
are read as U+FFFD, so the decoded bytes are those of the text so read. A null list of ids,
or one that holds a null or an id outside the vocabulary, decodes to null. Repeated rows
are coded one by one, ties of merges go to the leftmost. Other columns stay; one named like the result
is replaced.
"""

from __future__ import annotations

import base64
import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens whose ids a worker remembers before it starts anew.
REMEMBERED = 100_000
#: Characters of text that are cut into pre-tokens at once.
TOGETHER = 200_000

_LETTERS = {k: chr(256 + k) for k in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[k] for k in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, whole number or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_of(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece k is token k; the unknown piece comes last."""
    pieces = [
        _field(1, t.decode("latin-1").translate(_LETTERS).encode()) + _field(2, float(-k)) + _field(3, 1)
        for k, t in enumerate(tokens)
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, 2))
    none = (1 << 64) - 1  # -1
    trainer = (
        _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
        + _field(41, none) + _field(42, none) + _field(43, none)
    )
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Coder:
    """Encodes texts to ids and ids to bytes."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        self.tokens, self.serialised, self.pattern = tokens, model, pattern
        self.known: dict[str, bytes] = {}

    # What only encoding needs is built when it is first used.

    @cached_property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.serialised)

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def whole(self) -> dict[bytes, bytes]:
        return {t: struct.pack("<i", k) for k, t in enumerate(self.tokens)}

    def _learn(self, parts: list[str]) -> None:
        """Pack the ids of pre-tokens that are not known yet."""
        rest, mapped = [], []
        for part in parts:
            raw = part.encode("utf-8")
            whole = self.whole.get(raw)
            if whole is None:
                rest.append(part)
                mapped.append(raw.decode("latin-1").translate(_LETTERS))
            else:
                self.known[part] = whole
        for part, ids in zip(rest, self.model.encode(mapped, num_threads=1) if rest else []):
            self.known[part] = struct.pack(f"<{len(ids)}i", *ids)

    def _some(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        self._learn([p for p in {p for own in parts for p in own} if p not in known])
        return [b"".join(map(known.__getitem__, own)) for own in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed 32-bit ids of each text; pre-tokens of about ``TOGETHER`` characters at a time."""
        coded, some, size = [], [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= TOGETHER:
                coded += self._some(some)
                some, size = [], 0
        return coded + self._some(some)

    def decode(self, ids: np.ndarray) -> bytes | None:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.tokens):
            return None
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODERS: dict[int, Coder] = {}


def _coder(sent) -> Coder:
    """The worker's coder for a broadcast vocabulary, built once."""
    if sent.value[0] not in _CODERS:
        _CODERS.clear()
        _CODERS[sent.value[0]] = Coder(*sent.value[1:])
    return _CODERS[sent.value[0]]


class ByteBPE:
    """Column operators for one vocabulary file and one pattern."""

    def __init__(self, spark, path: str, pattern: str):
        tokens = read_ranks(path)
        key = hash((tuple(tokens), pattern))
        self.sent = spark.sparkContext.broadcast((key, tokens, model_of(tokens), pattern))

    def encode(
        self, df: DataFrame, text: str = "text", into: str = "ids", back: str | None = None
    ) -> DataFrame:
        """``df`` with the ids of ``text`` as array<int> in ``into``.

        With ``back`` the ids are decoded again in the same pass, into bytes of that name, so that a
        check of the round trip needs no second Python worker beside the first.
        """
        sent = self.sent

        def run(batches):
            coder = _coder(sent)
            for batch in batches:
                texts = [(v.as_py() or b"").decode("utf-8", "replace") for v in batch.column("value")]
                coded = coder.encode(texts)
                ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
                ids = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32))
                )
                columns = [batch.column("row"), ids]
                if back:
                    read = [coder.decode(np.frombuffer(c, "<i4")) for c in coded]
                    columns.append(pa.array(read, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", into, back][: len(columns)])
            coder.known.clear()  # the worker lives on, with other work to do

        value = F.col(f"`{text}`").cast("binary")
        made = [(into, T.ArrayType(T.IntegerType()))] + ([(back, T.BinaryType())] if back else [])
        return _mapped(df, value, made, run)

    def decode(self, df: DataFrame, ids: str = "ids", into: str = "decoded") -> DataFrame:
        """``df`` with the bytes of ``ids`` in ``into``."""
        sent = self.sent

        def run(batches):
            coder = _coder(sent)
            for batch in batches:
                lists = batch.column("value")
                values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths()
                ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
                texts = [
                    None if n is None else coder.decode(values[end - n : end])
                    for n, end in zip(sizes.to_pylist(), ends.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(texts, pa.binary())], names=["row", into]
                )

        return _mapped(df, F.col(f"`{ids}`"), [(into, T.BinaryType())], run)


def _mapped(df: DataFrame, value, made: list[tuple[str, T.DataType]], run) -> DataFrame:
    names = [name for name, _ in made]
    kept = [f for f in df.schema.fields if f.name not in names]
    if not kept:
        raise ValueError("the table needs a column besides the result")
    row = F.struct(*[F.col(f"`{f.name}`") for f in kept])
    out = T.StructType([T.StructField("row", T.StructType(kept)), *[T.StructField(*m) for m in made]])
    return df.select(row.alias("row"), value.alias("value")).mapInArrow(run, out).select("row.*", *names)
