"""Token counts with a whole-token shortcut.

Most pre-tokens of a text are strings that the vocabulary holds whole. Which vocabulary strings encode
alone as one token is proved once, offline, by encoding every one of them with the library
(``whole_tokens``); the proven set, bounded by the vocabulary, goes to the workers. A text is normalised and
cut into pre-tokens, a pre-token of the set counts one without any merging, and only the rest goes through
the merges, each distinct one once as long as a worker remembers it (``REMEMBERED``). A pre-token is encoded by
itself, whatever stands around it, so the sum is what the library gives for the whole text.

The fast way of normalising and cutting is Python's, for texts within ``PLAIN``: letters below U+0250 and
common punctuation, where every version of Unicode agrees. Any other text is normalised and cut by the
library's own parts. Strings of special tokens inside a text are one token each, before anything
else, as the library does by default; they are never added, and nothing is cut off or padded.

Defined cases: a null or empty text has no bytes and no tokens. Bytes that are not UTF-8 count as they are
stored, and are read as U+FFFD. Texts of any length are whole; pre-tokens are taken from about ``TOGETHER``
characters at once. Repeated rows are counted one by one. The counts are columns, so names of other
columns never matter, and a null limit flags nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pre-tokens beyond the proven ones whose counts a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Characters of a text that are cut into pre-tokens at once.
TOGETHER = 1_000_000

_END_OF_WORD = "</w>"
_PLAIN_RANGES = ((0x09, 0x0E), (0x20, 0x7F), (0xA0, 0x250), (0x2010, 0x2028), (0x2030, 0x205F))
PLAIN = [chr(c) for low, high in _PLAIN_RANGES for c in range(low, high)]


@cache
def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


def whole_tokens(path: str) -> list[str]:
    """Strings of the vocabulary that the library encodes, alone, as just their own one token."""
    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    strings, ids = [], []
    for piece, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if not piece.endswith(_END_OF_WORD):
            continue  # a pre-token always ends a word
        raw = bytes(letters[c] for c in piece.removesuffix(_END_OF_WORD))
        try:
            strings.append(raw.decode("utf-8"))
        except UnicodeDecodeError:
            continue
        ids.append(number)
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return sorted(
        s
        for s, number, found in zip(strings, ids, encoded)
        if found.ids == [number] and [s] == _pre_tokens(tokenizer, s)
    )


def _pre_tokens(tokenizer: Tokenizer, text: str) -> list[str]:
    """Pre-tokens of a text by the library's own parts, as text again."""
    letters = _byte_letters()
    whole = tokenizer.normalizer.normalize_str(text)
    parts = tokenizer.pre_tokenizer.pre_tokenize_str(whole)
    return [bytes(letters[c] for c in part).decode("utf-8") for part, _ in parts]


class Counter:
    """Counts tokens of texts for one tokenizer file and its proven whole tokens."""

    def __init__(self, path: str, whole: list[str]):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.whole = self.tokenizer.model, whole
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.known = dict.fromkeys(whole, 1)
        lowered = {c for x in PLAIN for c in x.lower()}
        kind = {c: unicodedata.category(c)[0] for c in lowered}
        letter, digit = ("".join(sorted(map(re.escape, (c for c in kind if kind[c] == k)))) for k in "LN")
        space = "".join(c for c in sorted(lowered) if c.isspace())
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{re.escape(space)}{letter}{digit}]+"
        ).findall
        self.plain = re.compile(f"[{''.join(map(re.escape, PLAIN))}]*").fullmatch
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        special.sort(key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self._check()

    def _check(self) -> None:
        """The fast way is written for one kind of file; another kind is an error, not another count."""
        for sample in ("It's 12 o'clock: ÀÉÎ-õß ĳ ǅ½²…we'LL \t\n go—ok_", "'tis x'ss 3a '' İı"):
            if self.cut(sample.lower()) != _pre_tokens(self.tokenizer, sample):
                raise ValueError("the tokenizer normalises or cuts texts in another way")

    def merged(self, part: str) -> int:
        """Tokens of a pre-token by the merges of the model."""
        return len(self.model.tokenize("".join(map(self.letters.__getitem__, part.encode("utf-8")))))

    def _count(self, parts: list[str]) -> int:
        counts = list(map(self.known.get, parts))
        if None not in counts:
            return sum(counts)
        if len(self.known) > REMEMBERED + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
        known, total = self.known, 0
        for part, count in zip(parts, counts):
            if count is None:
                count = known.get(part)
                if count is None:
                    count = known[part] = self.merged(part)
            total += count
        return total

    def _stretch(self, text: str) -> int:
        """Tokens of a stretch without special tokens."""
        if not self.plain(text):
            return self._count(_pre_tokens(self.tokenizer, text))
        total, start = 0, 0
        while start < len(text):
            end = start + TOGETHER
            while end < len(text) and not text[end].isspace():  # white space ends every pre-token
                end += 1
            total += self._count(self.cut(text[start:end].lower()))
            start = end
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self._stretch(text)
        total, start = 0, 0
        for found in self.special.finditer(text):
            total += self._stretch(text[start : found.start()]) + 1
            start = found.end()
        return total + self._stretch(text[start:] if start else text)


_COUNTERS: dict[tuple, Counter] = {}


def _counter(path: str, whole: list[str]) -> Counter:
    """The worker's counter, built once for its life."""
    key = (path, len(whole))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(path, whole)
    return _COUNTERS[key]


class TokenCounts:
    """Counts of one tokenizer file (a .json of lower-casing, word-ending, byte-level pairs)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.proven = whole_tokens(path)
        self.sent = spark.sparkContext.broadcast(self.proven)  # no larger than the vocabulary

    def tokens(self, text: Column) -> Column:
        """Number of tokens of each text."""
        path, sent = self.path, self.sent

        @F.arrow_udf("long")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            counter = _counter(path, sent.value)
            for batch in batches:
                texts = ((value.as_py() or b"").decode("utf-8", "replace") for value in batch)
                yield pa.array([counter.count(t) for t in texts], pa.int64())

        return counted(text.cast("binary"))

    def counted(self, df: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
        """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of ``text``; columns so named are replaced."""
        value = F.col(f"`{text}`")
        return df.withColumns(
            {"n_bytes": F.coalesce(F.octet_length(value), F.lit(0)).cast("long"), "n_tokens": self.tokens(value)}
        ).withColumn("over_limit", F.coalesce(F.col("n_tokens") > F.lit(limit), F.lit(False)))
