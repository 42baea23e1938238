"""An FM-index over a shard's word numbers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (small non-negative integers) in order.

    Prefix doubling: the first key packs as many symbols as fit, and later rounds sort only what
    is still tied.
    """
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    reach = 62 // bits
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(reach, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots, key = np.arange(n), key[order]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # The rank of a tied group is its first slot; groups keep their slots.
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        tied = ~(new & np.concatenate([new[1:], [True]]))
        slots = slots[tied]
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + reach, n)] + 1
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        reach *= 2


class _Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class _Wavelet:
    """Symbol ranks by a wavelet tree whose levels are stored one after the other."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level) & 1 == 1
            self.levels.append((level, _Bits(one), int((~one).sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` ends on the path of ``symbol``; differences are ranks."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def descend(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and the end of its own path."""
        symbol = np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            ones, own = bits.rank(i), bits.get(i) == 1
            symbol |= own.astype(np.int64) << level
            i = np.where(own, zeros + ones, i - ones)
        return symbol, i


class FMIndex:
    """Counts and locates phrases in ``text``, whose symbols are at least 1."""

    def __init__(self, text: np.ndarray, every: int = 8):
        text = np.concatenate([text, [0]])  # the end sorts first
        order = suffix_array(text)
        last = text[order - 1]
        bits = max(1, int(text.max()).bit_length())
        self.size, self.symbols = len(text), 1 << bits
        self.tree = _Wavelet(last, bits)
        counts = np.bincount(text, minlength=self.symbols)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        names = np.arange(self.symbols)
        self.shift = first - self.tree.follow(names, np.zeros(self.symbols, np.int64))
        sampled = order % every == 0
        self.sampled, self.samples = _Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of each phrase; row k of ``phrases`` holds lengths[k] symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            symbol = phrases[live, lengths[live] - 1 - step]
            known = symbol < self.symbols
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.tree.follow(symbol, low[live]) + self.shift[symbol]
            high[live] = self.tree.follow(symbol, high[live]) + self.shift[symbol]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: walk back to the next sampled suffix."""
        found, steps = np.empty(len(rows), np.int64), 0
        at, open_ = rows, np.arange(len(rows))
        while len(open_):
            done = self.sampled.get(at) == 1
            found[open_[done]] = self.samples[self.sampled.rank(at[done])] + steps
            at, open_ = at[~done], open_[~done]
            symbol, end = self.tree.descend(at)
            at, steps = end + self.shift[symbol], steps + 1
        return found
