"""Elias-Fano sequences and the n-gram levels that are made of them.

A level's bytes are written to an unlinked file and mapped into memory; queries are
vectors, and touch only the bytes that they need.
"""

from __future__ import annotations

import tempfile

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def _selects(value: int) -> list[int]:
    at = [i for i in range(8) if value >> i & 1]
    return at + [0] * (8 - len(at))


#: Position of the r-th one of a byte, and of the r-th zero.
_ONE_AT = np.array([_selects(b) for b in range(256)], dtype=np.int64)
_ZERO_AT = _ONE_AT[255 - np.arange(256)]
#: Step of the quantised logarithms; 0 stands for probability zero.
STEP = 12.0 / 65533


class Monotone:
    """A non-decreasing sequence of numbers below `universe`: the low bits as they are,
    the high bits as gaps in unary."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.size, self.low_bits, self.low, self.high = size, low_bits, low, high
        ones = np.cumsum(_ONES[high], dtype=np.int64)
        self.ones = np.concatenate(([0], ones))
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 8 - self.ones

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.int64)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        low = np.concatenate((low, np.zeros(8, dtype=np.uint8)))
        # A zero closes each high value, also the one after the last.
        length = n + int(universe >> low_bits) + 2
        unary = np.zeros(-(-length // 8) * 8, dtype=np.uint8)
        unary[(values >> low_bits) + np.arange(n)] = 1
        return n, low_bits, low, np.packbits(unary, bitorder="little")

    def _select(self, ranks: np.ndarray, totals: np.ndarray, table: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(totals, ranks, side="right") - 1
        return byte * 8 + table[self.high[byte], ranks - totals[byte]]

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.int64)
        bit = at * self.low_bits
        found = np.zeros(len(at), dtype=np.uint64)
        for i in range(8):
            found |= self.low[(bit >> 3) + i].astype(np.uint64) << np.uint64(8 * i)
        return ((found >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values by position."""
        index = np.asarray(index, dtype=np.int64)
        return ((self._select(index, self.ones, _ONE_AT) - index) << self.low_bits) | self.lows(index)

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value at or above each target, and whether it is equal."""
        targets = np.asarray(targets, dtype=np.int64)
        high = targets >> self.low_bits
        low = targets & ((1 << self.low_bits) - 1)
        # Values with this high part lie between two zeros of the unary code.
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, _ZERO_AT) - high + 1, 0)
        end = self._select(high, self.zeros, _ZERO_AT) - high
        left, right = begin.copy(), end.copy()
        while (open_ := left < right).any():
            at = np.flatnonzero(open_)
            middle = (left[at] + right[at]) >> 1
            less = self.lows(middle) < low[at]
            left[at[less]] = middle[less] + 1
            right[at[~less]] = middle[~less]
        equal = left < end
        equal[equal] = self.lows(left[equal]) == low[equal]
        return left, equal


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = 1 + np.rint(-np.log10(p) / STEP)
    return np.where(p > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) * STEP), 0.0)


class Trie:
    """Contexts and, below each, the words that follow it with quantised probabilities.

    contexts  sorted keys of the first level
    words     sorted keys of all following words; a word's number is its place
    pointers  Elias-Fano: where each context's words begin in the second level
    follows   Elias-Fano: word number plus context number times the count of words,
              which rises through the whole level, so that one successor search
              relative to the context's base finds a word among its own
    codes     16-bit logarithms, mass: the share left to the lower order
    """

    def __init__(self, contexts, words, context_of, word_of, prob, mass):
        """context_of and word_of number each entry's context and word, sorted by both."""
        self.n_words = max(1, len(words))
        n = len(contexts)
        pointers = np.searchsorted(context_of, np.arange(n + 1))
        follows = Monotone.encode(context_of * self.n_words + word_of, max(1, n * self.n_words))
        starts = Monotone.encode(pointers, len(context_of) + 1)
        parts = [contexts, words, starts[2], starts[3], follows[2], follows[3], quantised(prob), mass.astype(np.float32)]
        self.file = tempfile.TemporaryFile()
        places = []
        for part in parts:
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append((self.file.tell(), part.dtype, len(part)))
            self.file.write(np.ascontiguousarray(part).tobytes())
        self.file.flush()
        mapped = [
            np.memmap(self.file, dtype=d, mode="r", offset=o, shape=(k,)) if k else np.empty(0, dtype=d)
            for o, d, k in places
        ]
        self.contexts, self.words, low, high, low2, high2, self.codes, self.mass = mapped
        self.pointers = Monotone(starts[0], starts[1], low, high)
        self.follows = Monotone(follows[0], follows[1], low2, high2)

    def close(self) -> None:
        self.file.close()

    def context_numbers(self, keys: np.ndarray) -> np.ndarray:
        """-1: unknown."""
        return _places(self.contexts, keys)

    def find(self, context: np.ndarray, word_keys: np.ndarray) -> np.ndarray:
        """Codes of words after contexts, given by number; 0 if unseen."""
        out = np.zeros(len(context), dtype=np.uint16)
        word = _places(self.words, word_keys)
        ask = np.flatnonzero((context >= 0) & (word >= 0))
        if len(ask):
            place, equal = self.follows.successor(context[ask] * self.n_words + word[ask])
            inside = equal & (place >= self.pointers.at(context[ask])) & (place < self.pointers.at(context[ask] + 1))
            out[ask[inside]] = self.codes[place[inside]]
        return out


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)
