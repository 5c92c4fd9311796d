"""Counting quotient filters over packed word-id n-grams, as arrays.

An n-gram of n ids of `bits` bits is one number of n * bits bits. An invertible
permutation (Feistel rounds) spreads these numbers evenly. The leading bits of a
permuted number are its quotient and say in which run of the filter it stands; the
rest is its remainder, which the run keeps in full. Nothing is lost: quotient and
remainder give back the number, and the inverse permutation the ids.

In memory a filter is (left, right, counts): the permuted number's two halves, sorted
and distinct, with their counts. Sorted filters are merged by adding equal entries.
"""

from __future__ import annotations

import struct

import numpy as np

_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_HEAD = struct.Struct("<HHHqqqq")
#: Counts from here on don't fit one byte.
_LARGE = 255


def halves(width: int) -> tuple[int, int]:
    """Bits of the left and the right half of a number."""
    return width - width // 2, width // 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def pack(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of ids for each place of the n-gram -> the permuted number's halves."""
    width = bits * len(columns)
    lb, rb = halves(width)
    left = np.zeros(len(columns[0]), dtype=np.uint64)
    right = left.copy()
    for i, ids in enumerate(reversed(columns)):
        ids, at = ids.astype(np.uint64), i * bits
        if at < rb:
            right |= (ids << np.uint64(at)) & _mask(rb)
        if at + bits > rb:
            left |= ids << np.uint64(at - rb) if at >= rb else ids >> np.uint64(rb - at)
    for i, key in enumerate(_KEYS):
        if i % 2:
            right ^= _mixed(left, key) & _mask(rb)
        else:
            left ^= _mixed(right, key) & _mask(lb)
    return left, right


def unpack(left: np.ndarray, right: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """The inverse of `pack`."""
    lb, rb = halves(bits * n)
    left, right = left.copy(), right.copy()
    for i, key in reversed(list(enumerate(_KEYS))):
        if i % 2:
            right ^= _mixed(left, key) & _mask(rb)
        else:
            left ^= _mixed(right, key) & _mask(lb)
    columns = []
    for i in range(n):
        at = i * bits
        ids = np.zeros(len(left), dtype=np.uint64)
        if at < rb:
            ids |= right >> np.uint64(at)
        if at + bits > rb:
            ids |= left >> np.uint64(at - rb) if at >= rb else left << np.uint64(rb - at)
        columns.append((ids & _mask(bits)).astype(np.int64))
    return columns[::-1]


def place(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """A number of `bits` bits for each entry, for sets that are kept as bit maps."""
    return (_mixed(left ^ _mixed(right, _KEYS[0]), _KEYS[1]) >> np.uint64(64 - bits)).astype(np.int64)


def counted(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, width: int):
    """Sorts entries and adds the counts (None: 1 each) of equal ones."""
    lb, rb = halves(width)
    if width <= 64:
        key = (left << np.uint64(rb)) | right
        if counts is None:
            key, counts = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = _summed([key[order]], counts[order])
            key = key[0]
        return key >> np.uint64(rb), key & _mask(rb), counts.astype(np.int64)
    order = np.lexsort((right, left))
    counts = np.ones(len(left), dtype=np.int64) if counts is None else counts[order]
    (left, right), counts = _summed([left[order], right[order]], counts)
    return left, right, counts


def _summed(lanes: list[np.ndarray], counts: np.ndarray):
    if not len(counts):
        return lanes, counts
    new = np.ones(len(counts), dtype=bool)
    new[1:] = np.any([lane[1:] != lane[:-1] for lane in lanes], axis=0)
    starts = np.nonzero(new)[0]
    return [lane[starts] for lane in lanes], np.add.reduceat(counts, starts)


def merged(filters: list[tuple], width: int):
    """One filter of several sorted ones; equal entries add up."""
    return counted(*(np.concatenate([f[i] for f in filters]) for i in range(3)), width)


def shards(filter_: tuple, width: int, depth: int):
    """(shard, its part of the filter): a shard has one value of the number's first
    `depth` bits, so it is a range of the sorted filter."""
    left = filter_[0]
    shift = np.uint64(halves(width)[0] - depth)
    of = left >> shift
    edges = np.concatenate(([0], np.nonzero(of[1:] != of[:-1])[0] + 1, [len(of)])) if len(of) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(of[a]), tuple(x[a:b] for x in filter_)


def dumps(filter_: tuple, width: int, depth: int) -> bytes:
    """A shard's bytes: the runs in unary (one bit per quotient and per entry), then
    whole remainders, then counters of one byte, large ones apart."""
    left, right, counts = filter_
    lb, rb = halves(width)
    q = min(lb, depth + max(0, int(len(left) - 1).bit_length()))
    quotient = (left >> np.uint64(lb - q)).astype(np.int64)
    first, last = int(quotient[0]), int(quotient[-1])
    runs = np.zeros(last - first + 1 + len(left), dtype=np.uint8)
    runs[quotient - first + np.arange(len(left))] = 1
    large = counts >= _LARGE
    small = np.where(large, _LARGE, counts).astype(np.uint8)
    parts = [
        np.packbits(runs).tobytes(), _bytes_of(left & _mask(lb - q), lb - q), _bytes_of(right, rb),
        small.tobytes(), counts[large].astype("<i8").tobytes(),
    ]
    return _HEAD.pack(width, depth, q, first, len(runs), len(left), int(large.sum())) + b"".join(parts)


def loads(data: bytes) -> tuple:
    width, _, q, first, n_runs, n, n_large = _HEAD.unpack_from(data)
    lb, rb = halves(width)
    at = _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, dtype=np.uint8, count=size, offset=at - size)

    runs = np.unpackbits(take((n_runs + 7) // 8), count=n_runs)
    quotient = np.nonzero(runs)[0] - np.arange(n) + first
    low = _number(take(n * _size(lb - q)), lb - q, n)
    right = _number(take(n * _size(rb)), rb, n)
    counts = take(n).astype(np.int64)
    counts[counts == _LARGE] = take(8 * n_large).view("<i8") if n_large else 0
    return (quotient.astype(np.uint64) << np.uint64(lb - q)) | low, right, counts


def _size(bits: int) -> int:
    return (bits + 7) // 8


def _bytes_of(x: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _size(bits)]).tobytes()


def _number(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : _size(bits)] = data.reshape(n, _size(bits))
    return out.reshape(-1).view("<u8").astype(np.uint64)
