"""Fuzzy line deduplication by MinHash.

A line's signature has the minima of BANDS x ROWS hash functions over its character
shingles. Lines that agree in all ROWS minima of a band meet in a bucket; at the
similarity threshold of 0.8, 99.7 of 100 pairs do. Candidates are verified by exact
Jaccard similarity of the shingle sets, distributed union-find makes components of
the links, and each component keeps its first line.

Signatures are made where documents are read, one per line and batch. Band values and minima
move as packed arrays, and only what shares a bucket becomes rows: pairs that are alike, and
members of buckets that have many of them. Lines that share a bucket by chance, whose number
grows with the square of a table, go there. Candidates that agree in less than LEAST_EQUAL of
the 24 minima, by five bits, are not alike: of pairs at the threshold 1 in 1 000. Texts move
once, for lines that still are candidates. Lines are known by a 64-bit hash of their
normalised text.

Where a bucket holds a crowd of unlike lines (one template, many fillings), its lines meet
if they share one of their n - ceil(0.8 n) + 1 rarest shingles, which every two lines at
the threshold do: see finer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsift.llm import common, linking

SHINGLE = 7
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
#: Minima, of BANDS * ROWS, in which a candidate pair must agree by five bits.
LEAST_EQUAL = 14
#: Shorter lines, normalised, are left alone: blank ones.
LEAST_CHARS = 1
#: Characters of pairs that are compared at a time, and bits of the cells that rule pairs out.
PAIR_CHARS = 1 << 20
PAIR_BITS = 12
#: Characters that are hashed at a time.
CHUNK = 1 << 17
#: Counters of shingles, by their leading bits, that put shingles in order of rarity.
CELL_BITS = 18
OUT = "line_no int, key long, bands binary, m0 long, m1 long"
#: Bytes of a band's value that are kept; its lines are verified anyway.
BAND_BYTES = 5
#: Lines of a bucket up to which all pairs are listed, those up to which alike ones are sought,
#: and how many of these a line there may be in a larger bucket than FEW.
FEW, EACH, SPARSE = 16, 1 << 13, 2
#: Parts of the bands that are dealt to buckets one after the other, so that less moves at a time.
PASSES = 2
#: Band values of a shard, about.
SHARD = 1 << 18
#: Bits of the filter of lines that are asked for, and bits of one of its pieces.
FILTER_BITS, PIECE_BITS = 26, 16

_random = np.random.default_rng(5)
_A = _random.integers(1 << 29, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = np.int64(sum(1 << (5 * i) for i in range(12)))


def normal(line: str) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join(line.lower().split())


def line_key(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines, and where each line's begin. A line
    shorter than a shingle is one shingle; no line is empty."""
    joined = "\n".join(line.ljust(SHINGLE, "\n") for line in lines) + "\n" * SHINGLE
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(codes) - SHINGLE + 1, dtype=np.uint64)
    high = np.empty_like(h)
    for i in range(SHINGLE):
        h += codes[i : i + len(h)]
        h *= _MIX
        h ^= np.right_shift(h, np.uint64(29), out=high)
    lengths = np.array([max(len(line), SHINGLE) for line in lines])
    counts = lengths - SHINGLE + 1
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.arange(counts.sum()) + np.repeat(begins - starts, counts)
    return h[at], starts


def signatures(lines: list[str]) -> np.ndarray:
    """A row of BANDS values per line, and two with five bits of each minimum."""
    hashes, starts = shingle_hashes(lines)
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    bands = np.zeros((len(lines), BANDS + 2), dtype=np.uint64)
    for band in range(BANDS):
        value = np.full(len(lines), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, band * ROWS + ROWS):
            low = np.minimum.reduceat(hashes * _A[i], starts)
            value = (value ^ low.astype(np.uint64)) * _MIX
            value ^= value >> np.uint64(31)
            few = ((low * np.uint32(0x9E3779B1)) >> np.uint32(27)).astype(np.uint64)
            bands[:, BANDS + i // 12] |= few << np.uint64(5 * (i % 12))
        bands[:, band] = value
    return bands.view(np.int64)


def equal_minima(a: Column, b: Column) -> Column:
    """In how many of twelve five-bit fields two numbers agree."""
    y = a.bitwiseXOR(b)
    any_bit = y
    for shift in range(1, 5):
        any_bit = any_bit.bitwiseOR(F.shiftright(y, shift))
    return F.lit(12) - F.bit_count(any_bit.bitwiseAND(F.lit(sum(1 << (5 * i) for i in range(12)))))


def shingle_set(s: str) -> set[str]:
    return {s[i : i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1))}


def are_similar(x: set, y: set) -> bool:
    """Jaccard similarity of at least SIMILARITY; the sizes alone rule most pairs out."""
    few, many = sorted((len(x), len(y)))
    if few < SIMILARITY * many:
        return False
    both = len(x & y)
    return both >= SIMILARITY * (few + many - both)


def jaccard(a: str, b: str) -> float:
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def cells_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: a bit set of the cells that its shingles' hashes fall into, how many
    cells those are, and how many shingles, repeats included."""
    hashes, starts = shingle_hashes(lines)
    counts = np.diff(np.append(starts, len(hashes)))
    bits = np.zeros((len(lines), 1 << PAIR_BITS), dtype=bool)
    bits[np.repeat(np.arange(len(lines)), counts), (hashes >> np.uint64(64 - PAIR_BITS)).astype(np.int64)] = True
    cells = np.packbits(bits, axis=1).view(np.uint64)
    return cells, np.bitwise_count(cells).sum(axis=1, dtype=np.int64), counts


def may_be_similar(a: np.ndarray, b: np.ndarray, sketches: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """False for pairs of lines (their places in sketches) that can't be similar.

    A line has a different shingle for each of its cells, and some more at most. Two share
    at most one for each common cell, and the lesser number of more ones; the more of these
    both have, the more similar they may be. 9 / 4 of what is shared must be both sizes.
    """
    cells, used, counts = sketches
    shared = np.bitwise_count(cells[a] & cells[b]).sum(axis=1, dtype=np.int64)
    more = np.minimum(counts[a] - used[a], counts[b] - used[b])
    return 9 * (shared + more) >= 4 * (used[a] + used[b] + 2 * more)


@F.pandas_udf(T.BooleanType())
def _similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        for_pair = (a.str.len() + b.str.len() + (1 << PAIR_BITS) // 16).cumsum().to_numpy() // PAIR_CHARS
        yield pd.Series(
            np.concatenate([_judged(a[for_pair == x], b[for_pair == x]) for x in np.unique(for_pair)]) if len(a) else [],
            dtype=bool,
        )


def _judged(a: pd.Series, b: pd.Series) -> np.ndarray:
    place, lines = pd.factorize(pd.concat([a, b]))
    lines = list(lines)
    left, right = place[: len(a)], place[len(a) :]
    out = may_be_similar(left, right, cells_of(lines))
    sets: dict[int, set] = {}
    for i in np.flatnonzero(out):
        x, y = (sets.get(at) or sets.setdefault(at, shingle_set(lines[at])) for at in (left[i], right[i]))
        out[i] = are_similar(x, y)
    return out


def occurrences(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, text -> a row per line: _doc (identity of the row), line_no, key and, once
    per batch and line, bands (BAND_BYTES each) and bits of the minima. Blank lines have no
    key. A line shorter than a shingle is similar to its equals alone, which its key tells,
    and has no bands."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: set[int] = set()
            waiting: list[tuple] = []
            chars = 0
            for doc_id, doc, text in zip(batch["doc_id"], batch["_doc"], batch["text"], strict=True):
                for no, raw in enumerate((text or "").split("\n")):
                    line = normal(raw)
                    if len(line) < LEAST_CHARS:
                        waiting.append((doc_id, doc, no, None, None))
                    else:
                        key = line_key(line)
                        fresh = len(line) >= SHINGLE and key not in seen
                        seen.add(key)
                        chars += len(line) * fresh
                        waiting.append((doc_id, doc, no, key, line if fresh else None))
                if chars >= CHUNK:
                    yield _made(waiting, batch)
                    waiting, chars = [], 0
            if waiting:
                yield _made(waiting, batch)

    return docs.select("doc_id", "_doc", "text").mapInPandas(read, f"doc_id {kind}, _doc long, {OUT}")


def _made(waiting: list[tuple], batch: pd.DataFrame) -> pd.DataFrame:
    fresh = [i for i, w in enumerate(waiting) if w[4] is not None]
    bands = np.full(len(waiting), None, dtype=object)
    minima, none = np.zeros((len(waiting), 2), dtype=np.int64), np.ones(len(waiting), dtype=bool)
    if fresh:
        made = signatures([waiting[i][4] for i in fresh])
        few = np.ascontiguousarray(made[:, :BANDS]).view(np.uint8).reshape(len(fresh), BANDS, 8)[:, :, :BAND_BYTES].tobytes()
        width = BANDS * BAND_BYTES
        bands[fresh] = [few[i : i + width] for i in range(0, len(few), width)]
        minima[fresh], none[fresh] = made[:, BANDS:], False
    return pd.DataFrame(
        {
            "doc_id": pd.Series([w[0] for w in waiting], dtype=batch["doc_id"].dtype),
            "_doc": [w[1] for w in waiting],
            "line_no": [w[2] for w in waiting],
            "key": pd.array([w[3] for w in waiting], dtype="Int64"),
            "bands": bands,
            "m0": pd.arrays.IntegerArray(minima[:, 0].copy(), none),
            "m1": pd.arrays.IntegerArray(minima[:, 1].copy(), none),
        }
    )


def shared_buckets(rows: DataFrame, shards: int, of: range = range(BANDS)) -> DataFrame:
    """rows (key, bands, and m0, m1 or not) -> bucket, a, b: every two different lines of a
    bucket of at most FEW, and of larger ones each line once, with b null.

    With minima, which move beside the keys, only pairs that are alike are listed, and those
    of buckets of up to EACH lines, unless a bucket has more than SPARSE of them a line: its
    lines are copies or one template. ``of``: the bands that are dealt.
    """
    columns = ["key", "bands"] + [c for c in ("m0", "m1") if c in rows.columns]
    numbers = [c for c in columns if c != "bands"]
    most = EACH if len(numbers) == 3 else FEW

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            few = np.frombuffer(b"".join(batch["bands"]), dtype=np.uint8).reshape(-1, BANDS, BAND_BYTES)
            few = few[:, of.start : of.stop].reshape(-1, BAND_BYTES)
            each = {c: np.repeat(batch[c].to_numpy(dtype=np.int64), len(of)) for c in numbers}
            shard = (_wide(few) % shards).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            found, begins = np.unique(shard[order], return_index=True)
            parts = np.split(order, begins[1:]) if len(order) else []
            packed = {c: [v[i].tobytes() for i in parts] for c, v in each.items()}
            yield pd.DataFrame({"shard": found, "buckets": [few[i].tobytes() for i in parts]} | packed)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = _wide(np.frombuffer(b"".join(rows["buckets"]), dtype=np.uint8).reshape(-1, BAND_BYTES))
        key, *minima = (np.frombuffer(b"".join(rows[c]), dtype=np.int64) for c in numbers)
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
        bucket, key, minima = bucket[fresh], key[fresh], [m[order][fresh] for m in minima]
        _, begins, place, n = np.unique(bucket, return_index=True, return_inverse=True, return_counts=True)
        crowded = n > most
        left, right = _pairs_within(place, begins, n, crowded, minima)
        members = crowded[place]
        out = [
            (bucket[members], key[members], np.zeros(members.sum(), dtype=np.int64), np.ones(members.sum(), dtype=bool)),
            (bucket[left], key[left], key[right], np.zeros(len(left), dtype=bool)),
        ]
        bucket, a, b, none = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"bucket": bucket, "a": a, "b": pd.arrays.IntegerArray(b, none)})

    return (
        rows.select(columns).mapInPandas(dealt, "shard long, buckets binary, " + ", ".join(f"{c} binary" for c in numbers))
        .groupBy("shard").applyInPandas(meet, "bucket long, a long, b long")
    )


def _pairs_within(
    place: np.ndarray, begins: np.ndarray, n: np.ndarray, crowded: np.ndarray, minima: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """The rows of every two lines of a bucket that is not crowded, alike ones if there are
    minima. Buckets (rows from begins on, n of them) where those are many become crowded."""
    rank = np.arange(len(place)) - begins[place]
    listed = np.zeros(len(n), dtype=np.int64)
    limit = np.where(n > FEW, SPARSE * n, np.iinfo(np.int64).max)
    alive, out = np.flatnonzero(~crowded[place]), [(np.zeros(0, dtype=np.int64),) * 2]
    step = 0
    while len(alive):
        step += 1
        alive = alive[rank[alive] + step < n[place[alive]]]
        a = alive
        if minima:
            a = a[_agreeing(a, a + step, minima) >= LEAST_EQUAL]
        out.append((a, a + step))
        np.add.at(listed, place[a], 1)
        full = place[a][listed[place[a]] > limit[place[a]]]
        if len(full):
            crowded[full] = True
            alive = alive[~crowded[place[alive]]]
    left, right = (np.concatenate(x) for x in zip(*out, strict=True))
    kept = ~crowded[place[left]]
    return left[kept], right[kept]


def _agreeing(a: np.ndarray, b: np.ndarray, minima: list[np.ndarray]) -> np.ndarray:
    """In how many of their five-bit fields, twelve in each of the minima, rows agree."""
    other = np.zeros(len(a), dtype=np.uint8)
    for m in minima:
        y = m[a] ^ m[b]
        y |= y >> 1 | y >> 2
        other += np.bitwise_count((y | y >> 2) & _FIELDS)
    return 12 * len(minima) - other.astype(np.int64)


def _wide(few: np.ndarray) -> np.ndarray:
    """Rows of BAND_BYTES bytes as numbers."""
    wide = np.zeros((len(few), 8), dtype=np.uint8)
    wide[:, :BAND_BYTES] = few
    return wide.view(np.int64).ravel()


def _asked_bits(keys: DataFrame) -> np.ndarray:
    """A filter of keys (key): the bit of each one's leading FILTER_BITS bits, in bytes."""

    def gather(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for batch in rows:
            place = _filter_place(batch["key"].to_numpy(dtype=np.int64))
            np.bitwise_or.at(bits, place >> 3, np.uint8(128) >> (place & 7).astype(np.uint8))
        pieces = bits.reshape(-1, 1 << (PIECE_BITS - 3))
        used = np.flatnonzero(pieces.any(axis=1))
        yield pd.DataFrame({"piece": used, "bits": [pieces[i].tobytes() for i in used]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        either = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in rows["bits"]])
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "bits": [either.tobytes()]})

    found = keys.mapInPandas(gather, "piece long, bits binary").groupBy("piece").applyInPandas(merge, "piece long, bits binary")
    bits = np.zeros((1 << (FILTER_BITS - PIECE_BITS), 1 << (PIECE_BITS - 3)), dtype=np.uint8)
    for r in found.toLocalIterator():
        bits[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits.ravel()


def _filter_place(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, line: normalised lines of docs whose key is one of keys (key). Others go where
    they are read, as far as the filter tells; those that it lets pass go in the join."""
    bits = docs.sparkSession.sparkContext.broadcast(_asked_bits(keys))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[int, str] = {}
            for text in batch["text"]:
                for raw in (text or "").split("\n"):
                    line = normal(raw)
                    if len(line) >= SHINGLE:
                        found[line_key(line)] = line
                if len(found) >= 5_000:
                    yield asked(found)
                    found = {}
            yield asked(found)

    def asked(found: dict[int, str]) -> pd.DataFrame:
        key = np.fromiter(found, dtype=np.int64, count=len(found))
        place = _filter_place(key)
        kept = (bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        line = np.array([*found.values(), None], dtype=object)[:-1]
        return pd.DataFrame({"key": key[kept], "line": line[kept]})

    return docs.select("text").mapInPandas(read, "key long, line string").join(keys, "key", "left_semi")


def _in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with a line, a few at a time: about CHUNK characters, at least one row."""
    for batch in batches:
        yield from (part for _, part in batch.groupby(batch["line"].str.len().cumsum() // CHUNK))


def _shingle_counts(lines: DataFrame) -> np.ndarray:
    """How often lines (line) have shingles of each cell; 2 ** CELL_BITS numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for part in _in_chunks(batches):
            counts += np.bincount(_cells(shingle_hashes(list(part["line"]))[0]), minlength=len(counts))
        cell = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": cell, "n": counts[cell]})

    counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
    rows = lines.select("line").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["cell"].to_numpy(dtype=np.int64)] = rows["n"]
    return counts


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def finer(active: DataFrame, lines: DataFrame, minima: DataFrame) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """active (node, own, ...), lines (key, line), minima (key, m0, m1) -> members of other
    buckets, one per shingle of a line's prefix, and their test.

    Shingles have one order, rarest cell first, then by hash. With sizes a and b, two lines
    of a Jaccard similarity of 0.8 share 4 (a + b) / 9 shingles. So they share one of
    the first n - ceil(4 n / 5) + 1 of each, and from the first one on, at places i and j, at
    most min(a - i, b - j). The order decides how many meet, never whether links are found.
    A line in several crowded buckets is written down once for all of them.
    """
    asked = active.groupBy(F.col("node").alias("key")).agg(F.first("own").alias("own"))
    texts = common.stored(asked.join(minima, "key").join(lines, "key"), "crowded")
    counts = active.sparkSession.sparkContext.broadcast(_shingle_counts(texts))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _in_chunks(batches):
            hashes, starts = shingle_hashes(list(part["line"]))
            found, at, sizes = [], [], []
            for own in np.split(hashes, starts[1:]):
                own = np.unique(own)
                n = len(own)
                first = own[np.argsort(counts.value[_cells(own)], kind="stable")][: n - -(-4 * n // 5) + 1]
                found.append(first.view(np.int64))
                at.append(np.arange(len(first)))
                sizes.append(n)
            repeats = [len(f) for f in found]
            of_line = {c: np.repeat(part[p].to_numpy(), repeats) for c, p in (("node", "key"), ("own", "own"), ("m0", "m0"), ("m1", "m1"))}
            yield pd.DataFrame(
                of_line | {"shingle": np.concatenate(found), "at": np.concatenate(at), "size": np.repeat(sizes, repeats)}
            )[["node", "own", "m0", "m1", "shingle", "at", "size"]]

    def close(a: Column, b: Column) -> Column:
        both = F.least(a["size"] - a["at"], b["size"] - b["at"])
        return (9 * both >= 4 * (a["size"] + b["size"])) & alike(a, b)

    spelt = texts.mapInPandas(prefixes, "node long, own long, m0 long, m1 long, shingle long, at long, size long")
    members = common.stored(
        spelt.select(
            F.col("shingle").alias("bucket"), "node", "own", F.struct("size", "at", "m0", "m1").alias("sig"),
            F.lit(True).alias("indexed"),
        ),
        "finer",
    )
    common.discard(texts)
    return members, close


def alike(a: Column, b: Column) -> Column:
    """Whether the minima of two signatures (m0, m1) agree as those of candidates do."""
    return sum(equal_minima(a[m], b[m]) for m in ("m0", "m1")) >= LEAST_EQUAL


def line_classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, _doc, line_no, class_id, keep: a row per line.

    A class is a component of lines of a similarity of 0.8 or more, its class_id the
    smallest key in it. The class keeps its line in the smallest doc_id (null last),
    text, and line number. Blank lines have a null class and are kept. Rows of equal
    doc_id and text are one document, and each shows the same lines as kept. A null
    text has one empty line.
    """
    return _classes(docs)[0]


def _classes(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """line_classes, and the stored tables that it reads."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_doc"))
    rows = common.stored(occurrences(docs, dict(docs.dtypes)["doc_id"]), "lines")
    signed = rows.filter("bands is not null")
    width = BANDS // PASSES
    shards = max(1, -(-signed.count() * width // SHARD))
    dealt = [
        common.stored(shared_buckets(signed.select("key", "bands", "m0", "m1"), shards, range(i, i + width)), "buckets")
        for i in range(0, BANDS, width)
    ]
    found = reduce(DataFrame.union, dealt)
    crowded = found.filter("b is null").select(F.col("a").alias("key")).distinct()
    minima = common.stored(
        signed.select("key", "m0", "m1").join(crowded, "key", "left_semi").dropDuplicates(["key"]), "minima"
    )
    sig = F.struct("m0", "m1")
    pairs = common.stored(
        found.filter("b is not null").select(F.col("a").alias("node"), F.col("b").alias("pivot")).distinct(), "close"
    )
    members = common.stored(
        found.filter("b is null").select("bucket", F.col("a").alias("node"))
        .join(minima.select(F.col("key").alias("node"), sig.alias("sig")), "node")
        .select("bucket", "node", "sig", F.lit(True).alias("indexed")),
        "members",
    )
    common.discard(*dealt)
    asked = common.stored(
        members.select(F.col("node").alias("key")).union(pairs.select("node")).union(pairs.select("pivot")).distinct(), "asked"
    )
    lines = common.stored(_texts(docs, asked).groupBy("key").agg(F.first("line").alias("line")), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(lines.select(F.col("key").alias("a"), F.col("line").alias("line_a")), "a")
        both = with_a.join(lines.select(F.col("key").alias("b"), F.col("line").alias("line_b")), "b")
        return both.filter(_similar(F.col("line_a"), F.col("line_b")))

    links = linking.linked(members, verify, alike, pairs, lambda active: finer(active, lines, minima))
    found = linking.components(links)
    common.discard(members, minima, pairs, asked, lines, links)
    blank = rows.filter("key is null").select(
        "doc_id", "_doc", "line_no", F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("keep")
    )
    named = rows.filter("key is not null").drop("bands", "m0", "m1").join(
        found.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("class_id", F.coalesce("component", "key"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_doc").alias("text"), F.col("line_no").alias("no"))
    first = named.groupBy("class_id").agg(F.min(place).alias("first"))
    judged = named.join(first, "class_id").select("doc_id", "_doc", "line_no", "class_id", (place == F.col("first")).alias("keep"))
    return judged.unionByName(blank), [rows, found]


def dedup(docs: DataFrame) -> DataFrame:
    """docs with every text reduced to its kept lines; all rows and other columns stay.

    See line_classes for what is kept. A text without any kept line becomes empty; a
    null text stays null. An empty table stays empty.
    """
    # Stored, so that what its steps moved is gone before the texts move, if they must.
    classes, used = _classes(docs)
    gone = classes.filter("not keep").groupBy("doc_id", "_doc").agg(F.collect_set("line_no").alias("gone"))
    dropped = common.stored(gone, "dropped")
    common.discard(*used)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("its"), F.struct(*common.without(docs, {"text"})).alias("row"))
    joined = rows.alias("d").join(dropped.alias("g"), F.expr("d.doc_id <=> g.doc_id and its = _doc"), "left")
    rest = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return joined.select(
        *[text.alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_classes(common.table(spark, sf_dir, "documents")).drop("_doc")


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL: dict[str, str] = {}
