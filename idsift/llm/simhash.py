"""SimHash near-duplicates by generalised pigeonhole search.

Bits that vary together are put into one part of the fingerprint, so that the other
parts tell fingerprints apart. Two fingerprints with at most `most` differing bits
differ in at most t_i bits of some part i whenever the t_i + 1 add up to most + 1.
Each fingerprint gets its own thresholds t_i (-1: part not used), by dynamic
programming over the candidates that each part would bring, estimated from how many
fingerprints share its value there. It probes the values within t_i, and what it
meets is verified over all 64 bits.

Buckets that hold more fingerprints than the ball of one flipped bit has values are
settled exactly without pairs: see `near_links`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsift.llm import common, linking

BITS = 64
SHINGLE = 3
MOST_BITS = 2
#: A bucket of more fingerprints costs more than the 65 values within one bit.
DENSE = BITS + 1
#: Cost of a probe, in candidates.
PROBE = 8
_BLOCK = 1 << 15


def hash_bits(hashes: list[int]) -> int:
    """Bits set in over half of the 64-bit hashes, as a signed number; none: 0."""
    if not hashes:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[i : i + _BLOCK], dtype=np.uint64).astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k words each; fewer words are one shingle."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_bits(text: str | None, k: int = SHINGLE) -> int:
    return hash_bits([xxhash.xxh64_intdigest(s, 42) for s in shingles(words_of(text), k)])


@F.pandas_udf(T.LongType())
def fingerprint_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([text_bits(t) for t in texts], dtype="int64")


# -- parts and thresholds


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch["fp"].to_numpy(dtype="int64").astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        i, j = np.indices(both.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "c": both.ravel().astype("int64"), "n": n})

    rows = (
        fps.select("fp").mapInPandas(count, "i int, j int, c long, n long")
        .groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    )
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["c"]
    return (int(rows[0]["n"]) if rows else 0), both


def parts_of(n: int, both: np.ndarray, count: int) -> list[list[int]]:
    """`count` parts of near-equal width: each starts with the free bit that varies
    with others the most, and takes the free bits that vary with it the most."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(tied, 0)
    free, parts = set(range(BITS)), []
    for left in range(count, 0, -1):
        width = -(-len(free) // left)
        rest = sorted(free)
        part = [max(rest, key=lambda b: (tied[b, rest].sum(), -b))]
        while len(part) < width:
            part.append(max(sorted(free - set(part)), key=lambda b: (tied[b, part].mean(), -b)))
        parts.append(sorted(part))
        free -= set(part)
    return parts


def value_at(fp: Column, part: list[int]) -> Column:
    """The part's bits as a number."""
    value = F.lit(0).cast("bigint")
    for i, b in enumerate(part):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("bigint")), i))
    return value


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def widest(most: int, count: int, width: int) -> int:
    """Largest threshold of a part: one more than equal thresholds would need."""
    return min(most, width, -(-(most + 1) // count))


def thresholds(sizes: np.ndarray, widths: list[int], near: list[float], most: int, dense: float) -> np.ndarray:
    """sizes[q, i]: fingerprints that share q's value of part i. near[i]: mean bucket of
    part i. Returns t[q, i] with the t + 1 adding up to most + 1 at the least cost."""
    q, m = sizes.shape
    budget = most + 1
    best = np.full((q, budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((m, q, budget + 1), dtype=np.int8)
    for i, width in enumerate(widths):
        cost = [np.zeros(q)]
        for t in range(widest(most, m, width) + 1):
            probes = ball(width, t)
            cost.append(probes * PROBE + np.minimum(sizes[:, i], dense) + (probes - 1) * min(near[i], dense))
        new = np.full_like(best, np.inf)
        for used, c in enumerate(cost):
            moved = best[:, : budget + 1 - used] + c[:, None]
            better = moved < new[:, used:]
            choice[i][:, used:][better] = used
            new[:, used:] = np.where(better, moved, new[:, used:])
        best = new
    out, left = np.zeros((q, m), dtype=np.int64), np.full(q, budget)
    for i in range(m - 1, -1, -1):
        used = choice[i][np.arange(q), left]
        out[:, i] = used - 1
        left = left - used
    return out


def search(fps: DataFrame, most: int, count: int | None = None, dense: float = DENSE):
    """fps (node, fp) -> (index, probes): both have part, value, node, fp; the index
    has `size`, the rows of its bucket. A pair within `most` bits has one of them
    probing the other's bucket."""
    n, both = bit_sums(fps)
    if count is None:
        count = max(1, min(most + 1, int(BITS // max(1.0, log2(max(2, n))))))
    parts = parts_of(n, both, count)
    widths = [len(p) for p in parts]
    values = F.array(*[value_at(F.col("fp"), p) for p in parts])
    index = fps.select("node", "fp", F.posexplode(values).alias("part", "value"))
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("size"))
    sized = common.stored(index.join(sizes, ["part", "value"]), "index")
    squares = {
        r["part"]: r["s"]
        for r in sizes.groupBy("part").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("s")).collect()
    }
    near = [max(n / 2.0**w, 0.25 * squares.get(i, 0) / max(1, n)) for i, w in enumerate(widths)]
    cap = float(dense)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def allocated(found: pd.Series) -> pd.Series:
        if not len(found):
            return pd.Series([], dtype=object)
        t = thresholds(np.array(found.tolist(), dtype=float), widths, near, most, cap)
        return pd.Series(list(t.astype("int32")))

    each = sized.groupBy("node", "fp").agg(
        *[F.max(F.when(F.col("part") == i, F.col("size"))).alias(f"s{i}") for i in range(count)]
    )
    planned = each.select("node", "fp", allocated(F.array(*[F.col(f"s{i}") for i in range(count)])).alias("t"))
    asked = []
    for i, part in enumerate(parts):
        masks = F.lit(None).cast("array<bigint>")
        for t in range(widest(most, count, widths[i]) + 1):
            masks = F.when(
                F.col("t")[i] == t, F.array(*[F.lit(x).cast("bigint") for x in flips(widths[i], t)])
            ).otherwise(masks)
        asked.append(
            planned.filter(F.col("t")[i] >= 0).select(
                F.lit(i).alias("part"), value_at(F.col("fp"), part).alias("own"), F.explode(masks).alias("mask"),
                "node", "fp",
            ).select("part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"), "node", "fp")
        )
    probes = asked[0]
    for a in asked[1:]:
        probes = probes.unionByName(a)
    return sized, probes


def differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """fps (fp, distinct), most at most 2 -> links (a, b) between fingerprints that
    differ in at most `most` bits, which connect all that such links can connect.

    Small buckets: candidates are verified in the join. A fingerprint that is in a
    dense bucket or probes one writes down the 65 values within one bit of it (with
    most = 2; for less, only the value itself): two are within two bits exactly if
    they share such a value. So every value's fingerprints are linked to the smallest.
    """
    if most > 2:
        raise ValueError("most is 2 or less; see near_duplicates for looser links")
    index, probes = search(fps.select(F.col("fp").alias("node"), "fp"), most)
    probes = common.stored(probes, "probes")
    few = index.filter(F.col("size") <= DENSE).select("part", "value", F.col("fp").alias("b"))
    sparse = probes.select("part", "value", F.col("fp").alias("a")).join(few, ["part", "value"]).filter(
        (F.col("a") != F.col("b")) & (differ(F.col("a"), F.col("b")) <= most)
    ).select("a", "b")
    crowd = index.filter(F.col("size") > DENSE)
    crowded = crowd.select("fp").union(
        probes.join(crowd.select("part", "value").distinct(), ["part", "value"], "left_semi").select("fp")
    ).distinct()
    masks = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint") for x in flips(BITS, 1 if most else 0)])
    around = crowded.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value")
    )
    least = around.groupBy("value").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    stars = around.join(least, "value").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    if most == 1:
        stars = stars.filter(differ(F.col("a"), F.col("b")) <= most)
    return sparse.union(stars.distinct())


def classes(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id (smallest doc_id reachable).

    A null, empty or blank text has fingerprint zero, linked like any other. Rows of
    equal fingerprints are one class, however many, and are never paired. A doc_id
    that is null counts only if its component has no other. Other columns are dropped.
    """
    own = common.stored(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = linking.components(near_links(fps.select("fp"), most))
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "component").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- looser near-duplicates, verified on the texts

NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8
#: Differing bits of the word fingerprints up to which two texts are compared.
NEAR_BITS = 8
#: Nodes of a bucket up to which its close pairs are taken in the join.
NEAR_DENSE = 256
#: Shingles of a block of texts, and of a shard that counts them, about.
NEAR_BLOCK = 500_000
#: Bytes of a shingle's hash that are stored and moved.
KEY_BYTES = 6
#: Texts of a block at most: they are numbered in 16 bits.
BLOCK_TEXTS = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def set_bits(words: list[bytes]) -> int:
    """Fingerprint of the distinct words: it moves less under edits than shingles do."""
    return hash_bits([xxhash.xxh64_intdigest(w, 42) for w in set(words)])


def jaccard(a: str, b: str, k: int = NEAR_SHINGLE) -> float:
    x, y = set(shingles(words_of(a), k)), set(shingles(words_of(b), k))
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_keys(words: list[bytes], k: int = NEAR_SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, of KEY_BYTES bytes."""
    each = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    k = min(k, len(each))
    keys = np.zeros(len(each) - k + 1 if k else 0, dtype=np.uint64)
    for i in range(k):
        keys = (keys + each[i : i + len(keys)]) * _MIX
        keys ^= keys >> np.uint64(29)
    return np.unique(keys & np.uint64((1 << 8 * KEY_BYTES) - 1))


def packed(keys: np.ndarray) -> bytes:
    """The lower KEY_BYTES bytes of each key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // KEY_BYTES, 8), dtype=np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return wide.view(np.uint64).ravel()


@F.pandas_udf(T.StructType().add("node", T.BinaryType()).add("sig", T.LongType()))
def _identity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        # One text's words at a time; those of a whole batch are hundreds of megabytes.
        found = [(hashlib.md5(b" ".join(words)).digest(), set_bits(words)) for words in map(words_of, texts)]
        yield pd.DataFrame(found, columns=["node", "sig"])


@F.pandas_udf(T.BooleanType())
def _similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([jaccard(x, y) >= NEAR_SIMILARITY for x, y in zip(a, b, strict=True)], dtype=bool)


def shared_shingles(blocks: DataFrame, shards: int) -> DataFrame:
    """blocks (block, keys, at) -> block, at, key, n_nodes: the shingles that two or more
    texts have. Arrays move, a row for each block and shard, and only what is shared
    becomes rows."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, raw_keys, raw_at in zip(batch["block"], batch["keys"], batch["at"], strict=True):
                keys, at = unpacked(raw_keys), np.frombuffer(raw_at, dtype=np.uint16)
                shard = (keys % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                found, begins = np.unique(shard[order], return_index=True)
                parts = np.split(order, begins[1:])
                yield pd.DataFrame({
                    "shard": found, "block": block,
                    "keys": [packed(keys[i]) for i in parts], "at": [at[i].tobytes() for i in parts],
                })

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys = unpacked(b"".join(rows["keys"]))
        at = np.frombuffer(b"".join(rows["at"]), dtype=np.uint16)
        block = np.repeat(rows["block"].to_numpy(), [len(x) // 2 for x in rows["at"]])
        _, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        often = n[place]
        kept = often > 1
        return pd.DataFrame({
            "block": block[kept], "at": at[kept].astype(np.int32), "key": keys[kept].view(np.int64), "n_nodes": often[kept],
        })

    return (
        blocks.select("block", "keys", "at").mapInPandas(dealt, "shard long, block long, keys binary, at binary")
        .groupBy("shard").applyInPandas(count, "block long, at int, key long, n_nodes long")
    )


def _blocks(texts: DataFrame) -> DataFrame:
    """texts (node, text) -> block, nodes, sizes (shingles of each), keys, at (the number of
    each key's text in the block): a row per block."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        nodes, keys, held = [], [], 0

        def row() -> pd.DataFrame:
            sizes = [len(k) for k in keys]
            at = np.repeat(np.arange(len(keys), dtype=np.uint16), sizes)
            return pd.DataFrame({
                "block": [(task << 24) + made], "nodes": [nodes], "sizes": [sizes],
                "keys": [packed(np.concatenate(keys))], "at": [at.tobytes()],
            })

        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                nodes.append(node)
                keys.append(shingle_keys(words_of(text)))
                held += len(keys[-1])
                if held >= NEAR_BLOCK or len(nodes) == BLOCK_TEXTS:
                    yield row()
                    made += 1
                    nodes, keys, held = [], [], 0
        if nodes:
            yield row()

    return texts.select("node", "text").mapInPandas(
        read, "block long, nodes array<binary>, sizes array<long>, keys binary, at binary"
    )


def prefix_members(texts: DataFrame) -> DataFrame:
    """texts (node, text) -> key, node, size, stored: nodes with a common key are candidates, and
    every two nodes of a Jaccard similarity of NEAR_SIMILARITY or more have one.

    Such nodes share four fifths of either's shingles. So, with shingles in one order
    for all nodes, they share one of the first n - ceil(4n / 5) + 1 of each. The order
    is rarest first; those that one node alone has come before all others and meet none.
    """
    blocks = common.stored(_blocks(texts), "blocks")
    total = blocks.agg(F.coalesce(F.sum(F.length("at")), F.lit(0))).first()[0] // 2
    shared = common.stored(shared_shingles(blocks, max(1, -(-total // NEAR_BLOCK))), "shared")
    sizes = blocks.select("block", F.posexplode(F.arrays_zip("nodes", "sizes")).alias("at", "x")).select(
        "block", "at", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("size")
    )
    # A text that has too few shared shingles goes before its shingles are gathered.
    able = shared.groupBy("block", "at").agg(F.count("*").alias("n_shared")).join(sizes, ["block", "at"]).withColumn(
        "first", F.col("size") - F.ceil(F.col("size") * 4 / F.lit(5)) + 1 - (F.col("size") - F.col("n_shared"))
    ).filter("first > 0")
    gathered = shared.join(able.select("block", "at"), ["block", "at"], "left_semi").groupBy("block", "at").agg(
        F.sort_array(F.collect_list(F.struct("n_nodes", "key"))).alias("ordered")
    )
    asked = common.stored(
        gathered.join(able, ["block", "at"]).select(
            F.explode(F.expr("slice(ordered, 1, cast(first as int))")).alias("x"), "node", "size"
        ).select("x.key", "node", "size"),
        "prefixes",
    )
    common.discard(blocks, shared)
    met = asked.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    found = common.stored(asked.join(met.select("key"), "key", "left_semi"), "met")
    common.discard(asked)
    return found


def near_duplicates(docs: DataFrame, most: int = NEAR_BITS) -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...), with `node` (identity of the
    text's words), `component` and `keep`: true for one document of each group.

    Texts of equal words are one node. Links are all pairs of nodes whose 5-word shingles
    have a Jaccard similarity of 0.8 or more, and groups are the components of links.
    Candidates are nodes whose word fingerprints differ in at most `most` bits, and those
    that share one of their rarest shingles, which no linked pair misses: see
    prefix_members. The kept one has the smallest doc_id (null last), then text; of
    wholly equal rows one is kept. Null and blank texts are one group.
    """
    rows = docs.select(*common.without(docs, {"node", "component", "keep", "_own"}))
    own = rows.select("doc_id", "text", _identity(F.col("text")).alias("_own")).select("doc_id", "text", "_own.*")
    own = common.stored(own.select(_id_key("doc_id"), "doc_id", "node", "sig", F.xxhash64("text").alias("_text")), "nodes")
    nodes = own.groupBy("node").agg(F.min("sig").alias("sig"))
    n = nodes.count()
    # Parts narrow enough for few flips, and wide enough to tell n fingerprints apart.
    count = max(2, min(most, round(BITS / max(8.0, log2(max(2, n)) - 5))))
    index, probes = search(nodes.select("node", F.col("sig").alias("fp")), most, count, dense=np.inf)
    probes = common.stored(probes, "probes")

    def close(a: Column, b: Column) -> Column:
        sized = 5 * F.least(a["size"], b["size"]) >= 4 * F.greatest(a["size"], b["size"])
        return F.when(a["size"] == 0, differ(a["fp"], b["fp"]) <= most).otherwise(sized)

    few = index.filter(F.col("size") <= NEAR_DENSE).select(
        "part", "value", F.col("node").alias("pivot"), F.col("fp").alias("pivot_fp")
    )
    pairs = common.stored(
        probes.join(few, ["part", "value"])
        .filter((F.col("node") != F.col("pivot")) & (differ(F.col("fp"), F.col("pivot_fp")) <= most))
        .select("node", "pivot").distinct(),
        "pairs",
    )
    # One text of every node, found by its row and moved once.
    asked = own.groupBy("node").agg(F.min(F.struct("_key", "_text")).alias("row")).select("node", "row._key", "row._text")
    texts = common.stored(
        docs.select(_id_key("doc_id"), F.xxhash64("text").alias("_text"), "text").join(asked, ["_key", "_text"])
        .groupBy("node").agg(F.first("text").alias("text")),
        "texts",
    )
    crowd = index.filter(F.col("size") > NEAR_DENSE)
    bucket = F.struct("part", "value").alias("bucket")
    # Members of a size are met by their sizes, the others by their fingerprints.
    sig = F.struct(F.col("fp"), F.lit(0).cast("bigint").alias("size")).alias("sig")
    crowds = common.stored(
        crowd.select(bucket, "node", sig, F.lit(True).alias("indexed")).union(
            probes.join(crowd.select("part", "value").distinct(), ["part", "value"], "left_semi")
            .select(bucket, "node", sig, F.lit(False).alias("indexed"))
        ),
        "crowds",
    )
    common.discard(index, probes)
    prefixes = prefix_members(texts)
    members = common.stored(
        crowds.union(
            prefixes.select(
                F.struct(F.lit(-1).alias("part"), F.col("key").alias("value")).alias("bucket"), "node",
                F.struct(F.lit(0).cast("bigint").alias("fp"), "size").alias("sig"), F.lit(True).alias("indexed"),
            )
        ),
        "members",
    )
    common.discard(crowds, prefixes)

    def verify(asked_pairs: DataFrame) -> DataFrame:
        with_a = asked_pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return both.filter(_similar(F.coalesce("text_a", F.lit("")), F.coalesce("text_b", F.lit(""))))

    links = linking.linked(members, verify, close, pairs)
    found = linking.components(links)
    common.discard(members, pairs, texts, links)
    labelled = own.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_text").alias("text"))
    first = labelled.groupBy("component").agg(F.min(place).alias("first"))
    chosen = labelled.join(first, "component").groupBy("_key", "_text").agg(
        F.first("node").alias("node"), F.first("component").alias("component"),
        F.max(place == F.col("first")).alias("_kept"),
    )
    copy = F.row_number().over(Window.partitionBy("_key", "_text").orderBy("_key"))
    placed = rows.withColumn("_key", _id_key("doc_id")).withColumn("_text", F.xxhash64("text"))
    return (
        placed.withColumn("_copy", copy).join(chosen, ["_key", "_text"])
        .withColumn("keep", F.col("_kept") & (F.col("_copy") == 1)).drop("_key", "_text", "_copy", "_kept")
    )


def _id_key(doc_id: str) -> Column:
    """The id as text that joins null to null."""
    return F.coalesce(F.concat(F.lit("#"), F.col(doc_id).cast("string")), F.lit("")).alias("_key")


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
