"""Language-model scores from a sharded Elias-Fano n-gram trie.

Documents are read in blocks of bounded size. A block sends its distinct words and
word pairs, with their training counts, to shards: a pair goes to the shard of its
first word, the context, and a frequent context is spread over several shards by its
second word. A shard adds up the counts of all blocks, which makes its part of the
model, builds the trie of its contexts, answers what the blocks asked of it, and the
answers go back to the blocks, which score their documents.

So the model is never in one place: shards and blocks are of bounded size and only
their number grows with the corpus, and a text's pairs move once per block, not
once per occurrence.

Model: interpolated, with modified Kneser-Ney discounts from each shard's own counts
of counts, over the add-one unigram distribution of the training tokens, which gives
an unseen word the share of one token. Words are known by 64-bit hashes; below a
context, by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsift.llm import common
from idsift.llm.eliasfano import Trie, probability

#: Bytes of text in a block, about.
BLOCK = 12_000_000
#: Words or pairs of all blocks that a shard takes, about.
SHARD = 1_000_000
#: Pairs of all blocks from which a context is spread over shards. At most SPREAD
#: contexts are: for a corpus of over SPREAD * SHARD / 4 pairs, the largest ones.
HOT = SHARD // 4
SPREAD = 20_000
#: Followers in a block from which a context is counted for that.
REPORTED = 16
END, BEGIN = b"\n", b"\n\n"  # no words
MODULUS, HELD_OUT = 7, 2

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers words by first occurrence; 0 ends a text and 1 begins one."""

    def __init__(self):
        super().__init__({END: 0, BEGIN: 1})

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; the bytes of a number are stored in planes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), a.itemsize)], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.compress(b"".join([head, *planes]), 1)


_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    count = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    sizes = np.frombuffer(raw, dtype=np.int64, count=1 + 2 * count)[1:].reshape(-1, 2)
    at, out = 8 * (1 + 2 * count), []
    for n, width in sizes.tolist():
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(_KINDS[width]).reshape(n))
        at += n * width
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def encode(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) -> block, ids, held, n_train, n_train_docs, n_words,
    n_pairs, heavy (contexts with many followers), body: a row per block."""
    kind = dict(docs.dtypes)["doc_id"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        ids, number, held, tokens, lengths, size = [], _Ids(), [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                words = words_of(text)
                ids.append(None if pd.isna(doc_id) else doc_id)
                held.append(bool(out))
                tokens.append(np.array([*map(number.__getitem__, words), 0], dtype=np.uint32))
                lengths.append(len(words) + 1)
                size += len(text or "")
                if size >= BLOCK:
                    yield _block_row((task << 24) + made, ids, number, held, tokens, lengths)
                    made += 1
                    ids, number, held, tokens, lengths, size = [], _Ids(), [], [], [], 0
        if ids:
            yield _block_row((task << 24) + made, ids, number, held, tokens, lengths)

    return docs.mapInPandas(
        read,
        f"block long, ids array<{kind}>, held array<boolean>, n_train long, n_train_docs long, n_words long, "
        "n_pairs long, heavy array<struct<context:long,n:long>>, body binary",
    )


def _block_row(block, ids, number, held, tokens, lengths) -> pd.DataFrame:
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], dtype=np.uint64)
    body = _pack(hashes, np.concatenate(tokens), np.array(lengths, dtype=np.uint32))
    b = Block(body, held).with_pairs()
    followers = np.bincount(b.first, minlength=len(hashes))
    many = np.flatnonzero(followers >= REPORTED)
    heavy = [{"context": int(c), "n": int(n)} for c, n in zip(hashes[many].view(np.int64), followers[many], strict=True)]
    row = {
        "block": [block], "ids": [ids], "held": [held], "n_train": [int(b.train.sum())],
        "n_train_docs": [len(held) - sum(held)], "n_words": [len(hashes)], "n_pairs": [len(b.first)],
        "heavy": [heavy], "body": [body],
    }
    return pd.DataFrame(row)


class Block:
    """A block's tokens; with_pairs adds its distinct pairs. Both are dealt to shards."""

    def __init__(self, body: bytes, held):
        self.hashes, tokens, lengths = _unpack(body)
        self.lengths = lengths.astype(np.int64)
        self.tokens = tokens.astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.train = np.repeat(~np.asarray(held, dtype=bool), self.lengths)
        self.word_train = np.bincount(self.tokens[self.train], minlength=len(self.hashes))

    def with_pairs(self) -> Block:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 1
        n = len(self.hashes)
        keys = before * n
        keys += self.tokens
        pairs, self.pair_of = np.unique(keys, return_inverse=True)
        del keys
        self.first, self.second = pairs // n, pairs % n
        self.pair_train = np.bincount(self.pair_of[self.train], minlength=len(pairs))
        self.context_train = np.bincount(before[self.train], minlength=n)
        return self

    def word_parts(self, shards: int):
        """(shard, word numbers) of the words but the begin."""
        words = np.delete(np.arange(len(self.hashes)), 1)
        shard = (self.hashes[words] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        yield from _cut(shard[order], words[order])

    def pair_parts(self, shards: int, spread: dict[int, int]):
        """(shard, context numbers, pair numbers), both in order of context, for every
        shard that a context of the block is spread over."""
        mixed = (self.hashes * _ODD) >> np.uint64(20)
        wide = np.ones(len(self.hashes), dtype=np.uint64)
        if spread:
            hot = np.fromiter(spread, dtype=np.int64, count=len(spread))
            by = np.argsort(hot)
            at = np.minimum(np.searchsorted(hot[by], self.hashes.view(np.int64)), len(hot) - 1)
            is_hot = hot[by][at] == self.hashes.view(np.int64)
            sizes = np.fromiter(spread.values(), dtype=np.uint64, count=len(spread))[by]
            wide[is_hot] = sizes[at[is_hot]]
        used = np.unique(self.first)
        copies = np.repeat(used, wide[used].astype(np.int64))
        turn = np.arange(len(copies)) - np.repeat(
            np.cumsum(wide[used].astype(np.int64)) - wide[used].astype(np.int64), wide[used].astype(np.int64)
        )
        shard_of = ((mixed[copies] + turn.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        both = np.unique(shard_of * len(self.hashes) + copies)
        context_shard, context = both // len(self.hashes), both % len(self.hashes)
        salt = self.hashes[self.second] % wide[self.first]
        pair_shard = ((mixed[self.first] + salt) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(pair_shard, kind="stable")
        pairs = dict(_cut(pair_shard[order], order))
        none = np.empty(0, dtype=np.int64)
        for shard, contexts in _cut(context_shard, context):
            yield shard, contexts, pairs.get(shard, none)


def _cut(shard: np.ndarray, values: np.ndarray):
    """(shard, its values), for values in order of shard."""
    if len(shard):
        ends = np.flatnonzero(np.diff(shard)) + 1
        for s, part in zip(shard[np.concatenate(([0], ends))].tolist(), np.split(values, ends), strict=True):
            yield s, part


def ask(blocks: DataFrame, shards: int, spread: dict[int, int] | None) -> DataFrame:
    """shard, block, body: what each block asks of each shard. Word shards have numbers
    from 0; with `spread`, pairs are asked, and their shards have numbers below 0."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, held, body in zip(batch["block"], batch["held"], batch["body"], strict=True):
                b, out = Block(body, held), []
                if spread is None:
                    for shard, words in b.word_parts(shards):
                        out.append((shard, block, _pack(b.hashes[words], b.word_train[words].astype(np.uint32))))
                else:
                    b.with_pairs()
                    for shard, contexts, pairs in b.pair_parts(shards, spread):
                        firsts = b.first[pairs]
                        followers = np.searchsorted(firsts, contexts, side="right") - np.searchsorted(firsts, contexts)
                        second = b.hashes[b.second[pairs]] >> np.uint64(16)
                        out.append((-1 - shard, block, _pack(
                            b.hashes[contexts], b.context_train[contexts].astype(np.uint32), followers.astype(np.uint32),
                            (second >> np.uint64(16)).astype(np.uint32), (second & np.uint64(0xFFFF)).astype(np.uint16),
                            b.pair_train[pairs].astype(np.uint32),
                        )))
                yield pd.DataFrame(out, columns=["shard", "block", "body"])

    return blocks.select("block", "held", "body").mapInPandas(made, "shard int, block long, body binary")


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of the counts 0, 1, 2, and 3 or more."""
    n = [int((counts == i).sum()) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [0.0] + [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.75 * i for i in (1, 2, 3)]
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


def word_answers(rows: list[tuple]) -> tuple[list[bytes], int]:
    """Training counts of the words that each block asked for, and the distinct
    training words of the shard."""
    asked = [_unpack(body) for _, body in rows]
    keys, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.zeros(len(keys), dtype=np.uint64)
    np.add.at(total, place, np.concatenate([a[1] for a in asked]).astype(np.uint64))
    answers = [_pack(total[np.searchsorted(keys, a[0])]) for a in asked]
    return answers, int((total > 0).sum())


def shard_trie(asked: list[list[np.ndarray]]) -> Trie:
    """The trie over all training pairs of a shard."""
    contexts = np.concatenate([a[0] for a in asked])
    keys, place = np.unique(contexts, return_inverse=True)
    seen = np.bincount(place, weights=np.concatenate([a[1] for a in asked]), minlength=len(keys))
    context_of = np.repeat(place, np.concatenate([a[2] for a in asked]).astype(np.int64))
    second = np.concatenate([_second(a) for a in asked])
    count = np.concatenate([a[5] for a in asked]).astype(np.int64)
    known = count > 0
    words, word_of = np.unique(second[known], return_inverse=True)
    entries, entry = np.unique(context_of[known] * max(1, len(words)) + word_of, return_inverse=True)
    total = np.bincount(entry, weights=count[known], minlength=len(entries))
    of, word = entries // max(1, len(words)), entries % max(1, len(words))
    d = discounts(total)[np.minimum(total, 3).astype(np.int64)]
    left = np.bincount(of, weights=d, minlength=len(keys))
    return Trie(keys, words, of, word, (total - d) / seen[of], left / np.maximum(seen, 1))


def _second(asked: list[np.ndarray]) -> np.ndarray:
    return (asked[3].astype(np.uint64) << np.uint64(16)) | asked[4].astype(np.uint64)


def pair_answers(rows: list[tuple]) -> list[bytes]:
    """For each block, the codes of its pairs and what its contexts leave to words."""
    asked = [_unpack(body) for _, body in rows]
    trie, out = shard_trie(asked), []
    try:
        for a in asked:
            number = trie.context_numbers(a[0])
            codes = trie.find(np.repeat(number, a[2].astype(np.int64)), _second(a))
            out.append(_pack(codes, trie.mass[number].view(np.uint32)))
    finally:
        trie.close()
    return out


def answer(asked: DataFrame) -> DataFrame:
    """block, shard, body, n_distinct: the answers to what the blocks asked."""

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        shard, n = int(rows["shard"].iloc[0]), 0
        each = list(zip(rows["block"], rows["body"], strict=True))
        if shard >= 0:
            bodies, n = word_answers(each)
        else:
            bodies = pair_answers(each)
        return pd.DataFrame({"block": rows["block"], "shard": shard, "body": bodies, "n_distinct": n})

    return asked.groupBy("shard").applyInPandas(serve, "block long, shard int, body binary, n_distinct long")


def score_block(ids, held, body, answers: dict[int, bytes], facts: dict) -> pd.DataFrame:
    b = Block(body, held).with_pairs()
    count = np.zeros(len(b.hashes))
    for shard, words in b.word_parts(facts["word_shards"]):
        count[words] = _unpack(answers[shard])[0]
    count[1] = facts["train_docs"]
    seen = np.zeros(len(b.first))
    mass = np.zeros(len(b.hashes))
    for shard, contexts, pairs in b.pair_parts(facts["pair_shards"], facts["spread"]):
        codes, left = _unpack(answers[-1 - shard])
        seen[pairs] = probability(codes)
        mass[contexts] += left.view(np.float32)
    mass[count == 0] = 1.0
    unigram = (count + 1) / (facts["train_tokens"] + facts["distinct"] + 1)
    pair = np.log10(seen + mass[b.first] * unigram[b.second])
    base = np.log10(unigram)[b.tokens]
    return pd.DataFrame({
        "doc_id": ids, "held_out": held, "n_tokens": b.lengths,
        "n_known": np.add.reduceat((count > 0)[b.tokens].astype(np.int64), b.starts),
        "train_tokens": facts["train_tokens"],
        "base_score": np.add.reduceat(base, b.starts), "score": np.add.reduceat(pair[b.pair_of], b.starts),
    })


def score(docs: DataFrame, held_out: Column, block: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, a row per row.

    The model learns from the rows for which held_out is false. A text's tokens are
    its words, A-Z lower-cased, and one end, so a null or empty text has one token.
    Repeated rows count as often as they occur. Without training rows every token is
    unseen. Other columns are dropped; an empty table gives none.
    """
    source = docs.select("doc_id", held_out.alias("held_out"), "text")
    blocks = common.stored(encode(source), "blocks")
    sums = blocks.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_train_docs", "n_words", "n_pairs")]
    ).first()
    word_shards, pair_shards = max(1, -(-sums["n_words"] // SHARD)), max(1, -(-sums["n_pairs"] // SHARD))
    hot = max(HOT, sums["n_pairs"] // SPREAD)
    heavy = (
        blocks.select(F.explode("heavy").alias("h")).groupBy("h.context").agg(F.sum("h.n").alias("n"))
        .filter(F.col("n") >= hot).collect()
    )
    spread = {r["context"]: min(pair_shards, int(-(-2 * r["n"] // HOT))) for r in heavy}
    # The unigram level first: each block's words with their counts, and their number.
    words = common.stored(answer(ask(blocks, word_shards, None)), "words")
    distinct = (
        words.groupBy("shard").agg(F.max("n_distinct").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    )
    facts = {
        "word_shards": word_shards, "pair_shards": pair_shards, "spread": spread, "distinct": int(distinct),
        "train_tokens": int(sums["n_train"]), "train_docs": int(sums["n_train_docs"]),
    }
    answers = words.union(answer(ask(blocks, pair_shards, spread))).drop("n_distinct")

    def finish(of_block: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        row = of_block.iloc[0]
        return score_block(list(row["ids"]), list(row["held"]), row["body"],
                           dict(zip(answered["shard"], answered["body"], strict=True)), facts)

    kind = dict(docs.dtypes)["doc_id"]
    return (
        blocks.select("block", "ids", "held", "body").groupBy("block").cogroup(answers.groupBy("block"))
        .applyInPandas(
            finish,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.crc_of_id() % MODULUS == HELD_OUT)


QUERIES = {"op2_lm_score": op2_lm_score}
SQL: dict[str, str] = {}
