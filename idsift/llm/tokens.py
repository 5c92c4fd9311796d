"""Token counts under a unigram model, by dynamic programming over a shared trie.

A text's pre-tokens are its words, each with the word mark in front. The token count
of a pre-token is the number of pieces in its most probable segmentation. A task puts
the distinct pre-tokens that it meets into a trie. Each trie node keeps the forward
score of the prefix that it stands for and the number of pieces on the best path to
it, computed once however many pre-tokens share the prefix; a pre-token's count is
read off its terminal node.

The public vocabulary has merge ranks and no probabilities, so a piece's log
probability is Zipf's, -log(rank + OFFSET). A character that is no piece is written
as its UTF-8 bytes, each of them a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsift.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
OFFSET = 10.0
#: Trie nodes and pre-tokens that a task keeps before it starts anew. No result depends on them.
MOST_NODES = 400_000
MOST_WORDS = 200_000
#: Longer pre-tokens are segmented without the trie.
LONGEST_SHARED = 256


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> log probability, for the ordinary pieces of a public vocabulary file.
    Read on the driver and sent to the tasks; its size is fixed by the file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    kept = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    kept.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -log(rank + OFFSET) for rank, i in enumerate(kept)}


class Trie:
    """Prefixes of pre-tokens with their forward scores and piece counts."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        # Every suffix of a piece, with the score of those that are pieces themselves: once an
        # ending of a word is none, no longer ending of it is a piece.
        endings: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))}
        self.ending = (endings | pieces).get
        self.byte = min(pieces.values(), default=0.0) - 1.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def forward(self, word: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score and its piece count for word[:end]; scores and counts belong to
        the shorter prefixes. Of equal scores, the one with fewer pieces."""
        ending, last = self.ending, word[end - 1 : end]
        p = ending(last, False)
        if p is not None and p is not False:
            best, least = scores[end - 1] + p, counts[end - 1] + 1
        else:
            n = len(last.encode("utf-8", "surrogatepass"))
            best, least = scores[end - 1] + n * self.byte, counts[end - 1] + n
            if p is False:
                return best, least
        for begin in range(end - 2, -1, -1):
            p = ending(word[begin:end], False)
            if p is False:
                break
            if p is not None:
                s, c = scores[begin] + p, counts[begin] + 1
                if s > best or (s == best and c < least):
                    best, least = s, c
        return best, least

    def plain(self, word: str) -> int:
        """The same count without the trie."""
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            s, c = self.forward(word, end, scores, counts)
            scores.append(s)
            counts.append(c)
        return counts[-1]

    def insert(self, word: str) -> int:
        """Tokens of a pre-token; scores only the prefixes that no other one shares."""
        if len(word) > LONGEST_SHARED:
            return self.plain(word)
        if len(self.score) + len(word) > MOST_NODES or len(self.terminal) >= MOST_WORDS:
            self.clear()
        child, node = self.child, 0
        scores, counts = [0.0], [0]
        for end, letter in enumerate(word, 1):
            key = node * 0x110000 + ord(letter)
            node = child.get(key, -1)
            if node < 0:
                s, c = self.forward(word, end, scores, counts)
                node = child[key] = len(self.score)
                self.score.append(s)
                self.count.append(c)
            scores.append(self.score[node])
            counts.append(self.count[node])
        return counts[-1]

    def tokens(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words, total, known = words_of(text), 0, self.terminal.get
        for word in words:
            n = known(word)
            if n is None:
                n = self.insert(MARK + word.decode("utf-8", "surrogatepass"))
                known = self.terminal.get  # another one, if the trie was cleared
                if len(word) <= LONGEST_SHARED:
                    self.terminal[word] = n
            total += n
        return len(words), total


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def count_tokens(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """docs with n_words and n_tokens.

    Null and empty texts have none. Whole texts are counted, of any length. Repeated
    rows count alike; other columns are kept, and input columns with the two names
    are replaced. No shuffle: a trie belongs to a task, and a lost task is run again.
    """

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(pieces)
        for texts in batches:
            found = [trie.tokens(t) if t else (0, 0) for t in texts]
            yield pd.DataFrame(found, columns=["n_words", "n_tokens"])

    counted = docs.select(*common.without(docs, {"n_words", "n_tokens", "_count"}), count(F.col("text")).alias("_count"))
    return counted.select("*", "_count.n_words", "_count.n_tokens").drop("_count")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary()).drop("text")


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
