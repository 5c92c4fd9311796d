"""Token counts against plain dynamic programming and another implementation."""

import random

import edge
import pytest
from idsift.llm import tokens


@pytest.fixture(scope="module")
def pieces():
    return tokens.vocabulary()


def brute(word, pieces):
    """Every segmentation's score, without sharing or suffix order."""
    low = min(pieces.values()) - 1.0
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        found = []
        for begin in range(end):
            piece = word[begin:end]
            score, n = best[begin]
            if piece in pieces:
                found.append((score + pieces[piece], n + 1))
            elif len(piece) == 1:
                b = len(piece.encode("utf-8", "surrogatepass"))
                found.append((score + b * low, n + b))
        best[end] = max(found, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


def some_words(n=400):
    rnd = random.Random(3)
    parts = ["the", "tion", "ing", "é", "ß", "Zahl", "x", "99", ",", "😀", "pre", "fix", "un", "able"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def test_trie_counts_like_plain_search(pieces):
    trie = tokens.Trie(pieces)
    for w in some_words():
        marked = tokens.MARK + w
        assert trie.insert(marked) == brute(marked, pieces) == trie.plain(marked)


def test_prefixes_are_scored_once(pieces, monkeypatch):
    trie, calls = tokens.Trie(pieces), []
    forward = tokens.Trie.forward
    monkeypatch.setattr(tokens.Trie, "forward", lambda *a: calls.append(1) or forward(*a))
    words = ["prefix" + s for s in ("a", "b", "c", "")]
    for w in words:
        trie.insert(w)
    assert len(calls) == len("prefix") + 3


def test_small_tries_change_nothing(pieces, monkeypatch):
    words = some_words()
    whole = [tokens.Trie(pieces).insert(w) for w in words]
    monkeypatch.setattr(tokens, "MOST_NODES", 40)
    trie = tokens.Trie(pieces)
    assert [trie.insert(w) for w in words] == whole


def test_against_another_unigram_model(pieces):
    models = pytest.importorskip("tokenizers").models
    table = [("<unk>", 0.0), *pieces.items()]
    other = models.Unigram(table, 0, False)
    trie = tokens.Trie(pieces)
    for w in some_words():
        if all(c in pieces for c in w):
            assert trie.insert(w) == len(other.tokenize(w))


def test_edge_rows(spark, pieces):
    found = tokens.count_tokens(edge.docs(spark), pieces).collect()
    assert len(found) == len(edge.rows())
    trie = tokens.Trie(pieces)
    for r in found:
        words = (r["text"] or "").encode().split()
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(trie.plain(tokens.MARK + w.decode()) for w in words)
        assert r["size"] == "clash"
    assert tokens.count_tokens(edge.empty(spark), pieces).count() == 0


def test_search_stops_where_no_piece_ends(pieces):
    trie, asked = tokens.Trie(pieces), []
    known = trie.ending
    trie.ending = lambda text, default: asked.append(text) or known(text, default)
    word = tokens.MARK + "Жфщ" * 40
    assert trie.insert(word) == brute(word, pieces)
    assert len(asked) <= 3 * len(word)
