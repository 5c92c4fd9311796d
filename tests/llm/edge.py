"""Rows that every operator has to bear, and the small table that the tests share."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra}"
#: Names that operators use for their own columns.
CLASHES = (
    "size", "target", "taken", "words", "word", "node", "component", "keep", "sig", "bucket", "part", "value", "fp",
    "items", "n_hit", "n_words", "m", "h", "window", "met", "score", "lang_pred", "key", "line", "line_no", "class_id",
    "held_out", "n_tokens", "kind", "rank", "start", "end", "term", "entity", "all", "spans", "n", "i", "hit", "listed",
)


def rows() -> list[tuple]:
    word = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"
    long = " ".join(f"word{i % 977} {word}" for i in range(4000))
    texts = [
        None, "", " \t\n ", "a", "###", word, word, word + " extra", long, long, "x" * 200_000, "1" * 100_000,
        "é" * 50, "Zażółć gęślą jaźń \U0001f600 word", "a@b.c" * 3, "one\n\ntwo\r\nthree\x0bfour", "\x00nul\x00byte",
    ]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5], (5, "another text under an old id", "en", "a", 3), (None, word, None, None, None), (None, None, None, None, None)]
    return out


def docs(spark, clashing: bool = True):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows(), schema)
    return with_clashes(df) if clashing else df


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def empty(spark):
    return docs(spark).limit(0)
