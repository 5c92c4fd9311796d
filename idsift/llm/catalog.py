"""Named queries of this package and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from idsift.llm import (
    codes, decontamination, language, lines, merkle, mixing, nearest, ngrams, phrases, privacy, simhash, tokens, urls,
)

MODULES = (
    tokens, ngrams, mixing, urls, lines, merkle, simhash, decontamination, language, privacy, codes, phrases, nearest,
)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
