"""All named queries and their checking SQL."""

from __future__ import annotations

from idsift.plans import files, log, measures, records, scoring, signals, streams

FLAGSHIP = "pipeline_score"
MODULES = (records, scoring, measures, signals, log, streams, files)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
