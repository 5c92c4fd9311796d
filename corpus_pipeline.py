"""The corpus pipeline: documents to a deduplicated, decontaminated, weighted mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. `run` writes every stage's rows as Parquet to the shared folder and reads them
back for the next, so that a lost executor costs a scan and no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsift.llm import common, decontamination, language, lines, mixing, simhash

#: Confidence below which a document's language counts as unknown.
LEAST_CONFIDENCE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no known language, go."""
    model = language.fit(docs.filter(~language.is_held_out()).select("doc_id", "text", "lang"))
    judged = language.identify(_carried(docs), model)
    return _unpacked(judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE)), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; the documents stay."""
    return _measured(lines.dedup(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return _unpacked(simhash.near_duplicates(_carried(docs)).filter("keep"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go."""
    judged = decontamination.decontaminate(_carried(docs), common.table(spark, sf_dir, "benchmark"))
    return _unpacked(judged.filter("not contaminated"), docs)


def _carried(docs: DataFrame) -> DataFrame:
    """What the operators read, and the rest of the row in one column, so that no column of
    the documents meets one of an operator's own of the same name."""
    return docs.select("doc_id", "text", F.struct(*common.without(docs, {"text"})).alias("rest_of_row"))


def _unpacked(carried: DataFrame, docs: DataFrame) -> DataFrame:
    rest = F.col("rest_of_row")
    return carried.select(*[F.col("text").alias(c) if c.lower() == "text" else rest[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words taken of each, in the mix's order."""
    mixed = mixing.mix(docs).filter("taken > 0").orderBy("virtual_finish", "source", "doc_id")
    own = ("size", "source_size", "target", "taken", "virtual_finish")
    return mixed.select(*[c for c in docs.columns if c.lower() not in mixing.OWN], *own)


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Fitted and iterative stages can't be written in SQL; tests compare them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
