"""The pipeline's stages on their own input, and as a whole."""

import corpus_pipeline
import edge
from idsift.llm import common, language

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_each_stage_keeps_columns_and_narrows(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = common.stored(stage(spark, docs, sf_dir), name)
        assert kept.columns[:5] == COLUMNS
        if i < 4:
            assert kept.columns == COLUMNS
        assert 0 < kept.count() <= docs.count()
        docs = kept
    taken = docs.agg({"taken": "sum"}).first()[0]
    size = docs.agg({"size": "sum"}).first()[0]
    assert taken > 0 and size > 0


def test_planted_cases(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").limit(150)
    some = [r for r in docs.collect() if len(r["text"].split()) > 150][:12]
    item = common.table(spark, sf_dir, "benchmark").first()["text"]
    plant = [
        (10**6, "#### 12345 ... !!!", "en", "s", 1),
        (10**6 + 1, item, "en", "s", 1),
        (10**6 + 2, some[0]["text"], "en", "s", 1),
        (10**6 + 3, " ".join(some[1]["text"].split() + ["more", "words"]), "en", "s", 1),
    ]
    table = docs.union(spark.createDataFrame(plant, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    language_kept = ids(stages["language_id"](spark, table, sf_dir))
    assert 10**6 not in language_kept and ids(docs) <= language_kept
    near_kept = ids(stages["near_dedup"](spark, table, sf_dir))
    assert not {10**6 + 2, 10**6 + 3} & near_kept
    clean = ids(stages["decontamination"](spark, table, sf_dir))
    assert 10**6 + 1 not in clean


def test_edge_rows(spark, sf_dir):
    for docs in (edge.docs(spark), edge.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert all(r[c] == "clash" for r in out.collect() for c in edge.CLASHES)
        corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert language.UNKNOWN == "und"
