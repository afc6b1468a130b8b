"""Stages of the pipeline against plain versions, and odd tables."""

import corpus_pipeline
from adtally.llm import language, mixing
from tests.llm.test_near_copies import plain_components


def stages():
    return dict(corpus_pipeline.STAGES)


def test_stage_by_stage(spark, root, texts):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    known = stages()["language_id"](spark, docs, root)
    assert known.columns == docs.columns
    assert {r.doc_id for r in known.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    apart = stages()["near_dedup"](spark, known, root)
    assert apart.columns == docs.columns
    classes = plain_components({r.doc_id: r.text for r in known.collect()}, 5, 80)
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, c in classes.values()})
    mix = stages()["source_mixing"](spark, apart, root)
    assert mix.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert set(counts.values()) <= {1, 2, 3, 4}
    size = lambda df: df.select(mixing.estimated_tokens(df["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert 0.7 * size(apart) <= size(mix) <= size(apart)
    packed = stages()["best_fit_packing"](spark, mix, root).collect()
    starts = [r for r in packed if r.piece == 0]
    assert len(starts) == mix.count()


def test_run_gives_the_stages_rows(spark, root):
    assert corpus_pipeline.run(spark, root).columns[:2] == ["doc_id", "piece"]


def test_odd_tables(spark, odd_docs, no_docs, root):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, root)
            assert out.columns == docs.columns
            assert (out.count() > 0) == (docs.count() > 0)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, root).count() > 0) == (docs.count() > 0)


def test_clean_documents_stay(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = language.accepted(docs).count()
    assert kept >= 0.98 * docs.count()
