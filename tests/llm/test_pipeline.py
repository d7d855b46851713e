"""The stages one after the other, each against a plain reading of what it must do."""

import corpus_pipeline
from originlens.llm import bagminhash, decontam, semicrf


def test_stages(spark, sf, documents):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), documents.schema)
        assert out.columns == documents.columns
        seen.append((name, docs, out))
        docs = out
    by = {name: (a, b) for name, a, b in seen}
    assert list(by) == ["language", "near_duplicates", "decontamination", "personal_data", "mix_sources"]
    a, b = by["language"]
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect() if any(c.isalpha() for c in r.text or "")}
    a, b = by["near_duplicates"]
    assert {r.doc_id for r in b.collect()} == {r.class_id for r in bagminhash.classes(a).collect()}
    a, b = by["decontamination"]
    bad = {r.doc_id for r in decontam.matches(a, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert bad and {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect()} - bad
    a, b = by["personal_data"]
    assert not any(semicrf.base_spans(r.text) for r in b.collect()) and a.count() == b.count()
    a, b = by["mix_sources"]
    words = lambda d: sum(len(r.text.split()) for r in d.collect())
    assert abs(words(b) / words(a) - 1) < 0.1
    assert {r.doc_id for r in b.collect()} <= {r.doc_id for r in a.collect()}


def test_run_gives_the_last_stage(spark, sf, documents):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == documents.columns and got.count() > 0
