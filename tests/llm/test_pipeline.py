"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from caseloom.llm import decontamination


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        seen[name] = before
    assert seen["jaccard_join"].count() < docs.count()
    assert decontamination.leaks(seen["decontamination"], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert seen["token_output"].count() == seen["mixing"].count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in seen["token_output"].collect()} <= ids


def test_odd_and_empty_documents(spark, odd, none, sf_dir, tmp_path):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.write.parquet(str(tmp_path / f"{id(docs)}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{id(docs)}-{name}"))
