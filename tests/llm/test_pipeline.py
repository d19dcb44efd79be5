"""The pipeline's stages, one after another, on the smallest test set."""

from pathlib import Path

import pytest

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not mounted")
def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    out = pipeline.run(spark, DATA).collect()
    assert out and {r.doc_id for r in out} <= ids and all(r.n_tokens == len(r.ids) for r in out)
    assert [name for name, _ in pipeline.STAGES] == ["quality", "language", "near_copies", "mixture", "tokens"]


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        start, sizes = docs.count(), {}
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, DATA).cache()
            if name != "tokens":
                assert out.columns == docs.columns
            sizes[name] = out.count()
            docs = out
        if start:
            # the short, empty and repetitive rows go, all others stay; copies go; nothing is lost after the mix
            assert start > sizes["quality"] >= sizes["language"] > sizes["near_copies"] > 0
            assert sizes["tokens"] == sizes["mixture"] > 0
        else:
            assert set(sizes.values()) == {0}
