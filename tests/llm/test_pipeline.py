"""The pipeline: each stage against a plain version of it."""

import pytest

import corpus_pipeline
from gaugewright.llm import language_id
from test_dedup import plain_near
from test_tokens import check_packing


@pytest.fixture(scope="module")
def data():
    return "/root/testdata/sf0.001"


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "packing"]
    rejected = {r["doc_id"] for r in language_id.identify(docs).where("rejected").collect()}
    want = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in rejected}
    for (name, stage), narrow in zip(corpus_pipeline.STAGES[:-1], (lambda w: w, exact, near), strict=True):
        docs = stage(spark, docs, data)
        want = narrow(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
    final = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    check_packing(final, list(want.items()), 2048)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()} == set(want)


def exact(docs):
    last = {}
    for i in sorted(docs):
        last[docs[i]] = i
    return {i: docs[i] for i in last.values()}


def near(docs):
    return {i: docs[i] for i, _, _, kept in plain_near(list(docs.items())) if kept}


def test_stages_take_empty_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data) if "text" in docs.columns else docs
        assert docs.count() == 0
