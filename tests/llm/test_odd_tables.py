"""Every query and stage on odd and on empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from crawlgate import llm

#: Rows that a query returns for the odd table's 16, where not one for each.
MORE = {"op2_license_scan": 1, "op9_best_fit_packing": None}


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_odd_table(spark, odd, name):
    rows = llm.queries()[name](spark, odd).collect()
    if MORE.get(name, 16) is not None:
        assert len(rows) == MORE.get(name, 16)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)[:1]


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_empty_table(spark, none, name):
    assert llm.queries()[name](spark, none).collect() == []


def test_stages_keep_the_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.schema.names == docs.schema.names
        out.collect()


def test_stages_on_nothing(spark, none):
    docs = spark.read.parquet(f"{none}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, none).collect() == []
    assert corpus_pipeline.run(spark, none).collect() == []
