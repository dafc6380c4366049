from __future__ import annotations

import corpus_pipeline
from crawlgate.llm import language_id, packing, quality_rules
from tests.llm.plain import cut, groups, shingles


def test_run_by_plain_versions(spark):
    """Each stage on what the one before kept, by plain versions."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.query(spark, sf).collect() if r["kept"]}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    model = language_id.Model(language_id.learn(docs.filter(docs.doc_id.isin(list(kept)))))
    rows = [r for r in rows if not model.predict(r["text"])[2]]
    top = groups([shingles(r["text"], 5) for r in rows])
    rows = [r for i, r in enumerate(rows) if top[i] == i]
    bodies = [k.decode("utf-8", "ignore") for k, _, _ in cut([r["text"].encode() for r in rows])]
    encode = packing.coder(packing.tokenizer_text(), packing.split_pattern())
    expect = {(r["doc_id"], k, a, n) for r, ids in zip(rows, encode(bodies)) for k, (a, n) in enumerate(packing._cut(len(ids) // 4 + 1, 1024))}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in got} == expect
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 1024) * 1.05 + 1
