"""The pipeline's stages on the smallest table, each against what brute force says of its input."""

import numpy as np

import corpus_pipeline
from quadloom import runtime
from quadloom.llm import pii
from tests.llm.test_operators import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = runtime.table(spark, SF, "documents")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = runtime.materialize(stage(spark, before, SF), "test")
        seen[name] = before, after
        if name != "packing":
            assert after.columns == columns
        before = after
    a, b = seen["quality"]
    labels = {r.doc_id: r.quality for r in runtime.table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in b.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in good]) >= 0.95
    a, b = seen["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in a.collect()]
    assert sorted(str(r.doc_id) for r in b.collect()) == sorted(d for d, _, c in components(rows, 5, 4, 5) if d == c)
    a, b = seen["pii"]
    assert a.count() == b.count()
    texts = {r.doc_id: r.text for r in a.collect()}
    changed = [r for r in b.collect() if r.text != texts[r.doc_id]]
    assert changed and pii.replace(a, key=pii.QUERY_KEY).where("pii_entities > 0").count() >= len(changed)
    a, b = seen["mixing"]
    assert 0 < b.count() < 2 * a.count()
    a, b = seen["packing"]
    assert b.where("offset + length > 2048").count() == 0 and b.select("doc_id").distinct().count() == a.select("doc_id").distinct().count()
