import re
from collections import defaultdict

import corpus_pipeline

from .helpers import frame

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        seen[name] = len(before) - len(after)
        docs = out
    assert seen["quality_classifier"] > 0 and seen["minhash_near_dedup"] > 0 and seen["secret_scan"] == 0
    assert not any(re.search(r'(?i)token = "[0-9a-f]{40}"', r.text or "") for r in docs.collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096


def test_odd_rows_and_an_empty_table(spark):
    for rows in (None, []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            if rows == []:
                assert out.collect() == []
            else:
                docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
