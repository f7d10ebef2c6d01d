import math
import zlib
from collections import Counter

import xxhash

from graintide.llm.sharding import shard_records

from .helpers import ROWS, frame


def brute(key, weights):
    text = "\x00null" if key is None else str(key)

    def cost(i):
        h = xxhash.xxh64_intdigest(f"shard|{text}|{i}".encode(), seed=42) >> 11
        return -math.log((h + 0.5) / 2**53) / weights[i]

    return min(range(len(weights)), key=cost)


def test_matches_brute_force_with_weights(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    got = shard_records(frame(spark), weights=weights, new_weight=3.0, slot_buckets=4).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.shard == brute(r.doc_id, weights)
        assert r.grown_shard == brute(r.doc_id, [*weights, 3.0])
        assert r.grown_shard in (r.shard, 4)
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_empty(spark):
    assert shard_records(frame(spark, [])).collect() == []


def test_shares_follow_weights(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    n = Counter(r.shard for r in shard_records(rows, weights=[1.0, 3.0]).collect())
    assert 0.7 < n[1] / 4000 < 0.8
