import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from graintide.llm.packing import best_fit_decreasing, cut, lower_bound, pack

from .helpers import ROWS, frame, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(rows, capacity=4096):
    t = Tokenizer.from_file(PATH)
    out = Counter()
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            own = ids[s : s + capacity]
            out[(k, p, s, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))] += 1
    return out


def checked(rows, capacity=4096):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_odd_rows(spark):
    got = pack(cut(frame(spark), PATH)).collect()
    checked(got)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want([r[:2] for r in ROWS])
    assert pack(cut(frame(spark, []), PATH)).collect() == []


def test_documents_in_small_partitions(spark):
    rows = texts("sf0.01")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(cut(df, PATH), part_items=200).collect()
    n = checked(got)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want(rows)
    bound = lower_bound(np.bincount([r.length for r in got], minlength=4097), 4096)
    assert bound <= n <= 1.02 * bound + 1


def test_special_tokens_and_odd_letters_as_in_the_library(spark):
    odd = ["a<|endoftext|>b", "<|startoftext|>", "x <|endoftext|>\u3000y", "DON'T can'T", "\u0130! \u03a3\u03a3 \u03c2", "e\u0301 \x1c a\x1fb", "ÀÉ\u017f's", "\u212a"]
    rows = list(enumerate(odd))
    got = pack(cut(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want(rows)


def test_partitions_carry_their_certificate(spark):
    got = pack(cut(spark.createDataFrame(texts("sf0.01"), "doc_id long, text string"), PATH), part_items=200).collect()
    assert all(r.part_bound <= r.part_bins for r in got)
    gaps = {(r.part_bins, r.part_bound) for r in got}
    assert sum(b == n for n, b in gaps) >= len(gaps) / 2 and all(n <= 1.02 * b + 1 for n, b in gaps)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x = rng.integers(1, 101, size=rng.integers(1, 60))
        where, offset, fill = best_fit_decreasing(x, 100)
        assert fill.max() <= 100
        assert np.array_equal(np.bincount(where, weights=x).astype(int), fill)
        assert lower_bound(np.bincount(x, minlength=101), 100) <= len(fill)
    assert lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7


def test_stage_reads_small_batches_and_remembers_few_words(spark, monkeypatch):
    from graintide.llm import packing

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen = []
    own = packing.keep
    monkeypatch.setattr(packing, "keep", lambda df, kept: seen.append((kept, spark.conf.get(name))) or own(df, kept))
    before = spark.conf.get(name)
    got = packing.packing_stage(spark, frame(spark), "").collect()
    assert seen[0] == ("pieces", str(packing.TEXTS)) and spark.conf.get(name) == before
    monkeypatch.undo()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want([x[:2] for x in ROWS])
    small = packing.WordTokenizer(PATH, 50)
    for k in range(20):
        small.packed([" ".join(f"w{k}x{i}" for i in range(60))])
        assert len(small.memo) + len(small.older) <= 240
    assert small.packed([t or "" for _, t in texts()]) == packing.WordTokenizer(PATH).packed([t or "" for _, t in texts()])
