import hashlib

import numpy as np

from graintide.llm.one_perm import fingerprints

from .helpers import ROWS, frame, texts


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (-(2**62) if r[0] is None else r[0], r[1]))
    out = []
    for (k, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        out.append((k, t, t[: len(t) - half] + nxt[:half], nxt))
    return out


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_likeness(spark):
    rows = texts()
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = []
    for k, t, e, nxt in expected(rows):
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert len(r.fingerprint) == 256
        off += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, nxt)]
    assert np.abs(off).mean() < 0.04 and abs(np.mean(off)) < 0.01
    assert np.abs(off).max() < 0.25


def test_equal_texts_equal_fingerprints(spark):
    rows = texts()
    got = {r.doc_id: r.fingerprint for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by = {}
    for k, t in rows:
        assert by.setdefault(t, got[k]) == got[k]
    assert len(set(by.values())) == len(by)


def test_odd_rows(spark):
    got = fingerprints(frame(spark)).collect()
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted((len(t), hashlib.sha256(e.encode()).hexdigest()) for _, t, e, _ in expected([r[:2] for r in ROWS]))
    assert fingerprints(frame(spark, [])).collect() == []
