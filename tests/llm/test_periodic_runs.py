import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from graintide.llm import periodic_runs
from graintide.llm.periodic_runs import Grammar, kept_words, op11_periodic_runs, planted_repeats, repeated_runs, runs_of

from .helpers import ROWS, frame, texts


def plain_runs(w):
    """Maximal stretches of every period by comparison; the smallest period of each stretch."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda x: (x[0], x[2]))


def want(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def planted(rng, n, letters):
    """Random words with stretches of small and large periods, some within others."""
    w = rng.integers(0, letters, n).tolist()
    for _ in range(rng.integers(0, 5)):
        s, q = int(rng.integers(0, n)), int(rng.integers(1, max(2, n // 5)))
        for i in range(s + q, min(n, s + int(rng.integers(2, 7)) * q + int(rng.integers(0, q)))):
            w[i] = w[i - q]
    return [str(x) for x in w]


@pytest.mark.parametrize("at_once", [300_000, 20])
def test_runs_against_comparison(monkeypatch, at_once):
    monkeypatch.setattr(periodic_runs, "AT_ONCE", at_once)
    rng = np.random.default_rng(11)
    many = [planted(rng, int(rng.integers(1, 300)), int(rng.choice([1, 2, 3, 30]))) for _ in range(300)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"]]
    assert runs_of(many) == [plain_runs(w) for w in many]
    for w, runs in zip(many, runs_of(many), strict=True):
        assert kept_words(w, runs) == [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]


def test_extensions_against_comparison():
    rng = np.random.default_rng(12)
    for letters in (1, 2, 4):
        w = np.concatenate([[100], np.tile(rng.integers(0, letters, 37), 9), rng.integers(0, letters, 200), [101]])
        a = rng.integers(1, len(w) - 1, 500)
        b = rng.integers(1, len(w) - 1, 500)
        a, b = a[a != b], b[a != b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        g = Grammar(w)
        for step in (1, -1):
            plain = []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                n = 0
                while w[i + step * n] == w[j + step * n]:
                    n += 1
                plain.append(n)
            assert g.extend(a, b, step).tolist() == plain


def test_odd_rows(spark):
    got = repeated_runs(planted_repeats(frame(spark))).collect()
    assert len(got) == len(ROWS)
    rest = {r.doc_id: r.collapsed for r in got}
    assert rest[2] == rest[3] == rest[4] == "" and rest[None] == "a record without an id"
    assert repeated_runs(frame(spark, [])).collect() == []


def test_query_on_documents(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: want(k, x) for k, x in texts()}
    assert sum(r[0] > 0 for r in got.values()) > 5
