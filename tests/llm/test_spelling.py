import re
import zlib
from collections import Counter, defaultdict

import pytest

from graintide.llm import spelling
from graintide.llm.spelling import changed_run, near_words, spelling_forms, word_counts

from .helpers import ROWS, frame, texts


def counted(rows, change=True):
    found = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{w}".encode())
            if change and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def neighbours(words):
    """Near pairs by deletions: an own path, without letter counts."""
    by = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[i, w[:i] + w[i + 1 :]].add(w)  # replaced at i
    near = defaultdict(set)
    for own in by.values():
        for w in own:
            near[w] |= own - {w}
    for w in words:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    return near


def want(words):
    near, out, form = neighbours(words), {}, {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_documents_against_deletions(spark):
    rows = texts("sf0.01")
    words = counted(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling_forms(word_counts(df, change=changed_run))) == want(words)
    assert any(f is not None and r != f for f, r, *_ in want(words).values()) or len(words) > 1000


def test_odd_rows(spark):
    df = frame(spark, ROWS * 3)
    assert {r.word: r.n for r in word_counts(df, change=changed_run).collect()} == counted([r[:2] for r in ROWS * 3])
    assert {r.word: r.n for r in word_counts(df).collect()} == counted([r[:2] for r in ROWS * 3], change=False)
    assert spelling_forms(word_counts(frame(spark, []))).collect() == []


@pytest.mark.parametrize("tile, hot", [(256, 20_000), (7, 20_000), (16, 5)])
def test_edits_ties_and_chains(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "TILE", tile)
    words = {"pattern": 1000, "patern": 100, "pattren": 7, "paatern": 20, "patterns": 1000, "atterns": 6, "tternap": 50, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 124, "aaaaaaaaa": 625}
    words |= {f"{a}{b}cdef{c}": 5 + (i * 7) % 60 for i, (a, b, c) in enumerate((a, b, c) for a in "abcé" for b in "xyzÿ" for c in "klm")}
    words |= {"x" * 3000: 5, "x" * 3001: 30, "x" * 2999 + "y": 9, "abcdefgh" * 400: 5, "bacdefgh" + "abcdefgh" * 399: 8}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling_forms(df)) == want(words)
    pairs = [(r.word, r.other) for r in near_words(df).collect()]
    assert len(pairs) == len(set(pairs)) == sum(map(len, neighbours(words).values()))
