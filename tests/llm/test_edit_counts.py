import random

import public_tokenizers

from graintide.llm.edit_counts import Counted, counter, counts_under_edits, edits_of

from .helpers import ROWS, frame, texts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def applied(text, edits):
    for start, end, new in edits:
        end = min(end, len(text))
        start = min(start, end)
        text = text[:start] + new + text[end:]
    return text


def full(text):
    return len(counter(RANKS, PATTERN).coding.encode_ordinary(text))


def test_random_edits_equal_a_full_count():
    rng, own = random.Random(7), counter(RANKS, PATTERN)
    parts = ["a", "word", " ", "  ", "\n", "\n\n", "'s", "12", "é", "日本", "!!", " \t", "don't", " the"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(150):
        text = make(rng.choice([0, 3, 100, 900]))
        doc = Counted(text, own)
        for _ in range(12):
            a = rng.randint(0, len(text) + 2)
            edit = (a, a + rng.choice([0, 1, 5, 300]), make(rng.choice([0, 1, 4, 200])))
            doc.edit(*edit)
            text = applied(text, [edit])
            assert (doc.chars, doc.tokens) == (len(text), full(text))
            assert "".join(t for leaf in doc.leaves for t in leaf) == text


def test_documents(spark):
    rows = texts()
    got = {r.doc_id: r for r in counts_under_edits(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, PATTERN).collect()}
    for k, t in rows:
        new = applied(t, edits_of(t))
        assert (got[k].n_tokens, got[k].n_tokens_edited, got[k].n_chars_edited) == (full(t), full(new), len(new))
    long = [k for k, t in rows if len(t) > 8000]
    assert long and all(got[k].n_chars_recoded < len(dict(rows)[k]) for k in long)


def test_odd_rows(spark):
    got = counts_under_edits(frame(spark), RANKS, PATTERN).collect()
    assert sorted((r.n_tokens, r.n_tokens_edited) for r in got) == sorted((full(t or ""), full(applied(t or "", edits_of(t or "")))) for _, t, *_ in ROWS)
    assert counts_under_edits(frame(spark, []), RANKS, PATTERN).collect() == []
