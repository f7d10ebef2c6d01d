import hashlib
import random
import struct

import public_tokenizers
import sentencepiece

from graintide.llm.piece_bpe import encode_decode, piece_table

from .helpers import ROWS, frame, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = sp.encode(text, add_bos=True, add_eos=True)
    return ids, sp.decode(ids)


def test_equals_library_on_documents():
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_table(MODEL)
    for _, t in texts():
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert mine.encode(t) == ids
        assert mine.decode(ids) == sp.decode(ids)


def test_equals_library_on_odd_strings():
    rng, mine, sp = random.Random(3), piece_table(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    parts = ["a", "e", "the", "  ", " ", "\n", "\t", "é", "日本", "🙂", "▁", "\x00", "ing", "'s", "12", "​", "ﬁ", "====", " " * 20]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = sp.encode(s, add_bos=True, add_eos=True)
        assert mine.encode(s) == ids
        assert mine.packed(s)[1] == sp.decode(ids)


def test_rows(spark):
    got = sorted((r.doc_id is None, r.doc_id, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in encode_decode(frame(spark), MODEL).collect())
    want = []
    for k, t, *_ in ROWS:
        ids, back = library(t or "")
        want.append((k is None, k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_decode(frame(spark, []), MODEL).collect() == []
