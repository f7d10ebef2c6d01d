import itertools
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graintide.llm.bin_slack import ByteTokenizer, _Windows, closest, cut_items, pack_slack
from graintide.llm.common import keep

from .helpers import ROWS, frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a<|endoftext|>b", "<|endoftext|>", "a  b   c\n\nd \n e\t f ", "it's  DON'T we'll x 　y", "x\x1cy \x1f z \x85 q", "  ", "\n", " lead", "½ ² Ⅷ ٣ 一二 नमस्ते é́", "a\r\n b c", "᠎ x​ y"]


def checked(got, rows, capacity=2048):
    """The sequences' fills, after every piece is held against the library's ids."""
    t = Tokenizer.from_file(PATH)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {k for k, _ in rows}
    texts_of = defaultdict(list)
    for k, text in rows:
        texts_of[k].append(text)
    for k, own in texts_of.items():
        ids = [*t.encode(own[0] or "", add_special_tokens=False).ids, 1]
        assert len(set(own)) == 1
        seen = np.zeros(len(ids), int)
        for r in pieces[k]:
            assert r.doc_tokens == len(ids) and r.length > 0
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            seen[r.start : r.start + r.length] += 1
        assert (seen == len(own)).all()
    fills = []
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        fills.append(at)
    assert all(x & (x - 1) == 0 for x in fills)  # the capacity, or a power of two: no padding
    return fills


def run(df, **more):
    return pack_slack(keep(cut_items(df, PATH), "items"), **more).collect()


def test_odd_rows(spark):
    checked(run(frame(spark)), [r[:2] for r in ROWS])
    assert run(frame(spark, [])) == []
    rows = list(enumerate(ODD))
    checked(run(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_ids_as_in_the_library():
    t, own = Tokenizer.from_file(PATH), ByteTokenizer(PATH)
    many = [x for _, x in texts("sf0.001")] + ODD
    assert own.coder is not None
    coder = own.coder
    for own.coder in (coder, None):
        assert own.packed(many) == [struct.pack(f"<{len(i)}I", *i) for i in (t.encode(x or "", add_special_tokens=False).ids for x in many)]


@pytest.mark.parametrize("part_items, more", [(20_000, 60), (100, 200)])
def test_documents(spark, part_items, more):
    rows = texts("sf0.01")
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), part_items=part_items)
    fills = checked(got, rows)
    assert sum(x < 2048 for x in fills) <= 11
    least = sum(-(-r.doc_tokens // 2048) for r in got if r.start == 0)
    assert len(got) <= least + more  # few documents are cut more than they must be


def test_equal_lengths_are_cut(spark):
    rows = [(k, "the " * 1498 + "end") for k in range(300)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), part_items=40)
    checked(got, rows)


def test_closest_sum_against_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lengths = rng.integers(1, 60, size=rng.integers(0, 9)).tolist()
        target = int(rng.integers(0, 150))
        counts = {x: lengths.count(x) for x in lengths}
        best, found = closest(counts, sum(1 << x for x in counts), target)
        sums = {sum(c) for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n)}
        assert best == max(s for s in sums if s <= target) == sum(x * n for x, n in found)
        for x in counts:
            assert sum(n for y, n in found if y == x) <= counts[x]


def test_windows_keep_every_item():
    rng = np.random.default_rng(4)
    for last in (False, True):
        lengths = rng.integers(1, 100, size=500)
        w = _Windows(lengths, np.zeros(500, int), 100)
        rest = w.pack(last)
        seen = [set() for _ in lengths]
        for row, start, length in [x[:3] for x in w.out] + rest:
            own = set(range(start, start + length))
            assert not own & seen[row]
            seen[row] |= own
        assert [len(x) for x in seen] == lengths.tolist() and (not last or not rest)
