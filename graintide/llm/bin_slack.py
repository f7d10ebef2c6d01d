"""Packing by minimum bin slack.

A document is its ids and an end id.  Full pieces of the capacity are sequences of
their own; what is left of each document is one item, kept with its ids.  Items are
dealt by hash into partitions of about ``part_items``.  A partition fills one window
after the other: the longest item stands fixed, and a subset-sum dynamic program over
the multiset of the other lengths, one bitset of reachable sums for each step, finds
the sum closest to what is left; walking back over the steps gives the count of each
length.  Where no sum fits exactly, the rest of the partition goes to the next round,
which has fewer partitions; only if an eighth of its ids and more is left, an item is cut to
fill the window.  The last round is one partition: there windows are always filled by a
cut, and what fills no window at the end is cut into sequences of a power of two, which
take no padding.  So no sequence is padded.

Defined cases: null text counts as empty and is its end id alone; equal documents are
packed each; a null key is carried along; texts of any length are cut whole; an empty
table gives an empty result.  Columns other than key and text are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import keep, resident, table

CAPACITY = 2048
#: Fixed value: the split of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cut documents whose row numbers go into a filter; more are joined.
FEW = 1_000
_CUT = "doc_id long, dup long, doc_tokens long, start long, length long, ids_crc32 long, ids binary"
_PLACED = "doc_id long, dup long, doc_tokens long, start long, length long, ids_crc32 long, part int, bin long, offset long, settled boolean, whole boolean"


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Ids of a byte-level vocabulary by their bytes; None where merges aren't in the order of the ids."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if any(x >= y for x, y in itertools.pairwise(made)) or made[:1] == [-1] or len(made) + 256 > len(model["vocab"]):
        return None
    kept = set(made) | {model["vocab"][c] for c in byte}
    return {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if k in kept}


class ByteTokenizer:
    """Ids of a byte-level tokenizer.

    Where its merges stand in the order of their ids, a rank coder with the same vocabulary
    and split gives the same ids in a third of the time.  Texts with a special token's own
    text, or with separators that libraries take for white space or not, go to the tokenizer.
    """

    odd = re.compile("[\x1c-\x1f\x85\u180e]")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path) as file:
            whole = json.load(file)
        split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        usual = whole["normalizer"] is None and (whole["pre_tokenizer"] or {}).items() >= split.items() and not whole["model"].get("ignore_merges")
        ranks = _ranks(whole["model"]) if usual else None
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out = []
        for text in texts:
            if self.coder is None or self.odd.search(text) or any(x in text for x in self.special):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.coder.encode_ordinary(text)
            out.append(np.array(ids, "<u4").tobytes())
        return out


def byte_tokenizer(path: str) -> ByteTokenizer:
    return resident(f"bytes {path}", lambda: ByteTokenizer(path))


def _batch(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


_LONG = pa.int64()


def cut_items(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Full pieces of every document, and what is left of it with its ids (null in full pieces)."""
    end = struct.pack("<I", end_id)
    names, kinds = "doc_id dup doc_tokens start length ids_crc32 ids", (*(_LONG,) * 6, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = byte_tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc, dup, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), units.packed([x or "" for x in part.column(2).to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    full = n - n % capacity
                    view = memoryview(ids)
                    rows += [(doc, dup, n, s, capacity, zlib.crc32(view[4 * s : 4 * (s + capacity)]), None) for s in range(0, full, capacity)]
                    if full < n:
                        rows.append((doc, dup, n, full, n - full, zlib.crc32(view[4 * full :]), ids[4 * full :]))
                yield _batch(rows, names, kinds)

    rows = df.select(df[key].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("dup"), df[text].cast("string").alias("text"))
    return rows.mapInArrow(run, _CUT)


def closest(counts: dict[int, int], alive: int, target: int) -> tuple[int, list[tuple[int, int]]]:
    """The sum of lengths closest to target from below, and (length, count) that make it.

    ``alive`` has bit x for every length x with a count.  Lengths are taken from the longest
    down, each count in powers of two; it ends as soon as target itself is reached.
    """
    reach, goal = 1, 1 << target
    within = (goal << 1) - 1
    steps: list[tuple[int, int, int]] = []
    left = alive & within & ~1
    while left and not reach & goal:
        x = left.bit_length() - 1
        left ^= 1 << x
        most = min(counts[x], target // x)
        take = 1
        while most and not reach & goal:
            now = min(take, most)
            grown = (reach | reach << x * now) & within
            if grown != reach:
                steps.append((x, now, reach))
                reach = grown
            most -= now
            take *= 2
    best = reach.bit_length() - 1
    found, at = [], best
    for x, n, before in reversed(steps):
        if not before >> at & 1:
            found.append((x, n))
            at -= x * n
    return best, found


class _Windows:
    """Items of one partition by length: (row, start, length) each; cuts change start and length."""

    def __init__(self, lengths: np.ndarray, starts: np.ndarray, capacity: int) -> None:
        self.capacity = capacity
        self.items: dict[int, list[tuple[int, int, int]]] = {}
        for row in range(len(lengths) - 1, -1, -1):  # the first row of a length is taken first
            self.items.setdefault(int(lengths[row]), []).append((row, int(starts[row]), int(lengths[row])))
        self.alive = functools.reduce(lambda a, x: a | 1 << x, self.items, 0)
        self.counts = {x: len(own) for x, own in self.items.items()}
        self.left = int(lengths.sum())
        self.out: list[tuple[int, int, int, int, int]] = []  # row, start, length, bin, offset
        self.bins = 0

    def take(self, x: int) -> tuple[int, int, int]:
        item = self.items[x].pop()
        self.counts[x] -= 1
        self.left -= x
        if not self.counts[x]:
            self.alive ^= 1 << x
        return item

    def give(self, item: tuple[int, int, int]) -> None:
        x = item[2]
        self.items.setdefault(x, []).append(item)
        self.counts[x] = self.counts.get(x, 0) + 1
        self.alive |= 1 << x
        self.left += x

    def place(self, items: list[tuple[int, int, int]]) -> None:
        at = 0
        for row, start, length in items:
            self.out.append((row, start, length, self.bins, at))
            at += length
        self.bins += 1

    def powers(self, items: list[tuple[int, int, int]]) -> None:
        """Items that fill no window, as sequences of the powers of two of their sum."""
        total = sum(x for _, _, x in items)
        queue = items[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            if room := total & 1 << bit:
                own = []
                while room:
                    row, start, length = queue.pop()
                    if length > room:
                        queue.append((row, start + room, length - room))
                        length = room
                    own.append((row, start, length))
                    room -= length
                self.place(own)

    def pack(self, last: bool) -> list[tuple[int, int, int]]:
        """Fill windows; the items that are handed on, none in the last round."""
        hand_on = 0 if last else self.left // 8
        while self.alive:
            longest = self.alive.bit_length() - 1
            seed = self.take(longest)
            best, found = closest(self.counts, self.alive, self.capacity - longest)
            window = [seed] + [self.take(x) for x, n in found for _ in range(n)]
            room = self.capacity - longest - best
            if room and not last and self.left + self.capacity - room <= hand_on:
                return window + [item for own in self.items.values() for item in own]
            if room and self.alive:  # every item left is longer than the room
                row, start, length = self.take(self.alive.bit_length() - 1)
                window.append((row, start, room))
                self.give((row, start + room, length - room))
                room = 0
            if not room:
                self.place(window)
            elif last:
                self.powers(window)
            else:
                return window
        return []


def _packer(capacity: int, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "dup", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths, starts = pdf["length"].to_numpy(), pdf["start"].to_numpy()
        windows = _Windows(lengths, starts, capacity)
        rest = windows.pack(last)
        placed = np.array(windows.out + [(*item, -1, 0) for item in rest], np.int64).reshape(-1, 5)
        out = pdf.iloc[placed[:, 0]].reset_index(drop=True)
        whole = (out["length"].to_numpy() == placed[:, 2]) & out["whole"].to_numpy()
        return out[["doc_id", "dup", "doc_tokens"]].assign(start=placed[:, 1], length=placed[:, 2], ids_crc32=out["ids_crc32"].where(whole, 0), part=out["part"], bin=placed[:, 3], offset=placed[:, 4], settled=placed[:, 3] >= 0, whole=whole)

    return pack


def pack_slack(items: DataFrame, capacity: int = CAPACITY, part_items: int = 20_000) -> DataFrame:
    """Sequence and offset of every piece of items, the kept table of ``cut_items``.

    Each round keeps the filled windows and deals the rest over fewer partitions, until it is one.
    """
    row = ["doc_id", "dup", "doc_tokens", "start", "length", "ids_crc32"]
    place = [*row, "sequence_id", "offset"]
    done = [items.filter("ids is null").select(*row, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, cuts = items.filter("ids is not null").select(*row, F.lit(True).alias("whole")), []
    k = 0
    while True:
        parts = max(1, -(-rest.count() // part_items))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(k), "dup", "start"), F.lit(parts)).cast("int"))
        packed = keep(dealt.groupBy("part").applyInPandas(_packer(capacity, parts == 1), _PLACED), f"slack{k}")
        found = packed.filter("settled").withColumn("sequence_id", F.lit(k << 52) + F.col("part").cast("long") * (1 << 20) + F.col("bin"))
        done.append(found.filter("whole").select(*place))
        cuts.append(found.filter("not whole").select(*place))
        if parts == 1:
            break
        rest = packed.filter("not settled").select(*row, "whole")
        k += 1
    return functools.reduce(DataFrame.unionByName, [*done, _digests(functools.reduce(DataFrame.unionByName, cuts), items)])


def _digests(cuts: DataFrame, items: DataFrame) -> DataFrame:
    """The cut items' pieces with the digest of their ids; only the cut items' rows of the kept table are read for these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, first = (batch.column(c).to_pylist() for c in (3, 4, 8))
            own = [zlib.crc32(memoryview(x)[4 * (s - f) : 4 * (s - f + n)]) for s, n, f, x in zip(start, length, first, batch.column(9).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own, _LONG), *batch.columns[6:8]], names=batch.schema.names[:8])

    few = cuts.select("dup").distinct().limit(FEW + 1).collect()
    kept = items.filter("ids is not null").select("dup", F.col("start").alias("_first"), "ids")
    if len(few) <= FEW:
        kept = F.broadcast(kept.filter(F.col("dup").isin([r.dup for r in few])))
    schema = cuts.schema
    return cuts.join(kept, "dup").select(*schema.names, "_first", "ids").mapInArrow(run, schema)


def op12_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    items = keep(cut_items(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "items")
    return pack_slack(items).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
