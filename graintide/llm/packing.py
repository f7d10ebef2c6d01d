"""Best-fit packing with certified bounds.

Documents become ids plus an end id; only those longer than the capacity are
cut, into full pieces and a last shorter one.  Full pieces are sequences of
their own.  The others are dealt by hash into partitions of about
``part_items`` pieces, each packed by best-fit decreasing.  Dual feasible
functions give a lower bound on each partition's bins.  A partition that meets
its bound is done.  In partitions with a gap, the pieces of the bins that are
not full are put up for exchange: they are dealt anew over fewer, fuller
partitions and packed again, for ``rounds`` rounds.  Bins once full stay.  The last round's bins
stay as they are; each piece carries its partition's bins and bound, so a gap shows.
Tokens' own texts in a document (such as an end-of-text mark) get their special ids, as
the tokenizer does by default.

Defined cases: null text counts as empty and is one piece of one id; equal
documents are packed as separate pieces; an empty table gives an empty result;
columns other than key and text are not read.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import arrow_rows, keep, resident, table

CAPACITY = 4096
_PIECES = "doc_id long, dup long, piece int, start long, length long, ids_crc32 long"
#: Words remembered in each of two generations; a word met again moves to the younger one.
MEMO = 450_000
#: The same in the pipeline, whose executors hold more from earlier stages: a word takes 200 to 250 bytes.
STAGE_MEMO = 120_000
#: Texts that go to a task in one batch.
TEXTS = 512
MEMO_CHARS = 64


#: Letters up to here lower one by one and compose no further, whatever stands beside them.
_PLAIN = "\u0250"


class WordTokenizer:
    """Ids of a tokenizer whose words never span white space, remembered by word.

    Texts that hold a special token's own text go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = MEMO) -> None:
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.most = most
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The words, in lower case where that can't change their ids."""
        if self.odd.search(text):  # white space to Python alone
            return self.words.findall(text)
        if text and "\u0130" not in text and max(text) < _PLAIN:
            text = text.lower()
        return text.split()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        whole = {k for k, t in enumerate(texts) if any(x in t for x in self.special)}
        split = [[] if k in whole else self.split(t) for k, t in enumerate(texts)]
        if len(self.memo) > self.most:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        for w in set().union(*split):
            if w in memo:
                continue
            if (known := older.get(w)) is None:
                new.append(w)
            else:
                memo[w] = known
        long = {}
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            for w, ids in zip(part, self._encoded(part), strict=True):
                (memo if len(w) <= MEMO_CHARS else long)[w] = ids
        if long:
            out = [b"".join([memo[w] if len(w) <= MEMO_CHARS else long[w] for w in ws]) for ws in split]
        else:
            out = [b"".join(map(memo.__getitem__, ws)) for ws in split]
        for k in whole:
            out[k] = self._encoded([texts[k]])[0]
        return out


def word_tokenizer(path: str, most: int = MEMO) -> WordTokenizer:
    return resident(f"words {path} {most}", lambda: WordTokenizer(path, most))


def cut(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text", memo: int = MEMO) -> DataFrame:
    """Pieces of every document: place in its ids, length and digest."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer, memo)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = []
                for doc, dup, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), words.packed([x or "" for x in part.column(2).to_pylist()]), strict=True):
                    ids += end
                    view = memoryview(ids)
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = view[4 * start : 4 * (start + capacity)]
                        rows.append((doc, dup, piece, start, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "dup", "piece", "start", "length", "ids_crc32"])

    rows = df.select(df[key].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("dup"), df[text].cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and dual feasible functions.

    counts[x] is the number of pieces of length x.
    """
    x = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    total = np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate([[0], np.cumsum(counts * x)])
    half = capacity // 2
    for a in range(half + 1):
        # over capacity - a: one bin each; from a to that: their length; below a: nothing
        big = total[capacity + 1] - total[capacity - a + 1]
        best = max(best, int(big) - (-int(weight[capacity - a + 1] - weight[a]) // capacity))
    for k in range(1, 21):
        # f(x) = x where (k + 1) x is a multiple of the capacity, else the step below it
        scaled = (k + 1) * x
        steps = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * steps).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin.  Ties: input order, newest bin."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r exists
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            left = size + ((fits & -fits).bit_length() - 1)
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if left := left - size:
            room[left].append(b)
            some |= 1 << left
    return where, offset, np.array(fill, np.int64)


def _packer(capacity: int, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "dup"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        settled = np.full(len(fill), True) if last or len(fill) <= bound else fill == capacity
        return pdf[["doc_id", "dup", "piece", "start", "length", "ids_crc32", "part"]].assign(bin=where, offset=offset, settled=settled[where], bins=len(fill), bound=bound)

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_items: int = 20_000, rounds: int = 3) -> DataFrame:
    """Sequence and offset of every piece, and bins and bound of the partition that it was packed in last.

    A partition holds about ``part_items`` pieces whatever the input's size, so a
    task's memory is bounded; each round keeps what is settled and deals the rest anew.
    """
    key = F.xxhash64("doc_id", "dup", "piece")
    row = ["doc_id", "dup", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity)
    one = F.lit(1).cast("long")
    done = [full.select(*row, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("part_bins"), one.alias("part_bound"))]
    rest = pieces.filter(F.col("length") < capacity)
    schema = "doc_id long, dup long, piece int, start long, length long, ids_crc32 long, part int, bin long, offset long, settled boolean, bins long, bound long"
    for k in range(rounds):
        parts = max(1, -(-rest.count() // part_items))
        last = k == rounds - 1 or parts == 1
        dealt = rest.select(*row, F.pmod(F.xxhash64(F.lit(k), key), F.lit(parts)).cast("int").alias("part"))
        packed = keep(dealt.groupBy("part").applyInPandas(_packer(capacity, last), schema), f"packed{k}")
        done.append(packed.filter("settled").select(*row, (F.lit(k << 58) + F.col("part").cast("long") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset", F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound")))
        if last:
            break
        rest = packed.filter("not settled").select(*row)
    every = functools.reduce(DataFrame.unionByName, done)
    return every.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound")


def _packed(docs: DataFrame, memo: int) -> DataFrame:
    import public_tokenizers

    with arrow_rows(docs.sparkSession, TEXTS):
        pieces = keep(cut(docs, public_tokenizers.path("word_bpe_49k.json"), memo=memo), "pieces")
    return pack(pieces)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(table(spark, sf_dir, "documents"), MEMO)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' pieces with their sequences.

    Null and empty texts are one piece of the end id; equal documents are packed each;
    an empty table gives an empty result; other columns are not read.
    """
    return _packed(docs, STAGE_MEMO)
