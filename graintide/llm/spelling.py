"""Spelling variants by blocked Gram matrices of letter counts.

Words are counted over all texts, each task adding up its own before the shuffle.
Two words one edit apart have letter counts at a squared distance of at most two and
lengths at most one apart, and the edit leaves the first or the second half of the
shorter word as it is.  So a word of length L stands in four blocks: that of its first
and that of its second half at lengths L and L + 1, and at L - 1 and L.  Blocks are
gathered into tiles of at most TILE rows; a NumPy product of a tile's count matrices
gives all squared distances, pairs of at most two stay, and their letters are then
compared.  A pair that keeps both halves counts in the first half's block only.  A
block of more than HOT words is dealt as pairs of parts over several tasks.

A word's form is its near word of largest count, if that is ``ratio`` times its own or
more; roots follow forms to the last one by pointer doubling.

Defined cases: null texts have no word; repeated rows count again; a null key counts as
the text "None" where a change asks for it; texts and words of any length are taken whole; words have
characters up to U+00FF only; an empty table gives an empty result.  Columns other
than key and text are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import keep, table

#: Latin letters in ISO 8859-1, lower case below 128.
RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: Distinct words that a task adds up before it passes them on.
HELD = 300_000
#: Rows of a tile and cells of its letters; words of a block that one task takes.
TILE, CELLS, HOT = 256, 4_000_000, 20_000
#: Rows of hot blocks that are broadcast; more are joined by shuffling.
SMALL = 100_000
PLANTED = 199

Change = Callable[[int, bytes], bytes]


def changed_run(crc: int, run: bytes) -> bytes:
    """The run without its letter at crc modulo length, where PLANTED divides crc."""
    if crc % PLANTED:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", change: Change | None = None, least_length: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the words of all texts that are long and frequent enough.

    ``change`` maps the crc32 of "<key>:<run>" and the run to the word that is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            own = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= least_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(RUN.findall((body or "").encode("latin-1", "replace").lower()))
                if change is not None:
                    start = zlib.crc32(b"%s:" % str(doc).encode())
                    for w, n in own.items():
                        held[change(zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start), w)] += n
                else:
                    held.update(own)
                if len(held) >= HELD:
                    yield out()
        yield out()

    rows = df.select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def blocks(words: DataFrame) -> DataFrame:
    """words once for each of their four blocks: length of the shorter words, which half, its letters, part and turn of a large block."""
    size = F.length("word")
    half = lambda base, first: F.expr(f"left(word, int({base} / 2))" if first else f"right(word, {base} - int({base} / 2))")
    found = [F.struct((size - d).cast("int").alias("base"), F.lit(first).alias("first"), half(f"(length(word) - {d})", first).alias("half")) for d in (0, 1) for first in (True, False)]
    rows = words.select("word", "n", F.explode(F.array(*found)).alias("b")).select("word", "n", "b.*").filter("base > 0")
    key = ["base", "first", "half"]
    hot = keep(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > HOT), "hot")
    n = hot.count()
    if n == 0:
        return rows.withColumns({"turn_a": F.lit(0), "turn_b": F.lit(0), "part": F.lit(0)})
    rows = rows.join(F.broadcast(hot) if n <= SMALL else hot, key, "left").withColumn("_parts", F.ceil(F.coalesce("_size", F.lit(1)) / HOT).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows.withColumns({"turn_a": F.least("part", "_other"), "turn_b": F.greatest("part", "_other")}).drop("_size", "_parts", "_other")


_CODE = np.full(256, 90, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[192:256] = np.arange(26, 90)


class _Words:
    """Words with their letters, letter counts and groups (rows of one block, in sequence)."""

    def __init__(self, words: list[bytes], group: np.ndarray, base: np.ndarray, first: np.ndarray, part: np.ndarray, whole: np.ndarray) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.group, self.base, self.first, self.part, self.whole = group, base, first, part, whole
        width = int(self.size.max(initial=0))
        self.letters = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
        rows = np.repeat(np.arange(len(words)), self.size)
        kind = np.float32 if width < 2000 else np.float64  # squares stay exact
        codes = _CODE[np.frombuffer(b"".join(words), np.uint8)]
        self.counts = np.bincount(rows * 91 + codes, minlength=91 * len(words)).reshape(-1, 91).astype(kind)
        self.square = (self.counts * self.counts).sum(1)

    def near(self, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """Rows a < b of the two slices, of one block, whose words are one edit apart."""
        gram = self.counts[i] @ self.counts[j].T
        gram *= 2
        apart = self.square[i][:, None] + self.square[j][None, :]
        apart -= gram
        a, b = np.nonzero((apart < 2.5) & (self.group[i][:, None] == self.group[j][None, :]))
        a, b = a + i.start, b + j.start
        sa, sb = self.size[a], self.size[b]
        good = (a < b) & (abs(sa - sb) <= 1) & (np.minimum(sa, sb) == self.base[a]) & (self.whole[a] | (self.part[a] != self.part[b]))
        a, b = a[good], b[good]
        less = self.size[a] > self.size[b]
        short, long = np.where(less, b, a), np.where(less, a, b)
        n = self.size[short]
        at = np.arange(self.letters.shape[1])
        ahead = ((self.letters[short] != self.letters[long]) | (at >= n[:, None])).argmax(1) if len(n) else n
        ahead = np.where((self.letters[short] == self.letters[long]).all(1), n, np.minimum(ahead, n))
        # letters behind the first difference must be the same: one place further in the longer word
        more = self.size[long] - n
        rest = np.minimum(at[None, :] + more[:, None], self.letters.shape[1] - 1)
        behind = (self.letters[short] == np.take_along_axis(self.letters[long], rest, 1)) | (at < (ahead + (more == 0))[:, None]) | (at >= n[:, None])
        good = behind.all(1) & ((more == 1) | (ahead < n))
        # a pair that keeps its first half belongs to that half's block
        good &= self.first[a] | (ahead < self.base[a] // 2)
        return a[good], b[good]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, other, other_n), both ways, of rows sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
        if not held:
            continue
        rows = pa.Table.from_batches(held)
        held = []
        same = np.ones(rows.num_rows - 1, bool)
        for c in ("base", "first", "half", "turn_a", "turn_b"):
            column = rows.column(c).combine_chunks()
            same &= pa.compute.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(~same) + 1, rows.num_rows)
        if batch is not None:  # the last block may go on
            cut = int(ends[-2]) if len(ends) > 1 else 0
            held, ends = rows.slice(cut).to_batches(), ends[:-1]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        yield from _tiles(rows, starts, ends)


def _tiles(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    big = ends - starts > 1
    starts, ends = starts[big], ends[big]
    k = 0
    while k < len(starts):
        last, total = k, int(ends[k] - starts[k])
        while last + 1 < len(starts) and total + ends[last + 1] - starts[last + 1] <= TILE:
            last += 1
            total += int(ends[last] - starts[last])
        at = np.concatenate([np.arange(s, e) for s, e in zip(starts[k : last + 1], ends[k : last + 1], strict=True)])
        group = np.repeat(np.arange(last + 1 - k), ends[k : last + 1] - starts[k : last + 1])
        k = last + 1
        own = rows.take(pa.array(at))
        number = lambda c: own.column(c).to_numpy()  # noqa: B023, E731
        names, n = own.column("word").to_pylist(), number("n")
        words = [w.encode("latin-1") for w in names]
        found = _Words(words, group, number("base"), number("first"), number("part"), number("turn_a") == number("turn_b"))
        step = max(1, min(TILE, CELLS // max(1, found.letters.shape[1])))
        for i in range(0, len(words), step):
            for j in range(i, len(words), step):
                a, b = found.near(slice(i, min(i + step, len(words))), slice(j, min(j + step, len(words))))
                if len(a):
                    both, other = np.concatenate([a, b]), np.concatenate([b, a])
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in both]), pa.array([names[x] for x in other]), pa.array(n[other])], names=["word", "other", "other_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): every pair of words (word, n) that are one edit apart, both ways."""
    order = ["base", "first", "half", "turn_a", "turn_b"]
    dealt = blocks(words).repartition(*order).sortWithinPartitions(*order)
    return dealt.select(*order, "part", "word", "n").mapInArrow(_near, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the last form of their chain."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = keep(now.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if now.filter("_moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("_moved")


def spelling_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n)."""
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    good = F.expr(f"-best.less >= {ratio} * n")
    named = keep(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(named.filter("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(keep(word_counts(table(spark, sf_dir, "documents"), change=changed_run), "words"))
