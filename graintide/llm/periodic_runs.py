"""Repeated stretches of words by recompression.

The words of many texts stand in one sequence of symbols, each text behind a separator
of its own.  Rounds of block compression (equal neighbours become one symbol with a
count) and pair compression (two classes of symbols; a symbol of the first and one of
the second behind it become one) make a run-length grammar whose cuts depend on a
symbol and its neighbours only.  So two places whose words agree are cut alike, but
for a step at either end of each level, and their longest common extension takes a
step or two a level: up while what follows has the same cuts, then down to the first
difference.  NumPy does this for all candidates of a direction at once.

A run of period q and 4 q words or more has a place i that 3 q divides with i and i + q
in it.  These are the candidates, where the two words are equal; the extensions to both
sides give the exact run, and of the periods that give the same stretch the smallest is
its own.

Defined cases: null texts have no word, no run and an empty rest; texts without white
space are one word; texts of any length are taken whole, in groups by length; repeated
rows are rows of their own; a null key is carried along; an empty table gives an empty
result.  Columns other than key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import table

WORD = re.compile("[^ \t-\r]+")
#: The same for built-in functions.
WORD_SQL = "[^\\x20\\x09-\\x0D]+"
#: A run has REPEATS periods at least, and LEAST words.
REPEATS, LEAST = 4, 6
#: Characters of the texts that stand in one sequence, and candidates that are extended at once.
CHARS, AT_ONCE = 1_500_000, 300_000
_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Level:
    """Symbols of a level, and how they stand in those of the level below."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, below: int, block: bool) -> None:
        self.symbols, self.first, self.block = symbols, first, block
        self.last = np.append(first[1:], below) - 1
        self.up = np.repeat(np.arange(len(first)), self.last - first + 1)


class Grammar:
    """Levels of a sequence, made as extensions ask for them.  Its ends must be symbols that occur once."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.next_symbol = int(symbols.max(initial=0)) + 1
        self.levels = [_Level(symbols, np.arange(len(symbols)), len(symbols), False)]

    def grow(self) -> None:
        block = len(self.levels) % 2 == 1
        below = self.levels[-1].symbols
        start = self._blocks(below) if block else self._pairs(below)
        first = np.flatnonzero(start)
        symbols = below[first].copy()
        size = np.diff(np.append(first, len(below)))
        more = size > 1
        if more.any():
            second = size[more] if block else below[first[more] + 1]
            _, code = np.unique(symbols[more] * np.int64(1 << 32) + second, return_inverse=True)
            symbols[more] = self.next_symbol + code
            self.next_symbol += int(code.max()) + 1
        self.levels.append(_Level(symbols, first, len(below), block))

    @staticmethod
    def _blocks(symbols: np.ndarray) -> np.ndarray:
        return np.append(True, symbols[1:] != symbols[:-1])

    def _pairs(self, symbols: np.ndarray) -> np.ndarray:
        """Starts: every symbol but those of the second class behind one of the first."""
        bits = (symbols + len(self.levels)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        side = ((bits ^ bits >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)
        one, other = side[:-1] & ~side[1:], ~side[:-1] & side[1:]
        return np.append(True, ~(one if one.sum() >= other.sum() else other))

    def extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How far the symbols from places a and b on (step 1), or from them backwards (step -1), agree; a != b everywhere."""
        begun = a
        out = np.zeros(len(a), np.int64)
        parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = np.arange(len(a))
        k = 0
        while True:  # up: what follows is cut alike at level k
            symbols = self.levels[k].symbols
            same = symbols[a] == symbols[b]
            parted.append((own[~same], a[~same], b[~same]))
            own, a, b = own[same], a[same], b[same]
            if not len(own):
                break
            if len(self.levels) == k + 1:
                self.grow()
            above = self.levels[k + 1]
            near, far = (above.first, above.last) if step > 0 else (above.last, above.first)
            inside = (near[above.up[a]] != a) | (near[above.up[b]] != b)
            move = np.where(inside, np.minimum(abs(far[above.up[a]] - a), abs(far[above.up[b]] - b)) + 1, 0)
            if not above.block:
                move = np.minimum(move, 1)
            a, b = a + step * move, b + step * move
            out_of_step = (near[above.up[a]] != a) | (near[above.up[b]] != b)
            if out_of_step.any():  # one is still within its block, the other is behind it
                parted[k] = tuple(np.concatenate([x, y[out_of_step]]) for x, y in zip(parted[k], (own, a, b), strict=True))
                own, a, b = own[~out_of_step], a[~out_of_step], b[~out_of_step]
            a, b = above.up[a], above.up[b]
            k += 1
        own, a, b = parted[k]
        for k in range(len(parted) - 1, 0, -1):  # down: to the first difference
            level, below = self.levels[k], self.levels[k - 1].symbols
            near = level.first if step > 0 else level.last
            size_a, size_b = level.last[a] - level.first[a] + 1, level.last[b] - level.first[b] + 1
            a, b = near[a], near[b]
            move = np.where(below[a] == below[b], np.minimum(size_a, size_b) if level.block else 1, 0)
            a, b = a + step * move, b + step * move
            own, a, b = (np.concatenate([x, y]) for x, y in zip((own, a, b), parted[k - 1], strict=True))
        out[own] = a
        return abs(out - begun)


def _candidates(symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of equal words on the grids, about AT_ONCE at a time; texts stand from the longest down, text k before ends[k]."""
    places, periods, held = [], [], 0
    for q in range(1, int(sizes.max(initial=0)) // REPEATS + 1):
        n = int(np.searchsorted(-sizes, -max(LEAST, REPEATS * q), "right"))
        if not n:
            break
        end, step = int(ends[n - 1]), (REPEATS - 1) * q
        at = np.flatnonzero(symbols[: end - q : step] == symbols[q:end:step]) * step
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held >= AT_ONCE:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text's words, by start and period."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    ends = np.cumsum(sizes + 1)  # the separator in front of a text belongs to it
    ids: dict[str, int] = {}
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    at = 0
    for k, n in zip(order, sizes.tolist(), strict=True):
        symbols[at + 1 : at + 1 + n] = [ids.setdefault(w, len(ids)) for w in texts[k]]
        at += n + 1
    begins = np.append(ends - sizes - 1, at)
    symbols[begins] = len(ids) + np.arange(len(begins))
    grammar = Grammar(symbols)
    best: dict[tuple[int, int], int] = {}
    for place, q in _candidates(symbols, ends, sizes):
        behind = grammar.extend(place, place + q, 1)
        ahead = grammar.extend(place - 1, place + q - 1, -1)
        length = behind + ahead + q
        good = length >= np.maximum(LEAST, REPEATS * q)
        found = np.unique(np.stack([(place - ahead)[good], length[good], q[good]], 1), axis=0)
        for start, size, period in found.tolist():
            known = best.get((start, size))
            if known is None or period < known:
                best[start, size] = period
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, size), period in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        k = int(np.searchsorted(begins, start, "right")) - 1
        out[order[k]].append((start - int(begins[k]) - 1, size, period))
    return out


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs and the text without repeats (kept words joined by a blank) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1).to_pylist()
            begin = held = 0
            for k, body in enumerate(bodies):
                held += len(body or "")
                if held >= CHARS or k == len(bodies) - 1:
                    words = [WORD.findall(x or "") for x in bodies[begin : k + 1]]
                    runs = runs_of(words)
                    rest = [" ".join(kept_words(w, r)) for w, r in zip(words, runs, strict=True)]
                    rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, k + 1 - begin), pa.array(rows, _RUN_TYPE), pa.array(rest, pa.string())], names=["doc_id", "runs", "collapsed"])
                    begin, held = k + 1, 0

    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed string")


def planted_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, with the end repeated where 10 divides the key's crc32; built-in functions only."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_SQL), F.lit(0))))
    rows = rows.withColumns({"n": F.coalesce(F.size("words"), F.lit(0)).cast("long"), "g": F.expr("h div 10")}).withColumn("a", F.when(F.col("n") > 0, F.expr("g % greatest(n, 1)")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("concat_ws(' ', slice(words, 1, cast(a as int)), transform(sequence(0L, n - a - 1), i -> words[cast(a + i % p as int)]))")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_runs(planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.expr("aggregate(runs, runs[0], (best, x) -> if(x.length * best.period > best.length * x.period, x, best))")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digests.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
