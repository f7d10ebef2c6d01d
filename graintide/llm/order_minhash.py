"""Near-duplicates by order MinHash and banded alignment.

The k-mers of a text are its runs of three words, each labelled with its
occurrence number.  One changed word touches three of them, so at a similarity of
0.8 at least 2 of 5 are left wherever the changes stand (of runs of five words there
may be none), and the number of sketches is set for a recall of 0.98 there.  Every
sketch takes the two k-mers of least hash and keeps them in text order, so two texts
share a sketch's value only if they share k-mers in the same order.  Pairs of at most
EXACT words are met with certainty by pigeonhole: a text in d + 1 segments keeps one of
them through d edits.

All texts that share a value are candidates of each other; a candidate pair is a
link if a banded alignment of its words finds an edit similarity of 0.8 or more.
Classes are the connected components.  Two steps meet all candidates without a row
for each of them:

* every value elects a centre; each text is aligned with the centre it shares most
  values with, then with one centre in another class, then for each two classes that still
  meet at a centre one pair of their texts is aligned, and another in the next turn as
  long as turns pay, so groups of copies become one class for a row a text and value;
* where a value still holds several classes, its rows go to one task (to one of
  several, by pairs of blocks, if they are many), which compares the word counts of
  all pairs of different classes.  Only pairs that these don't rule out leave the task,
  once.  Of each two classes the likeliest pair is aligned first; once it joins them,
  their other pairs need no alignment.  All pairs that still lie between two classes are
  aligned.

Equal texts are one node from the start and are never paired.  The edit
similarity of texts with n and m words at word distance d is 1 - d / max(n, m).

Defined cases: a null text is a class of its own; empty texts are equal to each
other; a text without words links to its equals only; repeated rows are equal texts;
an empty table gives an empty result.  Other columns, whatever their names, are
carried along unread.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graintide.llm.common import arrow_rows, keep, resident, table

WORDS = 3
#: Sketches of a text of LONG k-mers or more, and of a shorter one.  With the share j of common k-mers, s sketches meet with
#: 1 - (1 - j * j) ** s; the changes placed worst leave j * j = 0.035 at 20 words and 0.057 at 100.
SKETCHES, SHORT_SKETCHES, LONG = 80, 132, 100
#: Pairs of at most this many words are met with certainty.
EXACT = 24
#: At most one word in this many differs between linked texts: a similarity of 0.8.
ONE_IN = 5
#: Buckets of a text's word counts, and of the finer counts of a text of FINE words or more.
BAG, WIDE, FINE = 128, 1024, 160
#: Rows of a value that one block holds; larger values are compared by pairs of blocks.
BLOCK = 2_000
_MEMO = 200_000
#: Least values of a text's that its rows carry: a pair leaves at the least one that both carry.
LOW = 32
#: Pairs of a task among which repeated ones are dropped.
PAIRS = 50_000
#: Pairs whose word counts a task compares at a time, at some 10 kB each.
AT_ONCE = 5_000
#: Texts, and pairs of texts, that go to a task in one batch.
TEXTS, TEXT_PAIRS = 2_048, 512
#: Most rows of a mask that is broadcast, at 16 bytes for 64 row numbers; beyond it rows and mask are shuffled.
MASK_ROWS = 1_000_000
#: Turns in which texts meet centres of other classes; what they leave apart is compared by values.
TURNS = 3
#: A turn by pairs of classes pays, and another follows, if one in this many of its pairs is a link.
PAYS = 100
#: Copies of a class's first row when its members look up their class.
SALTS = 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def segments(n: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of n words, one more than the edits that a pair of n words may have."""
    parts = n // ONE_IN + 1
    ends = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(ends)]


@functools.cache
def probes(m: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Length, starts and labels of the runs by which m words meet every text of m to EXACT words.

    A run stands for segment i of a text of n words.  At most i edits lie before
    the first segment that is kept, at most d - i after it, for d edits in all.
    """
    found: dict[int, list[tuple[int, int]]] = {}
    for n in range(m, EXACT + 1):
        d = n // ONE_IN
        if n - m > d:
            continue
        for i, (at, size) in enumerate(segments(n)):
            low, high = max(0, at - i, at + m - n - (d - i)), min(m - size, at + i, at + m - n + (d - i))
            found.setdefault(size, []).extend((q, 64 * n + i) for q in range(low, high + 1))
        if n == m:
            for i, (at, size) in enumerate(segments(n)):
                found.setdefault(size, []).append((at, 64 * n + i))
    return [(size, np.array([q for q, _ in own]), np.array([t for _, t in own], np.uint64)) for size, own in found.items() if own]


class _Ids(dict):
    """Hash of each word met."""

    def __missing__(self, word: str) -> int:
        import xxhash

        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


class Sketcher:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.step = _odd(rng, WORDS)
        self.factor = _odd(rng, SHORT_SKETCHES)[:, None]
        self.place = _odd(rng, EXACT)
        self.known = _Ids()

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _MEMO:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def kmers(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of the occurrence-labelled k-mers in text order."""
        if not len(ids):
            return np.zeros(0, np.uint64)
        n = max(1, len(ids) - WORDS + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(ids))):
            grams += ids[k : k + n] * self.step[k]
        grams = _mix(grams)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            start = np.where(np.append(True, ~same), np.arange(n), 0)
            again = np.arange(n) - np.maximum.accumulate(start)
            later = order[again > 0]
            grams[later] = _mix(grams[later] + again[again > 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return grams

    def near(self, ids: np.ndarray) -> np.ndarray:
        """Values by which a text of at most EXACT words meets every text of at most EXACT words that it may link to."""
        out = [np.zeros(0, np.uint64)]
        for size, starts, labels in probes(len(ids)) if 0 < len(ids) <= EXACT else ():
            run = np.zeros(len(starts), np.uint64)
            for k in range(size):
                run += ids[starts + k] * self.place[k]
            out.append(_mix(_mix(run) + labels))
        return np.unique(np.concatenate(out)).view(np.int64)

    def sketch(self, ids: np.ndarray) -> np.ndarray:
        """Values of the sketches; none where ``near`` meets all that may link."""
        if len(ids) < EXACT + 1 - (EXACT + 1) // ONE_IN:
            return np.zeros(0, np.int64)
        grams = self.kmers(ids)
        n = len(grams)
        out = []
        step = max(1, 2_000_000 // n)
        factor = self.factor if n < LONG else self.factor[:SKETCHES]
        for k in range(0, len(factor), step):
            h = grams * factor[k : k + step]
            rows = np.arange(len(h))
            one = h.argmin(1)
            if n > 1:
                h[rows, one] = np.uint64(2**64 - 1)
            two = h.argmin(1)
            first, second = np.minimum(one, two), np.maximum(one, two)
            out.append(_mix(grams[first] * np.uint64(3) + _mix(grams[second])))
        values = np.concatenate(out)
        return _mix(values + np.arange(1, len(values) + 1, dtype=np.uint64)).view(np.int64)

    def bag(self, ids: np.ndarray, buckets: int = BAG) -> bytes:
        """Counts of the words by hash, a byte a bucket that stops at 255."""
        return np.minimum(np.bincount((_mix(ids) % np.uint64(buckets)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def sketcher() -> Sketcher:
    return resident("sketcher", Sketcher)


def banded_distance(a: list, b: list, band: int) -> int:
    """Edit distance of two sequences if it is at most ``band``, else band + 1.

    Bit-parallel over the cells at most ``band`` from the diagonal; the bits are one
    Python integer that moves down the diagonal with each element of b.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > band:
        return band + 1
    if band >= m:
        band = m
    width = 2 * band + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    vp = mask ^ ((1 << (width - band - 1)) - 1)
    vn, dist, start = 0, band, band + 1 - width
    side = top >> 1
    for i, x in enumerate(b):
        bits = where.get(x, 0)
        at = start + i
        bits = (bits >> at if at >= 0 else bits << -at) & mask
        d0 = (((bits & vp) + vp) ^ vp) & mask | bits | vn
        hp = vn | mask ^ (d0 | vp)
        hn = d0 & vp
        if i < m - band:
            dist += not d0 & top
        else:
            dist += bool(hp & side) - bool(hn & side)
            side >>= 1
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & mask
        vn = down & hp
    return min(dist, band + 1)


def similar(a: list[str], b: list[str]) -> bool:
    """Edit similarity of two word lists is 0.8 or more."""
    longest = max(len(a), len(b))
    band = longest // ONE_IN
    if not a or not b or abs(len(a) - len(b)) > band:
        return False
    if longest - sum((Counter(a) & Counter(b)).values()) > band:
        return False
    return banded_distance(a, b, band) <= band


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (u, v); root is the least node of the component.

    Alternates large-star and small-star steps, each a minimum per node and a join,
    until every node has one edge upwards, to a root; every round is written to the
    shared folder.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not nodes.agg(F.coalesce(F.max(F.expr("up > 1 or up > 0 and down > 0")), F.lit(False)).alias("open")).first()["open"]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter("u > v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", F.col("m")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "small")
    return keep(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")


def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots, (node, root), after new links between nodes; only the links' classes are looked at."""
    name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    new = components(ends.filter("u != v"))
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    return keep(moved.unionByName(new), "contracted")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = sketcher()
    lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            ids = [own.ids(x.split()) for x in part.column(1).to_pylist()]
            bags = pa.array([own.bag(x) for x in ids], pa.binary())
            wide = pa.array([own.bag(x, WIDE) if len(x) >= FINE else None for x in ids], pa.binary())
            columns = [part.column(0), pa.array([len(x) for x in ids], pa.int32()), bags, wide, lists([own.sketch(x) for x in ids]), lists([own.near(x) for x in ids])]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "n", "bag", "wide", "sketch", "near"])


def _bytes(column: pa.Array, width: int, kind: str = "u1") -> np.ndarray:
    """Rows of a binary column as numbers; shorter values are filled up with zeros."""
    return np.frombuffer(b"".join([(x or b"").ljust(width, b"\0") for x in column.to_pylist()]), kind).reshape(column.__len__(), -1)


def _short_by(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of edits that the word counts of each pair of rows ask for."""
    less = a.astype(np.int16) - b
    return np.maximum(np.maximum(less, 0).sum(1), np.maximum(-less, 0).sum(1))


def _near_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, a, b, n, m) whose word counts a and b don't yet rule out the similarity."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            n, m = (part.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            edits = np.maximum(_short_by(_bytes(part.column(2), BAG), _bytes(part.column(3), BAG)), abs(n - m))
            yield part.select(["u", "v"]).filter(pa.array(edits <= np.maximum(n, m) // ONE_IN))


class _Rows:
    """Rows of whole values (value, turn_a, turn_b, block, rid, root, n, bag, wide and, if given, low), sorted by the first three."""

    def __init__(self, rows: pa.Table) -> None:
        number = lambda c: rows.column(c).to_numpy()
        self.value, self.turns = number("value"), (number("turn_a"), number("turn_b"))
        self.block, self.rid, self.root, self.n = (number(c) for c in ("block", "rid", "root", "n"))
        whole = lambda c: rows.column(c).combine_chunks()
        self.bag, self.wide = _bytes(whole("bag"), BAG), _bytes(whole("wide"), WIDE)
        self.low = np.full((rows.num_rows, LOW), np.iinfo(np.int64).max)  # the filling is less than no value
        if "low" in rows.column_names:  # rows may carry no values
            lists = whole("low")
            self.low[np.arange(LOW) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()

    def ends(self) -> np.ndarray:
        a, b = self.turns
        return np.flatnonzero(np.append((self.value[1:] != self.value[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True)) + 1

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(u, v, a, b, off) of the pairs of rows i, j in different classes that the word counts allow, those of the rows and of the classes in order."""

        def only(good: np.ndarray) -> None:
            nonlocal i, j
            i, j = i[good], j[good]

        a, b = self.turns
        only((self.root[i] != self.root[j]) & ((a[i] == b[i]) | (self.block[i] != self.block[j])))
        band = lambda: np.maximum(self.n[i], self.n[j]) // ONE_IN
        only(abs(self.n[i] - self.n[j]) <= band())
        only(_short_by(self.bag[i], self.bag[j]) <= band())
        only((self.n[i] < FINE) | (self.n[j] < FINE) | (_short_by(self.wide[i], self.wide[j]) <= band()))
        only(~self.met_before(i, j))
        fine = (self.n[i] >= FINE) & (self.n[j] >= FINE)
        edits = np.maximum(_short_by(self.bag[i], self.bag[j]), np.where(fine, _short_by(self.wide[i], self.wide[j]), 0))
        off = edits.astype(np.int64) * 1000 // np.maximum(np.maximum(self.n[i], self.n[j]), 1)
        ends = lambda x: (np.minimum(x[i], x[j]), np.maximum(x[i], x[j]))
        return np.stack([*ends(self.rid), *ends(self.root), off], 1)

    def met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i, j also meet at a less value that both carry; never so at the least one that they share."""
        a, b, at = self.low[i], self.low[j], self.value[i]
        found = np.zeros(len(i), bool)
        for k in range(LOW):
            found |= (a[:, k] < at) & (b == a[:, k : k + 1]).any(1)
        return found


def _pairs_within(starts: np.ndarray, ends: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows of each group, about ``most`` at a time."""
    sizes = ends - starts
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == size]
        if size * (size - 1) // 2 <= most:
            a, b = np.triu_indices(size, 1)
            step = max(1, most // len(a))
            for k in range(0, len(own), step):
                yield (own[k : k + step, None] + a).ravel(), (own[k : k + step, None] + b).ravel()
        else:
            step = max(1, most // size)
            for s in own.tolist():
                for k in range(0, size, step):
                    i, j = np.meshgrid(np.arange(k, min(k + step, size)), np.arange(k, size), indexing="ij")
                    yield s + i[i < j], s + j[i < j]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of different classes a and b that share a value and may link, of rows sorted by value.

    ``off`` is the least number of edits by word counts in 1,000 words.  A pair leaves at the least value that both rows carry.  Where they carry none in common it leaves at every value they
    share, but once for about PAIRS of them; who calls takes the distinct ones.
    """
    held: list[pa.RecordBatch] = []
    found: list[np.ndarray] = []

    def sent() -> pa.RecordBatch:
        columns = np.unique(np.concatenate(found), axis=0).T
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["u", "v", "a", "b", "off"])

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
        if not held:
            continue
        whole = pa.Table.from_batches(held)
        held = []
        rows = _Rows(whole)
        ends = rows.ends()
        if batch is not None:  # the last value may go on
            cut = int(ends[-2]) if len(ends) > 1 else 0
            held, ends = whole.slice(cut).to_batches(), ends[:-1]
        for i, j in _pairs_within(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if len(ends) else ():
            left = rows.left(i, j)
            if len(left):
                found.append(left)
                if sum(map(len, found)) >= PAIRS:
                    yield sent()
    if found:
        yield sent()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similar(x.as_py().split(), y.as_py().split()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _marked(rows: DataFrame, ids: DataFrame, most: int = MASK_ROWS) -> DataFrame:
    """rows with ``marked``: whether their rid is one of ids.

    The ids go out as one 64-bit mask for 64 row numbers, so the texts stay where they are.
    """
    mask = keep(ids.groupBy(F.shiftright("rid", 6).alias("_block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(rid & 63 as int))")).alias("_mask")), "mask")
    mask = F.broadcast(mask) if mask.count() <= most else mask
    found = rows.withColumn("_block", F.shiftright("rid", 6)).join(mask, "_block", "left")
    return found.withColumn("marked", F.expr("coalesce(shiftrightunsigned(_mask, cast(rid & 63 as int)) & 1L, 0L) = 1L")).drop("_block", "_mask")


def _ends(pairs: DataFrame, side: DataFrame, value: str, *more: str) -> DataFrame:
    """pairs (u, v) with both ends' value as a, b, and another column of theirs as n, m."""
    out = pairs.select("u", "v")
    for end, *names in (("u", "a", "n"), ("v", "b", "m")):
        out = out.join(side.select(F.col("rid").alias(end), *[F.col(c).alias(x) for c, x in zip((value, *more), names)]), end)
    return out.select("u", "v", "a", "b", *("n", "m")[: 2 * len(more)])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v), kept ones, whose texts align.  Only texts of a pair are shuffled."""
    own = _marked(texts, pairs.select(F.explode(F.array("u", "v")).alias("rid"))).filter("marked")
    with arrow_rows(texts.sparkSession, TEXT_PAIRS):
        return keep(_ends(pairs, own, "text").mapInArrow(_aligned, "u long, v long"), "links")


def _rooted(rows: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the root of their key: the key itself where it has no link."""
    own = roots.select(F.col("node").alias(key), F.col("root").alias("_root"))
    return rows.join(own, key, "left").withColumn(name, F.coalesce("_root", key)).drop("_root")


def _joined(pairs: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """roots after every one of the pairs (u, v) of classes a < b, kept ones, is aligned or within one class.

    The pair of least ``off`` of each two classes is aligned first, and again while that pays; then all that are left.
    """
    for _ in range(TURNS):
        two = keep(pairs.groupBy("a", "b").agg(F.min_by(F.struct("u", "v"), F.struct("off", "u", "v")).alias("first"), F.count(F.lit(1)).alias("n")), "two")
        links = _links(two.select("first.*"), texts)
        n = links.count()
        if n:
            roots = contracted(roots, links)
        apart = _rooted(_rooted(two.filter("n > 1"), roots, "a", "c"), roots, "b", "d").filter("c != d")
        left = pairs.join(apart.drop("n"), ["a", "b"]).filter("u != first.u or v != first.v")
        pairs = keep(left.select("u", "v", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "off"), "pairs")
        if n * PAYS < two.count():
            break
    links = _links(pairs, texts)
    return roots if links.isEmpty() else contracted(roots, links)


def _rest(values: DataFrame, roots: DataFrame, sketches: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """roots after every pair of values' rows (value, rid) that share a value is ruled out, aligned or within one class."""
    named = _rooted(values, roots, "rid", "root")
    same = Window.partitionBy("value")
    live = named.withColumn("least", F.min("root").over(same)).withColumn("most", F.max("root").over(same)).withColumn("size", F.count(F.lit(1)).over(same))
    live = keep(live.filter("least < most").select("value", "rid", "root", "size"), "live")
    if live.isEmpty():
        return roots
    low = keep(live.groupBy("rid").agg(F.slice(F.sort_array(F.collect_list("value")), 1, LOW).alias("low")), "low")
    found = _marked(sketches, low.select("rid")).filter("marked").select("rid", "n", "bag", "wide").join(low, "rid")
    # rows of a value's largest class never meet each other: they are dealt once for each block of the others
    top = live.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.max(F.struct("n", "root")).alias("top"))
    large, others, own = F.col("root") == F.col("top.root"), F.ceil((F.col("size") - F.col("top.n")) / block).cast("int"), F.ceil(F.col("top.n") / block).cast("int")
    live = live.join(top, "value").withColumns({"large": large, "others": others, "own": own})
    place = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    live = live.withColumn("block", F.when(F.col("large"), F.col("others") + place("own")).otherwise(place("others")))
    meets = F.col("others") + F.when(F.col("large"), 0).otherwise(F.col("own"))
    dealt = live.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1))).select("value", F.least("block", "other").alias("turn_a"), F.greatest("block", "other").alias("turn_b"), "block", "rid", "root")
    rows = dealt.join(found, "rid").repartition("value", "turn_a", "turn_b").sortWithinPartitions("value", "turn_a", "turn_b")
    pairs = rows.select("value", "turn_a", "turn_b", "block", "rid", "root", "n", "bag", "wide", "low").mapInArrow(_met, "u long, v long, a long, b long, off long")
    return _joined(keep(pairs.distinct(), "pairs"), roots, texts)


def _free(name: str, taken: list[str]) -> str:
    """name, or name with as many underscores as make it differ from the taken ones."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def classes(docs: DataFrame, text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame, str]:
    """(rows, membership, number): the rows of docs with a row number of that name, and (rid, root) by number.

    The root is the least number of the class.
    """
    number = _free("_rid", docs.columns)
    rows = keep(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col(number).alias("rid"), F.col(text).cast("string").alias("text"))
    given = own.filter(F.col("text").isNotNull())
    hashes = given.select("rid", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    copies = keep(hashes.groupBy("h1", "h2").agg(F.min("rid").alias("uid"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    members = keep(hashes.join(copies, ["h1", "h2"], "left").select("rid", F.coalesce("uid", "rid").alias("uid")), "members")

    unique = _marked(given, members.filter("rid != uid").select("rid")).filter("not marked")
    with arrow_rows(docs.sparkSession, TEXTS):
        sketches = keep(unique.select("rid", "text").mapInArrow(_sketched, "rid long, n int, bag binary, wide binary, sketch array<long>, near array<long>"), "sketches")
    single = sketches.select("rid", F.explode(F.concat("sketch", "near")).alias("value"))
    turn = F.shiftrightunsigned(F.xxhash64("value"), 1)
    centres = single.groupBy("value").agg(F.min(F.col("rid").bitwiseXOR(turn)).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("value", F.col("least").bitwiseXOR(turn).alias("centre"))
    met = keep(single.join(keep(centres, "centres"), "value"), "met")

    texts = keep(_marked(given, met.select("rid").distinct()).filter("marked").drop("marked"), "texts")
    pair = (F.least("rid", "centre").alias("u"), F.greatest("rid", "centre").alias("v"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = _ends(pairs, sketches, "bag", "n").mapInArrow(_near_bags, "u long, v long")
        return _links(keep(near, "near"), texts)

    often = met.filter("rid != centre").groupBy("rid", "centre").agg(F.count(F.lit(1)).alias("n"))
    best = often.groupBy("rid").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre")).select(*pair).distinct()
    roots = components(linked(best))
    for turn in range(TURNS):
        apart = _rooted(_rooted(met.filter("rid != centre"), roots, "rid", "root"), roots, "centre", "root_c").filter("root != root_c")
        if turn == 0:  # one centre of another class a text
            apart = apart.groupBy("rid").agg(F.min_by("centre", F.xxhash64("rid", "centre")).alias("centre"))
        else:  # one pair of texts for two classes, another one each turn
            apart = apart.groupBy(F.least("root", "root_c"), F.greatest("root", "root_c")).agg(F.min_by(F.struct("rid", "centre"), F.xxhash64(F.lit(turn), "rid", "centre")).alias("pair")).select("pair.*")
        apart = keep(apart.select(*pair).distinct(), "apart")
        later = linked(apart)
        n = later.count()
        if n:
            roots = contracted(roots, later)
        if turn and n * PAYS < apart.count():
            break
    roots = _rest(met.select("value", "rid"), roots, sketches, texts, block)

    found = members.join(roots, F.col("uid") == F.col("node"), "left").select("rid", F.coalesce("root", "uid").alias("root"))
    alone = own.filter(F.col("text").isNull()).select("rid", F.col("rid").alias("root"))
    return rows, keep(found.unionByName(alone), "classes"), number


def op5_order_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class (the doc_id of the class's first row) and whether it is that first row."""
    rows, found, number = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = rows.select(F.col(number).alias("rid"), "doc_id").join(found, "rid")
    others = named.filter("rid != root").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    first = named.filter("rid = root").join(others.select("root").distinct(), "root", "left_semi").select("root", F.col("doc_id").alias("class_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kept = named.filter("rid = root").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return kept.unionByName(others.join(first, ["root", "salt"]).select("doc_id", "class_id", F.lit(False).alias("kept")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one of least row number.

    Null texts are classes of their own and stay; of equal or empty texts one row
    stays; an empty table gives an empty result; all columns, whatever their names, are returned.
    """
    rows, found, number = classes(docs)
    whole = rows.select(F.col(number).alias("rid"), F.struct(*[rows[f"`{c}`"] for c in docs.columns]).alias("doc"))
    return _marked(whole, found.filter("rid != root").select("rid")).filter("not marked").select("doc.*")
