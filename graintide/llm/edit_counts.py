"""Token counts kept up to date under edits.

Each document's text is cut into pre-tokens, held in leaves of up to 64; a binary
tree over the leaves sums characters and tokens.  An edit finds its leaf by
descending the character sums, cuts anew from a leaf boundary before the edit
until the new cuts meet an old leaf boundary behind it, counts tokens only for
pre-tokens of that region, and adds the difference along the tree's path.

A pre-token depends on what follows it by one character only (blanks before a
word), and on what precedes it not at all once a cut is fixed, so cuts that meet
at a boundary with the same rest stay the same.

Defined cases: null text counts as empty (no token); edits outside the text are
clipped to it; very long texts have more leaves; equal texts give equal rows; an
empty table gives an empty result.  Columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graintide.llm.common import table

LEAF, MEMO = 64, 500_000
_SCHEMA = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_recoded long"


class Counter:
    """Tokens of pre-tokens by a rank file, remembered."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.memo.get(token)
        if n is None:
            n = self.older.get(token)
            if n is None:
                n = len(self.coding.encode_ordinary(token))
            if len(token) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo, self.older = {}, self.memo
                self.memo[token] = n
        return n


@functools.cache
def counter(ranks: str, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class Counted:
    """A text as leaves of pre-tokens under a tree of sums."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.recoded = counter, 0
        tokens = counter.pattern.findall(text)
        self._grow([tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]])

    def _sums(self, leaf: list[str]) -> tuple[int, int]:
        return sum(map(len, leaf)), sum(map(self.counter.count, leaf))

    def _grow(self, leaves: list[list[str]], known: dict[int, tuple[int, int]] | None = None) -> None:
        """Build the tree; ``known`` has the sums of leaves (by identity) that are kept."""
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.tree = [(0, 0)] * (2 * self.width)
        for i, leaf in enumerate(leaves):
            self.tree[self.width + i] = (known or {}).get(id(leaf)) or self._sums(leaf)
        for i in range(self.width - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def chars(self) -> int:
        return self.tree[1][0]

    @property
    def tokens(self) -> int:
        return self.tree[1][1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        i, begin = 1, 0
        while i < self.width:
            left = self.tree[2 * i][0]
            if char < begin + left:
                i = 2 * i
            else:
                begin += left
                i = 2 * i + 1
        leaf = min(i - self.width, len(self.leaves) - 1)
        return (leaf, begin) if i - self.width == leaf else (leaf, self.chars - self.tree[self.width + leaf][0])

    def _put(self, leaf: int, tokens: list[str]) -> None:
        self.leaves[leaf] = tokens
        i = self.width + leaf
        self.tree[i] = self._sums(tokens)
        while i > 1:
            i //= 2
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = (a[0] + b[0], a[1] + b[1])

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from start up to end."""
        end = min(max(end, 0), self.chars)
        start = min(max(start, 0), end)
        first, begin = self._leaf_at(start)
        if first and start - begin < 2:  # what stands before may reach over the boundary
            first -= 1
            begin -= self.tree[self.width + first][0]
        last, last_begin = self._leaf_at(end)
        if last < first:
            last, last_begin = first, begin
        after = last_begin + self.tree[self.width + last][0]
        while True:
            # one leaf more behind the region, so that its last cut is seen with what follows
            ahead = self.leaves[last + 1] if last + 1 < len(self.leaves) else []
            old = "".join(t for leaf in self.leaves[first : last + 1] for t in leaf)
            text = old[: start - begin] + new + old[end - begin :]
            cut = self.counter.pattern.findall(text + "".join(ahead))
            if not ahead:
                break
            size, k = 0, 0
            while size < len(text):
                size += len(cut[k])
                k += 1
            if size == len(text) and cut[k:] == ahead:
                cut = cut[:k]
                break
            last += 1
            after += self.tree[self.width + last][0]
        self.recoded += len(text)
        if last == first and len(cut) <= 4 * LEAF:
            self._put(first, cut)
            return
        known = {id(leaf): self.tree[self.width + i] for i, leaf in enumerate(self.leaves)}
        fresh = [cut[i : i + LEAF] for i in range(0, len(cut), LEAF)]
        self._grow([*self.leaves[:first], *fresh, *self.leaves[last + 1 :]] or [[]], known)


def edits_of(text: str) -> list[tuple[int, int, str]]:
    """The query's edits of a text, each on the text the one before left: a move, a cut and a change of case."""
    n = len(text)
    moved = text[:32]
    return [(n // 2, n // 2, moved), (n // 4, n // 4 + 24, ""), (3 * n // 4, 3 * n // 4 + 16, text[3 * n // 4 : 3 * n // 4 + 16].upper())]


def counts_under_edits(df: DataFrame, ranks: str, pattern: str, edits=edits_of, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every text before and after its edits, and how many characters were coded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks, pattern)
        for batch in batches:
            rows: list[Sequence] = []
            for k, x in zip(batch.column(0), batch.column(1), strict=True):
                t = x.as_py() or ""
                doc = Counted(t, own)
                before = doc.tokens
                for start, end, new in edits(t):
                    doc.edit(start, end, new)
                rows.append((k.as_py(), before, doc.tokens, doc.chars, doc.recoded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_recoded"])

    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op7_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts_under_edits(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
