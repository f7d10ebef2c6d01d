"""Exact BPE over a piece model by a table of last tokens.

The text is cut only where no piece of the vocabulary can span: between two
characters that stand side by side in no piece, such as a letter and a mark after it
(a character that the vocabulary lacks is a part of its own and becomes bytes).
Within a part, an automaton over all pieces reports every piece that ends at each
position; the prefix ending there has one valid encoding, and its last token is the
reported piece that is compatible with the last token of the prefix before it.  Two
tokens are compatible when merging their joined text gives just these two.  Ids are
then read off backwards.  A worker remembers words and parts, within bounds.

Parts with a run of word marks hold pieces of equal score, where compatibility
of neighbours alone does not decide; these use the merge loop itself.

Defined cases: null text counts as empty (begin and end id only); any length is
encoded whole; equal texts give equal rows; an empty table gives an empty
result; columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import resident, table

MARK = "▁"
_SCHEMA = "doc_id long, ids binary, decoded string"
#: Entries of a worker's memos of words and of parts; each starts anew beyond this.
MEMO, PART_MEMO = 200_000, 400_000
#: Words and parts longer than this aren't remembered.
MEMO_CHARS = 64


class PieceTable:
    def __init__(self, model: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.raw: list[bytes | None] = [None] * n
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.score[p] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a word mark; texts can't be cut there")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a character of a piece is no piece itself")
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.atoms: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[int]:
        """The merge loop: best score first, then leftmost."""
        n = len(text)
        sym: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(p := sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-s, a, b, p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, p = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or len(sym[a]) + len(sym[b]) != len(p) or right[a] != b:
                continue
            sym[a], sym[b] = p, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids[s] for s in sym if s is not None]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the texts of tokens a and b (a < 0: of b alone) gives just these."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        want = [b] if a < 0 else [a, b]
        known = self.pairs[a << 32 | b] = self.merged("".join(self.pieces[i] for i in want)) == want
        return known

    def tabled(self, text: str) -> list[int]:
        """Ids of a run of known characters, through the last-token table."""
        if MARK * 2 in text:
            return self.merged(text)
        last = [-2] * (len(text) + 1)
        last[0] = -1
        known, fits = self.pairs.get, self.fits
        for end, (size, i) in self.automaton.iter(text):
            before = last[end + 1 - size]
            if before == -2 or last[end + 1] != -2:
                continue
            if (good := known(-1 << 32 | i)) is None:
                good = fits(-1, i)
            if good and before >= 0 and (good := known(before << 32 | i)) is None:
                good = fits(before, i)
            if good:
                last[end + 1] = i
        out, at = [], len(text)
        while at:
            if last[at] == -2:
                return self.merged(text)
            out.append(last[at])
            at -= len(self.pieces[last[at]])
        return out[::-1]

    def parts_of(self, word: str) -> list[str]:
        """The word cut between characters that are neighbours in no piece."""
        beside, out, start = self.beside, [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in beside:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def part(self, part: str) -> tuple[bytes, str]:
        """Packed ids of a part and the text decoded from them."""
        got = self.atoms.get(part)
        if got is None:
            ids = self.tabled(part) if part[0] in self.ids else [self.byte_id[b] for b in part.encode()]
            got = struct.pack(f"<{len(ids)}I", *ids), self.raw_text(ids)
            if len(part) <= MEMO_CHARS:
                if len(self.atoms) >= PART_MEMO:
                    self.atoms.clear()
                self.atoms[part] = got
        return got

    def word(self, word: str) -> tuple[bytes, str]:
        """The same of a run that starts with its word marks."""
        got = self.words.get(word)
        if got is None:
            parts = [self.part(p) for p in self.parts_of(word)]
            got = parts[0] if len(parts) == 1 else (b"".join([x[0] for x in parts]), "".join([x[1] for x in parts]))
            if len(word) <= MEMO_CHARS:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[word] = got
        return got

    def raw_text(self, ids: list[int]) -> str:
        """Text of ids with byte pieces joined and word marks as blanks; control pieces give nothing."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if (b := self.raw[i]) is not None:
                held += b
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in (self.bos, self.eos):
                out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        raw = self.packed(text)[0]
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        text = self.raw_text(ids)
        return text[1:] if text.startswith(" ") else text

    def packed(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text decoded from them."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        if not text:
            return begin + end, ""
        known, word = self.words.get, self.word
        got = [known(w) or word(w) for w in self.cut.findall(MARK + text.replace(" ", MARK))]
        decoded = "".join([x[1] for x in got])
        return b"".join([begin, *[x[0] for x in got], end]), decoded[1:]


def piece_table(model: str) -> PieceTable:
    return resident(f"pieces {model}", lambda: PieceTable(model))


def encode_decode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: its ids (little-endian unsigned 32-bit) and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, back = zip(*[pieces.packed(x or "") for x in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
