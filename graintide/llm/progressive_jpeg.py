"""Media columns: progressive JPEG written, read and turned into RGB in numpy.

A payload of bytes is stored as quantised coefficients, the unit that a JPEG
keeps losslessly: byte less 128, 64 to a block, nine blocks (four of luminance,
four of the first chroma component, one of the second) to 16 x 16 pixels, so 576
bytes fill one unit.  A media value is a row of JPEG frames of at most
``FRAME_UNITS`` units each, which bounds memory whatever the text's length.

Five scans a component: DC and coefficients 1 to 5 but for their lowest bit,
coefficients 6 to 63, then the refinements of both.  Restart intervals of eight blocks
make entropy-coded runs independent, and many runs are decoded in step, one
symbol of each run at a time.  The reader accumulates any mix of such scans into
coefficient arrays (spectral selection, successive approximation, end-of-band
runs), inverts the transform in whole numbers, repeats chroma samples to full size and
gives RGB.

Media and RGB tensors are columns of the result, so whoever writes it stores them.

Defined cases: null text counts as empty, an empty payload is one unit of bytes
255; equal texts give equal media; an empty table gives an empty result; columns
other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graintide.llm.common import table

UNIT, FRAME_UNITS, RESTART = 576, 1024, 8
GROUP_BYTES = 1 << 21
#: Sampling factors (across, down) of the components, and their blocks a unit.
SAMPLING = ((2, 2), (2, 2), (1, 1))
BLOCKS = tuple(a * b for a, b in SAMPLING)
#: first coefficient, last, high bit, low bit of the scans of each component.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 0), (0, 0, 1, 0), (1, 5, 1, 0))
_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, rgb binary, rgb_shape array<int>"
_MEDIA = "doc_id long, n_bytes long, media binary"


def _tables() -> tuple[list[tuple[int, list[int]]], list[tuple[int, list[int]]]]:
    """Code lengths with their symbols: DC sizes in 4 bits; AC in 3, 5 or 12 bits by how common a symbol is."""
    often = [s for s in range(3, 9)]
    some = [0, 1, 2]
    rest = [(r << 4) | s for r in range(16) for s in range(9) if (r << 4 | s) not in often + some]
    return [(4, list(range(12)))], [(3, often), (5, some), (12, rest)]


def _codes(lengths: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and its length by symbol."""
    code, last = 0, 0
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for n, symbols in lengths:
        for s in symbols:
            code <<= n - last
            last = n
            codes[s], sizes[s] = code, n
            code += 1
    return codes, sizes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_body(kind: int, lengths: list[tuple[int, list[int]]]) -> bytes:
    by = dict(lengths)
    return bytes([kind]) + bytes(len(by.get(n, ())) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in by.get(n, ()))


_DC, _AC = _tables()
_DC_CODE, _AC_CODE = _codes(_DC), _codes(_AC)
_HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
_TAIL = _segment(0xC4, _huffman_body(0x00, _DC) + _huffman_body(0x10, _AC)) + _segment(0xDD, struct.pack(">H", RESTART))
_SIZE = np.array([int(x).bit_length() for x in range(4096)])


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block (row by row) of each coefficient in scan order."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([8 * y + x for y, x in order])


def _pack(codes: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> list[bytes]:
    """Codes of up to 24 bits, in order, as one byte string a lane, filled up with ones and stuffed."""
    some = bits > 0
    codes, bits, lane = codes[some], bits[some], lane[some]
    per = np.bincount(lane, weights=bits, minlength=lanes).astype(np.int64)
    start = np.concatenate([[0], np.cumsum((per + 7) // 8)])
    before = np.cumsum(bits) - bits
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    at = before - first[lane] + 8 * start[:-1][lane]
    value = codes << (32 - (at & 7) - bits)
    byte = at >> 3
    out = np.zeros(int(start[-1]) + 4)
    for k in range(4):
        out += np.bincount(byte + k, weights=(value >> (24 - 8 * k)) & 255, minlength=len(out))
    out = out.astype(np.uint8)
    short = -per % 8
    ends = start[1:] - 1
    used = per > 0
    out[ends[used]] |= ((1 << short[used]) - 1).astype(np.uint8)
    raw = out.tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _encode_scan(coef: np.ndarray, lane: np.ndarray, lanes: int, scan: tuple[int, int, int, int]) -> list[bytes]:
    """Entropy-coded bytes of every lane; coef has a row a block, lane its run."""
    lo, hi, ah, al = scan
    if lo == 0:
        v = coef[:, 0].astype(np.int64)
        if ah:
            return _pack((v >> al) & 1, np.ones(len(v), np.int64), lane, lanes)
        v >>= al
        diff = np.where(np.append(True, lane[1:] != lane[:-1]), v, v - np.append(0, v[:-1]))
        size = _SIZE[np.abs(diff)]
        return _pack((_DC_CODE[0][size] << size) | _signed_bits(diff, size), _DC_CODE[1][size] + size, lane, lanes)
    band = coef[:, lo : hi + 1].astype(np.int64)
    rows, width = band.shape
    code, bits = _AC_CODE
    if not ah:
        v = np.sign(band) * (np.abs(band) >> al)
        some = v != 0
        place = np.arange(width)
        seen = np.maximum.accumulate(np.where(some, place, -1), axis=1)
        prior = np.concatenate([np.full((rows, 1), -1), seen[:, :-1]], axis=1)
        size = _SIZE[np.abs(v)]
        symbol = np.where(some, (((place - prior - 1) & 15) << 4) | size, 0xF0)
        active = some | (((place - seen) % 16 == 0) & (place < seen[:, -1:]))
        out = np.zeros((rows, width + 1), np.int64)
        n = np.zeros((rows, width + 1), np.int64)
        out[:, :-1] = np.where(some, (code[symbol] << size) | _signed_bits(v, size), code[0xF0])
        n[:, :-1] = np.where(active, bits[symbol] + np.where(some, size, 0), 0)
        out[:, -1], n[:, -1] = code[0], np.where(seen[:, -1] == width - 1, 0, bits[0])
        return _pack(out.ravel(), n.ravel(), np.repeat(lane, width + 1), lanes)
    mag = np.abs(band) >> al
    old, new, low = mag > 1, mag == 1, mag & 1
    slots = []
    after = np.zeros(rows, bool)
    for e in range(width + 1):
        if e < width:
            event = new[:, e]
            run = np.zeros(rows, np.int64)
            for j in range(e):
                run = np.where(new[:, j], 0, run + ~old[:, j])
            symbol = (run << 4) | 1
            slots.append(((code[symbol] << 1) | (band[:, e] > 0), np.where(event, bits[symbol] + 1, 0)))
        else:
            event = ~new[:, width - 1]
            slots.append((np.full(rows, code[0]), np.where(event, bits[0], 0)))
        for j in range(e):
            after = event & old[:, j]
            for k in range(j + 1, e):
                after = after & ~new[:, k]
            slots.append((low[:, j], after.astype(np.int64)))
    return _pack(np.stack([s[0] for s in slots], 1).ravel(), np.stack([s[1] for s in slots], 1).ravel(), np.repeat(lane, len(slots)), lanes)


def _frames_of(units: int) -> list[int]:
    return [min(FRAME_UNITS, units - i) for i in range(0, units, FRAME_UNITS)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG frames of payloads whose lengths are multiples of 576."""
    units = [f for p in payloads for f in _frames_of(len(p) // UNIT)]
    coef = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, 64)
    starts = np.concatenate([[0], np.cumsum(units)])[:-1] * sum(BLOCKS)
    parts: list[list[list[bytes]]] = []
    skip = 0
    for c, blocks in enumerate(BLOCKS):
        counts = np.array(units) * blocks
        runs = -(-counts // RESTART)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rows = within + np.repeat(starts + skip * np.array(units), counts)
        lane = np.repeat(np.cumsum(runs) - runs, counts) + within // RESTART
        ends = np.cumsum(runs)
        own = coef[rows]
        for k, scan in enumerate(SCANS):
            done = _encode_scan(own, lane, int(runs.sum()), scan)
            head = _segment(0xDA, bytes([1, c + 1, 0x00, scan[0], scan[1], scan[2] << 4 | scan[3]]))
            joined = []
            for a, b in zip((ends - runs).tolist(), ends.tolist(), strict=True):
                out = [head, done[a]]
                for i in range(a + 1, b):
                    out += (b"\xff" + bytes([0xD0 + (i - a - 1) % 8]), done[i])
                joined.append(b"".join(out))
            parts.append((k, c, joined))
        skip += blocks
    parts = [p[2] for p in sorted(parts, key=lambda p: p[:2])]
    frames = []
    for f, n in enumerate(units):
        size = struct.pack(">BHHB", 8, 16, 16 * n, 3) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(SAMPLING))
        frames.append(b"".join([_HEAD, _segment(0xC2, size), _TAIL, *[p[f] for p in parts], b"\xff\xd9"]))
    out, at = [], 0
    for p in payloads:
        n = len(_frames_of(len(p) // UNIT))
        out.append(b"".join(frames[at : at + n]))
        at += n
    return out


_MARK = re.compile(rb"\xff[^\x00\xff]")


class Frame:
    """Header of one progressive frame and its scans' entropy-coded runs."""

    def __init__(self, data: bytes, at: int) -> None:
        self.tables: dict[int, bytes] = {}
        self.scans: list[tuple[list[int], tuple[int, int, int, int], bytes, list[bytes], int]] = []
        restart = 0
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        at += 2
        while data[at + 1] != 0xD9:
            kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xC2:
                _, self.height, self.width, count = struct.unpack_from(">BHHB", body)
                self.sampling = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(count)]
                self.ids = [body[6 + 3 * i] for i in range(count)]
                wide, high = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
                self.units = -(-self.width // (8 * wide)) * -(-self.height // (8 * high))
                self.blocks = [self.units * a * b for a, b in self.sampling]
            elif kind in (0xC0, 0xC1):
                raise ValueError("only progressive frames are read")
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    k = 17 + sum(body[i + 1 : i + 17])
                    self.tables[body[i]] = body[i + 1 : i + k]
                    i += k
            elif kind == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                count = body[0]
                which = [self.ids.index(body[1 + 2 * i]) for i in range(count)]
                if count > 1:
                    raise ValueError("scans of one component are read")
                lo, hi, bits = body[1 + 2 * count : 4 + 2 * count]
                table = self.tables.get(body[2] >> 4 if lo == 0 else 0x10 | body[2] & 15, b"")
                runs = []
                for m in _MARK.finditer(data, at):
                    runs.append(data[at : m.start()].replace(b"\xff\x00", b"\xff"))
                    at = m.end()
                    if not 0xD0 <= data[at - 1] <= 0xD7:
                        at -= 2
                        break
                self.scans.append((which[0], (lo, hi, bits >> 4, bits & 15), table, runs, restart))
        self.end = at + 2


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits."""
    symbols, sizes = np.zeros(65536, np.int64), np.full(65536, 16, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            a = code << (16 - n)
            symbols[a : a + (1 << (16 - n))], sizes[a : a + (1 << (16 - n))] = table[at], n
            code, at = code + 1, at + 1
        code <<= 1
    return symbols, sizes


def _decode_scan(coef: np.ndarray, first: np.ndarray, count: np.ndarray, runs: list[bytes], scan: tuple[int, int, int, int], table: bytes) -> None:
    """Decode runs in step into coef: run i has the blocks first[i] to first[i] + count[i]."""
    lo, hi, ah, al = scan
    sizes = np.array([len(r) for r in runs], np.int64) + 8
    raw = np.frombuffer(b"".join([r + b"\xff" * 8 for r in runs]), np.uint8).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    words = words.astype(np.int64)
    pos = 8 * (np.cumsum(sizes) - sizes)
    row, left = first.copy(), count.copy()
    take = lambda p: (words[p >> 3] << (p & 7)) & 0xFFFFFFFF  # 25 good bits
    if lo == 0 and ah:
        for _ in range(int(left.max(initial=0))):
            on = left > 0
            coef[row[on], 0] |= ((take(pos[on]) >> 31) << al).astype(np.int16)
            pos, row, left = pos + 1, row + 1, left - 1
        return
    symbols, lengths = _lookup(table)
    if lo == 0:
        value = np.zeros(len(row), np.int64)
        for _ in range(int(left.max(initial=0))):
            on = left > 0
            if not on.all():
                pos, row, left, value = pos[on], row[on], left[on], value[on]
            win = take(pos)
            s, n = symbols[win >> 16], lengths[win >> 16]
            more = ((win << n) & 0xFFFFFFFF) >> (32 - s)
            value = value + np.where((s > 0) & (more < (1 << np.maximum(s - 1, 0))), more - (1 << s) + 1, more)
            coef[row, 0] = value << al
            pos, row, left = pos + n + s, row + 1, left - 1
        return
    k = np.full(len(row), lo, np.int64)
    width = hi - lo + 1
    places = np.arange(width)
    while len(row):
        win = take(pos)
        sym = symbols[win >> 16]
        n = lengths[win >> 16]
        r, s = sym >> 4, sym & 15
        more = ((win << n) & 0xFFFFFFFF) >> (32 - s)
        pos = pos + n + s
        eob = (s == 0) & (r < 15)
        skipped = np.zeros(len(row), np.int64)
        if not ah:
            at = k + r
            value = np.where(more < (1 << np.maximum(s - 1, 0)), more - (1 << s) + 1, more)
            put = (s > 0) & (at <= hi)
            coef[row[put], at[put]] = value[put] << al
            k = np.where(eob, hi + 1, at + 1)
        else:
            band = coef[row, lo : hi + 1]
            old = (band != 0) & (places >= (k - lo)[:, None])
            zero = (band == 0) & (places >= (k - lo)[:, None])
            met = np.cumsum(zero, 1)
            stop = np.where(eob, width, np.minimum((met <= r[:, None]).sum(1), width))
            fix = old & (places < stop[:, None])
            if eob.any() and (r[eob] > 0).any():
                extra = np.where(eob, r, 0)
                skipped = np.where(extra > 0, (1 << extra) - 1 + (take(pos) >> (32 - extra)) * (extra > 0), 0)
                pos = pos + extra
            rank = np.cumsum(fix, 1) - 1
            i, j = np.nonzero(fix)
            bit = pos[i] + rank[i, j]
            up = (raw[bit >> 3] >> (7 - (bit & 7))) & 1
            band[i, j] += (np.sign(band[i, j]) * up.astype(np.int16)) << al
            pos = pos + fix.sum(1)
            put = (s > 0) & (stop < width)
            band[put, stop[put]] = np.where(more[put] == 1, 1, -1) << al
            coef[row, lo : hi + 1] = band
            k = np.where(eob, hi + 1, lo + stop + 1)
        if not ah and eob.any() and (r[eob] > 0).any():
            extra = np.where(eob, r, 0)
            skipped = np.where(extra > 0, (1 << extra) - 1 + (take(pos) >> (32 - extra)) * (extra > 0), 0)
            pos = pos + extra
        over = k > hi
        if over.any():
            if ah and skipped.any():
                for lane in np.nonzero(skipped)[0]:  # blocks of an end-of-band run still have correction bits
                    for b in range(int(row[lane]) + 1, int(row[lane]) + 1 + int(min(skipped[lane], left[lane] - 1))):
                        for c in np.nonzero(coef[b, lo : hi + 1])[0] + lo:
                            up = int(raw[pos[lane] >> 3] >> (7 - (pos[lane] & 7))) & 1
                            coef[b, c] += np.sign(coef[b, c]) * (up << al)
                            pos[lane] += 1
            step = np.where(over, 1 + skipped, 0)
            row, left = row + step, left - step
            k = np.where(over, lo, k)
            on = left > 0
            if not on.all():
                pos, row, left, k = pos[on], row[on], left[on], k[on]


def decode(media: list[bytes]) -> tuple[np.ndarray, list[Frame], list[int]]:
    """Coefficients (a row a block, scan order) of all frames, the frames, and the frames of each value."""
    frames, counts = [], []
    for m in media:
        at = n = 0
        while at < len(m):
            frames.append(Frame(m, at))
            at, n = frames[-1].end, n + 1
        counts.append(n)
    bases = np.cumsum([0, *[sum(f.blocks) for f in frames]])
    coef = np.zeros((int(bases[-1]), 64), np.int16)
    todo: dict[tuple, list] = {}
    for f, base in zip(frames, bases, strict=False):
        for turn, (c, scan, huffman, runs, restart) in enumerate(f.scans):
            todo.setdefault((turn, scan, huffman), []).append((int(base) + sum(f.blocks[:c]), f.blocks[c], runs, restart or f.blocks[c]))
    for (_, scan, huffman), own in sorted(todo.items(), key=lambda x: x[0][0]):
        first = np.concatenate([b + np.arange(len(r)) * step for b, _, r, step in own])
        count = np.concatenate([np.minimum(step, n - np.arange(len(r)) * step) for _, n, r, step in own])
        _decode_scan(coef, first, count, [x for o in own for x in o[2]], scan, huffman)
    return coef, frames, counts


_BASIS = np.round(8192 * np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]))


def samples(coef: np.ndarray) -> np.ndarray:
    """Inverse transform of blocks to 0..255; all products are whole numbers, so the result is exact."""
    block = np.zeros((len(coef), 64))
    block[:, zigzag()] = coef
    x = _BASIS.T @ block.reshape(-1, 8, 8) @ _BASIS
    return np.clip(np.floor(x / (1 << 26) + 0.5) + 128, 0, 255).astype(np.int32)


def unit_rgb(coef: np.ndarray, frames: list[Frame]) -> np.ndarray:
    """RGB of every 16 x 16 unit, chroma repeated to full size (units of the layout written here)."""
    x = samples(coef)
    rows: list[list[np.ndarray]] = [[], [], []]
    base = 0
    for f in frames:
        m = np.arange(f.units)[:, None]
        if [tuple(s) for s in f.sampling] != list(SAMPLING):
            raise ValueError("another sampling")
        square = np.concatenate([2 * m, 2 * m + 1, 2 * f.units + 2 * m, 2 * f.units + 2 * m + 1], 1)
        rows[0].append(base + square)
        rows[1].append(base + f.blocks[0] + square)
        rows[2].append(base + f.blocks[0] + f.blocks[1] + m)
        base += sum(f.blocks)
    big = lambda r: x[np.concatenate(r)].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    y, cb = big(rows[0]), big(rows[1]) - 128
    cr = x[np.concatenate(rows[2])[:, 0]].repeat(2, 1).repeat(2, 2) - 128
    half = 1 << 15
    rgb = np.stack([y + ((91881 * cr + half) >> 16), y - ((22554 * cb + 46802 * cr - half) >> 16), y + ((116130 * cb + half) >> 16)], -1)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def tensors(media: list[bytes]) -> list[np.ndarray]:
    """Full-resolution RGB tensor (16, width, 3) of each value, its frames side by side."""
    coef, frames, counts = decode(media)
    units = unit_rgb(coef, frames)
    per, out, at, f = [f.units for f in frames], [], 0, 0
    for n in counts:
        k = sum(per[f : f + n])
        out.append(units[at : at + k].transpose(1, 0, 2, 3).reshape(16, -1, 3))
        at, f = at + k, f + n
    return out


def features(rgb: np.ndarray, sizes: list[int]) -> list[str]:
    """Mean and mean square of each channel and mean step across, of the units of each value."""
    x = rgb.astype(np.int64)
    sums = np.concatenate([x.sum((1, 2)), (x * x).sum((1, 2)), np.abs(np.diff(x, axis=2)).sum((1, 2))], 1)
    starts = np.cumsum([0, *sizes[:-1]])
    total = np.add.reduceat(sums, starts, axis=0)
    return [",".join(f"{v / (256 * n):.3f}" for v in row) for row, n in zip(total.tolist(), sizes, strict=True)]


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Slices of about GROUP_BYTES, one value at least."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] < GROUP_BYTES):
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def stored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as a media column: (doc_id, n_bytes, media), media being its JPEG frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = batch.column(0).to_pylist(), [(x or "").encode() for x in batch.column(1).to_pylist()]
            for at, end in _groups([len(x) for x in raws]):
                yield _batch(_MEDIA, list(zip(keys[at:end], map(len, raws[at:end]), encode([padded(x) for x in raws[at:end]]), strict=True)))

    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, _MEDIA)


def read_back(media: DataFrame) -> DataFrame:
    """Payload digests, RGB tensor (uint8, row by row, with its shape) and features, all from the media column's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, values = (c.to_pylist() for c in batch.columns)
            for at, end in _groups([len(x) for x in values]):
                own = values[at:end]
                coef, frames, counts = decode(own)
                back = (coef + 128).astype(np.uint8).tobytes()
                per = iter(f.units for f in frames)
                units = [sum(next(per) for _ in range(n)) for n in counts]
                rgb = unit_rgb(coef, frames)
                rows, begin = [], 0
                for k, size, m, n, f in zip(keys[at:end], sizes[at:end], own, units, features(rgb, units), strict=True):
                    p = back[begin * UNIT : (begin + n) * UNIT]
                    tensor = rgb[begin : begin + n].transpose(1, 0, 2, 3)
                    begin += n
                    rows.append((k, size, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), f, m, tensor.tobytes(), [16, 16 * n, 3]))
                yield _batch(_SCHEMA, rows)

    return media.mapInArrow(run, _SCHEMA)


def media_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text in a media column, read that back, and describe payload, media and picture."""
    return read_back(stored(df, key, text))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
