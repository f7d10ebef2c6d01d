import hashlib
import random
import zlib

import numpy as np

from graintide.llm.progressive_jpeg import Frame, decode, encode, media_features, padded, stored, tensors, unit_rgb, zigzag

from .helpers import ROWS, frame, texts


def payloads():
    rng = random.Random(0)
    odd = [bytes(rng.choice([128, 127, 129, 130, 126, 200, 0, 255]) for _ in range(n)) for n in (0, 5, 575, 576, 577, 4000, 9000)]
    return [padded(p) for p in [*odd, b"\x80" * 4000, b"\x81\x7f" * 3000, rng.randbytes(700_000), *[rng.randbytes(900) for _ in range(5)]]]


def test_round_trip_is_lossless():
    own = payloads()
    coef, frames, counts = decode(encode(own))
    assert (coef + 128).astype(np.uint8).tobytes() == b"".join(own)
    assert len(counts) == len(own) and max(counts) == 2
    assert [encode([p])[0] for p in own[:8]] == encode(own)[:8]


def bits_of(run):
    return "".join(f"{b:08b}" for b in run)


def scalar(media):
    """Plain decoder of one frame, bit by bit."""
    f = Frame(media, 0)
    coef = np.zeros((sum(f.blocks), 64), int)
    for c, (lo, hi, ah, al), table, runs, step in f.scans:
        codes, code, at = {}, 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1] if table and not (lo == 0 and ah) else 0):
                codes[f"{code:0{n}b}"] = table[at]
                code, at = code + 1, at + 1
            code <<= 1
        base = sum(f.blocks[:c])
        for r, run in enumerate(runs):
            bits, p = bits_of(run), 0

            def get(n):
                nonlocal p
                p += n
                return int(bits[p - n : p] or "0", 2)

            def symbol():
                word = ""
                while word not in codes:
                    word += str(get(1))
                return codes[word]

            def number(s):
                v = get(s)
                return v if not s or v >= 1 << (s - 1) else v - (1 << s) + 1

            before = 0
            for b in range(base + r * step, base + min((r + 1) * step, f.blocks[c])):
                if lo == 0 and not ah:
                    before += number(symbol())
                    coef[b, 0] = before << al
                elif lo == 0:
                    coef[b, 0] |= get(1) << al
                elif not ah:
                    k = lo
                    while k <= hi:
                        sym = symbol()
                        if sym == 0:
                            break
                        k += sym >> 4
                        if sym & 15:
                            coef[b, k] = number(sym & 15) << al
                        k += 1
                else:
                    k = lo
                    while k <= hi:
                        sym = symbol()
                        zeros, new = sym >> 4, (1 if get(1) else -1) if sym & 15 else 0
                        while k <= hi:
                            if coef[b, k]:
                                coef[b, k] += np.sign(coef[b, k]) * (get(1) << al)
                            elif sym and zeros == 0:
                                coef[b, k] = new << al
                                break
                            else:
                                zeros -= 1
                            k += 1
                        k += 1
                        if sym == 0:
                            break
    return coef


def test_equals_scalar_decoder():
    for p in [p for p in payloads() if len(p) < 10_000]:
        media = encode([p])[0]
        assert np.array_equal(scalar(media), decode([media])[0])


def test_pixels_near_exact_transform():
    media = encode([padded(b"some text, and more of it " * 40)])
    coef, frames, _ = decode(media)
    rgb = unit_rgb(coef, frames)
    assert rgb.shape == (2, 16, 16, 3) and tensors(media)[0].shape == (16, 32, 3)
    basis = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

    def pixels(row):
        block = np.zeros(64)
        block[zigzag()] = coef[row]
        return np.clip(np.round(basis.T @ block.reshape(8, 8) @ basis) + 128, 0, 255)

    y, cb, cr = pixels(0), pixels(8) - 128, pixels(16)[:4, :4].repeat(2, 0).repeat(2, 1) - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    assert np.abs(np.clip(want, 0, 255) - rgb[0, :8, :8]).max() <= 2


def test_rows(spark):
    for rows, df in (([(k, t) for k, t, *_ in ROWS], frame(spark)), (texts(), spark.createDataFrame(texts(), "doc_id long, text string"))):
        got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_features(df).collect())
        want = []
        for k, t in rows:
            raw = (t or "").encode()
            p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            want.append((str(k), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        assert got == sorted(want)
    by = {}
    for r in media_features(df).collect():
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media_features(frame(spark, [])).collect() == []


def test_stored_bytes_and_tensors_are_columns(spark):
    df = frame(spark)
    media = stored(df).collect()
    for r in media_features(df).collect():
        assert any(r.media == m.media and r.doc_id == m.doc_id for m in media)
        assert np.array_equal(np.frombuffer(r.rgb, np.uint8).reshape(r.rgb_shape), tensors([bytes(r.media)])[0])
