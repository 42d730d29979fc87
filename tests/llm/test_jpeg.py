"""The decoder against streams of a plain bit-by-bit encoder, and stored payloads."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tradeloom.llm import jpeg, media


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def flat_table(kind, ident, symbols):
    """All codes of one length, the last code unused."""
    n = next(k for k in range(1, 17) if (1 << k) > len(symbols))
    lengths = [0] * 16
    lengths[n - 1] = len(symbols)
    return bytes([kind << 4 | ident, *lengths, *symbols]), {s: (i, n) for i, s in enumerate(symbols)}


DC, DC_CODES = flat_table(0, 0, list(range(12)))
AC, AC_CODES = flat_table(1, 0, sorted({r << 4 | s for r in range(16) for s in range(11)}))


def size_of(v):
    return abs(v).bit_length()


def put_signed(w, v):
    n = size_of(v)
    w.put(v if v > 0 else v + (1 << n) - 1, n)


def dc_scan(blocks, low):
    w, before = Writer(), 0
    for b in blocks:
        v = int(b[0]) >> low
        w.put(*DC_CODES[size_of(v - before)])
        put_signed(w, v - before)
        before = v
    return w.bytes()


def ac_first(blocks, first, last, low):
    w, run = Writer(), 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.put(*AC_CODES[n << 4])
            w.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        values = [int(v) // (1 << low) if v >= 0 else -(int(-v) // (1 << low)) for v in b[first : last + 1]]
        zeros = 0
        while values and values[-1] == 0:
            values.pop()
        if values:
            flush()
        for v in values:
            if v == 0:
                zeros += 1
                continue
            while zeros > 15:
                w.put(*AC_CODES[0xF0])
                zeros -= 16
            w.put(*AC_CODES[zeros << 4 | size_of(v)])
            put_signed(w, v)
            zeros = 0
        if first + len(values) <= last:
            run += 1
            if run == 1000:
                flush()
    flush()
    return w.bytes()


def ac_refine(blocks, first, last, low):
    w = Writer()
    for b in blocks:
        mags = [(abs(int(v)) >> low, int(v) > 0) for v in b[first : last + 1]]
        end = max((i for i, (m, _) in enumerate(mags) if m == 1), default=-1)
        zeros, pending = 0, []
        for i, (m, positive) in enumerate(mags):
            if i > end:
                break
            if m == 0:
                zeros += 1
                if zeros == 16:
                    w.put(*AC_CODES[0xF0])
                    for p in pending:
                        w.put(p, 1)
                    zeros, pending = 0, []
            elif m > 1:
                pending.append(m & 1)
            else:
                w.put(*AC_CODES[zeros << 4 | 1])
                w.put(int(positive), 1)
                for p in pending:
                    w.put(p, 1)
                zeros, pending = 0, []
        if end < len(mags) - 1 or pending:
            w.put(*AC_CODES[0])
            for p in pending + [m & 1 for m, _ in mags[end + 1 :] if m > 1]:
                w.put(p, 1)
    return w.bytes()


@pytest.mark.parametrize("seed", range(6))
def test_general_scans(seed):
    r = random.Random(seed)
    wide, high = r.randint(1, 5), r.randint(1, 4)
    blocks = np.zeros((wide * high, 64), dtype=int)
    for b in blocks:
        b[0] = r.randint(-900, 900)
        for k in r.sample(range(1, 64), r.choice([0, 3, 40])):
            b[k] = r.choice([-1, 1]) * r.choice([1, 1, 2, 3, 7, 200])
    # zigzag zero runs of over sixteen occur in sparse blocks
    seg, start = jpeg._segment, jpeg._start
    frame = bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    refine_dc = Writer()
    for b in blocks:
        refine_dc.put(int(b[0]) & 1, 1)
    stream = b"".join([
        b"\xff\xd8", seg(0xDB, bytes([0, *[1] * 64])), seg(0xC2, frame), seg(0xC4, DC + AC),
        start(1, 0, 0, 0, 0, 1), dc_scan(blocks, 1), start(1, 0, 1, 5, 0, 2), ac_first(blocks, 1, 5, 2), start(1, 0, 6, 63, 0, 2), ac_first(blocks, 6, 63, 2),
        start(1, 0, 1, 63, 2, 1), ac_refine(blocks, 1, 63, 1), start(1, 0, 0, 0, 1, 0), refine_dc.bytes(), start(1, 0, 1, 63, 1, 0), ac_refine(blocks, 1, 63, 0), b"\xff\xd9",
    ])
    image = jpeg.Image(stream)
    assert (image.components[0].coefficients.reshape(-1, 64) == blocks).all()
    assert image.rgb().shape == (8 * high, 8 * wide, 3)


def test_inverse_transform():
    image = np.zeros((1, 64), dtype=np.float32)
    image[0, 0] = 80
    assert np.allclose(image @ jpeg.BASIS, 10)
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-1] == 63
    assert np.allclose(jpeg.BASIS @ jpeg.BASIS.T, np.eye(64), atol=1e-5)


@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256)), b"\xff" * 700, b"\0" * 64, "größe 漢".encode() * 321])
def test_payload_survives(raw, monkeypatch):
    stored = jpeg.store(media.padded(raw))
    image = jpeg.Image(stored)
    assert jpeg.payload(image) == media.padded(raw)
    monkeypatch.setattr(jpeg.Image, "_array_scan", lambda *a: False)  # the general way reads the same
    again = jpeg.Image(stored)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(image.components, again.components, strict=True))
    assert media.feature(image.rgb()) == media.feature(again.rgb())


def test_operator(spark, odd, nothing):
    rows = {(r.doc_id, r.n_bytes): r for r in media.read_back(media.stored(odd)).collect()}
    texts = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in odd.collect()}
    assert rows.keys() == texts.keys()
    for k, raw in texts.items():
        assert bytes(rows[k].payload) == media.padded(raw)
        assert len(rows[k].rgb) == 3 * rows[k].width * rows[k].height
    assert rows[4, 13].media == rows[5, 13].media
    assert media.read_back(media.stored(nothing)).count() == 0


def test_query(spark, sf):
    """Every column, from streams stored and read here."""
    found = {r.doc_id: r for r in media.op9_media(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        kept = jpeg.store(payload)
        rgb = jpeg.Image(kept).rgb()
        means = ",".join(str(int(rgb[:, :, c].astype(int).sum()) * 1000 // rgb[:, :, c].size) for c in range(3))
        feature = f"{rgb.shape[1]}x{rgb.shape[0]};{means};{zlib.crc32(np.ascontiguousarray(rgb).tobytes()):08x}"
        expected = (
            r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(kept), hashlib.sha256(kept).hexdigest(), feature,
        )
        f = found[r.doc_id]
        assert (f.doc_id, f.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32, f.media_bytes, f.media_sha256, f.feature) == expected
