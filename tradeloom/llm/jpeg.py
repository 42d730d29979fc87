"""Progressive JPEG in numpy: a decoder, and a writer that keeps bytes as coefficients.

The decoder accumulates scans (spectral selection and successive approximation) into one coefficient array a component.
Scans whose Huffman table has one symbol have codes at known places and are read as arrays; others bit by bit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: Order of the coefficients in a block: anti-diagonals in turn, each from the other end.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _basis() -> np.ndarray:
    """Pixels (row-major) of each coefficient in zigzag order."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    return np.kron(one, one)[ZIGZAG].astype(np.float32)


BASIS = _basis()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks across and down, of the component itself and with whole MCUs
    high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), dtype=np.int32))


@dataclass
class Huffman:
    lengths: list[int]
    symbols: bytes

    def __post_init__(self) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for length, n in enumerate(self.lengths, 1):
            for _ in range(n):
                self.codes[length, code] = self.symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    def only(self) -> tuple[int, int] | None:
        """Length and symbol of the only code, if there's one."""
        return (self.lengths.index(1) + 1, self.symbols[0]) if sum(self.lengths) == 1 else None


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        value = self.take(size)
        return value if value >> (size - 1) else value - (1 << size) + 1


class Image:
    """A decoded stream: components with their coefficients, quantisation tables and comment."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], Huffman] = {}
        self.components: list[Component] = []
        self.comment, self.restart = b"", 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker where one is due")
            kind = data[at + 1]
            if kind == 0xD9:
                return
            if kind == 0xFF:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                self._quantisation(body)
            elif kind == 0xC2:
                self._frame(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDA:
                end = _MARKER.search(data, at)
                if end is None:
                    raise ValueError("the stream ends within a scan")
                self._scan(body, data[at : end.start()])
                at = end.start()
            elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
                raise ValueError("only progressive Huffman streams are read")

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, ident = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.quant[ident] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(np.float32)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            lengths = list(body[1:17])
            self.huffman[body[0] >> 4, body[0] & 15] = Huffman(lengths, body[17 : 17 + sum(lengths)])
            body = body[17 + sum(lengths) :]

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus_wide, self.mcus_high = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.wide, c.high = -(-self.width * c.h // (8 * self.hmax)), -(-self.height * c.v // (8 * self.vmax))
            c.coefficients = np.zeros((self.mcus_high * c.v, self.mcus_wide * c.h, 64), dtype=np.int32)

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        chosen = [(next(c for c in self.components if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if n == 1 and self._array_scan(*chosen[0], first, last, high, low, data):
            return
        if n == 1:
            c, tables = chosen[0]
            units = [[(c, tables, c.coefficients[y, x])] for y in range(c.high) for x in range(c.wide)]
        else:
            units = [
                [(c, t, c.coefficients[my * c.v + y, mx * c.h + x]) for c, t in chosen for y in range(c.v) for x in range(c.h)]
                for my in range(self.mcus_high)
                for mx in range(self.mcus_wide)
            ]
        step = self.restart or len(units)
        for part, at in zip(_RESTART.split(data), range(0, len(units), step), strict=False):
            bits = Bits(part.replace(b"\xff\x00", b"\xff"))
            self._interval(bits, units[at : at + step], first, last, high, low)

    def _interval(self, bits: Bits, units: list, first: int, last: int, high: int, low: int) -> None:
        before: dict[int, int] = {}
        run = 0
        for unit in units:
            for c, tables, block in unit:
                if first == 0 and high:
                    block[0] |= bits.take(1) << low
                elif first == 0:
                    before[c.ident] = before.get(c.ident, 0) + bits.signed(bits.symbol(self.huffman[0, tables >> 4]))
                    block[0] = before[c.ident] << low
                elif high:
                    run = _refine(bits, self.huffman[1, tables & 15], block, first, last, low, run)
                else:
                    run = _first_pass(bits, self.huffman[1, tables & 15], block, first, last, low, run)

    def _array_scan(self, c: Component, tables: int, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Reads a scan of one component whose codes are at known places; False if it isn't such a scan."""
        n = c.wide * c.high
        own = c.coefficients[: c.high, : c.wide].reshape(n, 64)
        if first == 0 and high and not self.restart:
            raw = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8), count=n)
            own[:, 0] |= raw.astype(np.int32) << low
        elif first == 0 and not high:
            code = self.huffman[0, tables >> 4].only()
            if code is None or self.restart != 1 or code[0] + code[1] > 8:
                return False
            raw = np.frombuffer(data + b"\xff\xd0", dtype=np.uint8)
            if len(raw) != 3 * n or (raw[0::3] == 0xFF).any():
                return False
            own[:, 0] = _signed((raw[0::3] >> (8 - code[0] - code[1])).astype(np.int32) & ((1 << code[1]) - 1), code[1]) << low
        elif first and not self.restart:
            code = self.huffman[1, tables & 15].only()
            if code is None:
                return False
            plain = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)
            width = last - first + 1
            if not high and 1 <= code[1] <= 10:  # every coefficient has this size
                stride = code[0] + code[1]
                if stride == 8:
                    raw = plain[: n * width].astype(np.int32) & ((1 << code[1]) - 1)
                else:
                    bits = np.unpackbits(plain, count=n * width * stride).reshape(-1, stride)[:, code[0] :]
                    raw = bits @ (1 << np.arange(code[1])[::-1]).astype(np.int32)
                own[:, first : last + 1] = (_signed(raw, code[1]) << low).reshape(n, width)
            elif high and code[1] == 0 and (own[:, first : last + 1] != 0).all():  # every block ends at once; corrections follow
                bits = np.unpackbits(plain, count=n * (code[0] + width)).reshape(n, -1)[:, code[0] :].astype(np.int32) << low
                band = own[:, first : last + 1]
                own[:, first : last + 1] = np.where(band > 0, band + bits, band - bits)
            else:
                return False
        else:
            return False
        c.coefficients[: c.high, : c.wide] = own.reshape(c.high, c.wide, 64)
        return True

    def planes(self) -> list[np.ndarray]:
        """Each component's samples (unsigned 8-bit) at its own resolution."""
        out = []
        for c in self.components:
            high, wide, _ = c.coefficients.shape
            scaled = c.coefficients.reshape(-1, 64).astype(np.float32) * self.quant[c.table]
            pixels = np.clip(np.rint(scaled @ BASIS + 128), 0, 255).astype(np.uint8)
            out.append(pixels.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8))
        return out

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor (height, width, 3), chroma repeated to the luma's resolution; grey for one component."""
        full = [
            p.repeat(self.vmax // c.v, axis=0).repeat(self.hmax // c.h, axis=1)[: self.height, : self.width] for p, c in zip(self.planes(), self.components, strict=True)
        ]
        if len(full) != 3:
            return np.stack([full[0]] * 3, axis=-1)
        y, cb, cr = full[0].astype(np.float32), full[1].astype(np.float32) - 128, full[2].astype(np.float32) - 128
        out = np.empty((self.height, self.width, 3), dtype=np.uint8)
        for i, channel in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[..., i] = np.clip(np.rint(channel), 0, 255)
        return out


def _signed(raw: np.ndarray, size: int) -> np.ndarray:
    return np.where(raw >> (size - 1), raw, raw - (1 << size) + 1)


def _first_pass(bits: Bits, table: Huffman, block: np.ndarray, k: int, last: int, low: int, run: int) -> int:
    """A band's first scan for one block; returns the blocks left in the run of empty ones."""
    if run:
        return run - 1
    while k <= last:
        zeros, size = divmod(bits.symbol(table), 16)
        if size:
            k += zeros
            block[k] = bits.signed(size) << low if size else 0
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _refine(bits: Bits, table: Huffman, block: np.ndarray, k: int, last: int, low: int, run: int) -> int:
    """A later scan of a band for one block: one more bit for known coefficients, new ones of size one."""

    def correct(i: int) -> None:
        if bits.take(1):
            block[i] += (1 if block[i] > 0 else -1) << low

    while not run and k <= last:
        zeros, size = divmod(bits.symbol(table), 16)
        new = 0
        if size:
            new = (1 if bits.take(1) else -1) << low
        elif zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        while k <= last:
            if block[k]:
                correct(k)
            elif zeros == 0:
                if new:
                    block[k] = new
                k += 1
                break
            else:
                zeros -= 1
            k += 1
    if run:
        for i in range(k, last + 1):
            if block[i]:
                correct(i)
        run -= 1
    return run


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, ident: int, symbol: int) -> bytes:
    """A Huffman table with the single code 0."""
    return bytes([kind << 4 | ident, 1, *[0] * 15, symbol])


def _start(component: int, tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, tables, first, last, high << 4 | low]))


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -bits.size % 8
    return np.packbits(np.concatenate([bits.reshape(-1), np.ones(pad, dtype=np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


#: Bands of the first scans of each component.
BANDS = ((1, 5), (6, 63))
_SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))


def store(payload: bytes) -> bytes:
    """A progressive stream (three components, chroma halved) whose coefficients hold ``payload``, a multiple of 64 bytes.

    Byte k of 64 is coefficient k in zigzag order. A byte b from 128 on is the coefficient b; one below is b - 255, and b - 254
    for the first of a block; so all have eight bits and no coefficient is zero. Components follow one another, filled up
    with bytes 0; the comment has the payload's length.
    """
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    high = -(-mcus // max(64, -(-mcus // 4095)))
    wide = -(-mcus // high)
    values = np.zeros((6 * wide * high, 64), dtype=np.uint8)
    values[:blocks] = np.frombuffer(payload, dtype=np.uint8).reshape(blocks, 64)
    n = 4 * wide * high
    parts = [values[:n], values[n : n + n // 4], values[n + n // 4 :]]
    frame = bytes([8]) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3])
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, frame + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in _SAMPLING)),
        _segment(0xC4, _table(0, 0, 7) + _table(1, 0, 7) + _table(1, 1, 0)),
        _segment(0xDD, b"\0\1"),
    ]
    for (i, _, _), part in zip(_SAMPLING, parts, strict=True):  # a restart after each block: nothing is predicted
        rows = np.full((len(part), 3), 0xFF, dtype=np.uint8)
        rows[:, 0] = part[:, 0] >> 1
        rows[:, 2] = 0xD0 + np.arange(len(part)) % 8
        out += [_start(i, 0x00, 0, 0, 0, 1), rows.tobytes()[:-2]]
    out.append(_segment(0xDD, b"\0\0"))
    for first, last in BANDS:
        for (i, _, _), part in zip(_SAMPLING, parts, strict=True):  # code 0 and seven bits: a byte a coefficient
            out += [_start(i, 0x00, first, last, 0, 1), (part[:, first : last + 1] >> 1).tobytes()]
    for (i, _, _), part in zip(_SAMPLING, parts, strict=True):
        low = part & 1
        low[:, 1:] ^= (part[:, 1:] < 128).astype(np.uint8)
        own = low.copy()
        own[:, 0] = 0  # the code for "no new coefficient"
        out += [_start(i, 0x01, 1, 63, 1, 0), _stuffed(own), _start(i, 0x00, 0, 0, 1, 0), _stuffed(low[:, 0])]
    return b"".join([*out, b"\xff\xd9"])


def payload(image: Image) -> bytes:
    """The bytes that ``store`` put in."""
    found = np.concatenate([c.coefficients.reshape(-1, 64) for c in image.components])
    shift = np.full(64, 255, dtype=np.int32)
    shift[0] = 254
    values = np.where(found < 0, found + shift, found).astype(np.uint8)
    return values.tobytes()[: int(image.comment.split()[1])]
