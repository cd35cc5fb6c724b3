"""Baseline and lossless JPEG frames as numpy kernels.

Encoding transforms and entropy-codes all blocks of a frame at once; decoding walks the bit stream symbol
by symbol and transforms all blocks at once. Baseline: 8 bits, one or three samples, chroma at full size
or halved in either direction, restart intervals. Extended: 12 bits of one sample. Lossless: the process with prediction from the left
(or any of the seven predictors when decoding), 2 to 16 bits, one or three samples.
"""

from __future__ import annotations

import struct

import numpy as np

from tessera.errors import Unsupported

# Fixed values of the standard: the order of coefficients, the example quantisation and Huffman tables.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
LUMINANCE = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMINANCE = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66] + [99] * 38)
SCAN, QUANT, HUFFMAN, RESTART, BASELINE, EXTENDED, LOSSLESS = 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xC1, 0xC3

_COS = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def code_lengths(counts: dict[int, int], longest: int = 16) -> dict[int, int]:
    """Huffman code lengths of symbols by their counts, none beyond `longest`, and no code of ones only."""
    import heapq

    # one more symbol, the rarest, takes the code of ones
    heap = [(n, 0, [s]) for s, n in counts.items()] + [(0, 1, [-1])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, -1], 0)
    turn = 2
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, turn, x + y))
        turn += 1
    # too long codes are shortened by moving pairs up the tree
    size = [0] * (max(depth.values()) + 1)
    for n in depth.values():
        size[n] += 1
    for n in range(len(size) - 1, longest, -1):
        while size[n]:
            j = n - 2
            while not size[j]:
                j -= 1
            size[n] -= 2
            size[n - 1] += 1
            size[j + 1] += 2
            size[j] -= 1
    lengths = [n for n in range(len(size)) for _ in range(size[n])]
    order = sorted(counts, key=lambda s: (-counts[s], s))
    return {s: lengths[i] for i, s in enumerate(order)}  # the last, longest length is the extra symbol's


def _codes(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _table(counts: dict[int, int]) -> tuple[list[int], list[int]]:
    lengths = code_lengths(counts)
    bits = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bits, sorted(lengths, key=lambda s: (lengths[s], -counts[s], s))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _category(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _entropy(symbols: np.ndarray, table: np.ndarray, codes: list[dict], extra: np.ndarray, extra_bits: np.ndarray) -> bytes:
    """The bit stream of symbols, each followed by its extra bits, with ones to fill and zeros after bytes of ones."""
    most = max(max(c) for c in codes) + 1
    value, length = np.zeros((len(codes), most), np.int64), np.zeros((len(codes), most), np.int64)
    for t, own in enumerate(codes):
        for s, (code, n) in own.items():
            value[t, s], length[t, s] = code, n
    both = np.stack([value[table, symbols], extra], axis=1).reshape(-1)
    size = np.stack([length[table, symbols], extra_bits], axis=1).reshape(-1)
    at = np.cumsum(size) - size
    total = int(size.sum())
    place = np.repeat(at, size)
    nth = np.arange(total) - place
    bits = (np.repeat(both, size) >> (np.repeat(size, size) - 1 - nth)) & 1
    raw = np.packbits(np.append(bits.astype(np.uint8), np.ones(-total % 8, np.uint8)))
    return raw.tobytes().replace(b"\xff", b"\xff\0")


def to_ycc(a: np.ndarray) -> np.ndarray:
    r, g, b = (a[..., k].astype(float) for k in range(3))
    return np.stack([0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128], axis=-1)


def to_rgb(a: np.ndarray) -> np.ndarray:
    y, cb, cr = a[..., 0].astype(float), a[..., 1] - 128.0, a[..., 2] - 128.0
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)


def _quant(base: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255).astype(np.int64)


def _blocks(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """(block rows, block columns, 8, 8), the last row and column repeated."""
    p = np.pad(plane, [(0, rows * 8 - plane.shape[0]), (0, columns * 8 - plane.shape[1])], mode="edge")
    return p.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3)


def encode(a: np.ndarray, quality: int = 90, halved: tuple[int, int] = (1, 1), colour: bool = True) -> bytes:
    """A frame of bytes, (rows, columns) or (rows, columns, 3), or of 12-bit numbers, (rows, columns).

    halved: by how much chroma is smaller, down and across; colour: RGB becomes luminance and chroma.
    """
    deep = 12 if a.dtype == np.uint16 else 8
    if a.dtype not in (np.uint8, np.uint16) or deep == 12 and (a.ndim != 2 or int(a.max(initial=0)) > 4095):
        raise Unsupported("lossy frames have 8 bits, or 12 of one sample")
    planes = [a.astype(float)] if a.ndim == 2 else list(np.moveaxis(to_ycc(a) if colour else a.astype(float), -1, 0))
    v, h = halved if len(planes) == 3 else (1, 1)
    rows, columns = (-(-n // (8 * k)) for n, k in zip(a.shape, (v, h), strict=False))  # of minimum coded units
    order: list[np.ndarray] = []
    tables = [_quant(LUMINANCE, quality), _quant(CHROMINANCE, quality)]
    for c, p in enumerate(planes):
        if c and (v, h) != (1, 1):
            p = np.pad(p, [(0, -p.shape[0] % v), (0, -p.shape[1] % h)], mode="edge")
            p = p.reshape(p.shape[0] // v, v, p.shape[1] // h, h).mean(axis=(1, 3))
        dv, dh = (v, h) if c == 0 else (1, 1)
        b = _COS @ (_blocks(p, rows * dv, columns * dh) - (1 << (deep - 1))) @ _COS.T
        q = np.round(b.reshape(*b.shape[:2], 64) / tables[min(c, 1)]).astype(np.int64)[..., ZIGZAG]
        order.append(q.reshape(rows, dv, columns, dh, 64).transpose(0, 2, 1, 3, 4).reshape(rows * columns, dv * dh, 64))
    per = [o.shape[1] for o in order]
    blocks = np.concatenate(order, axis=1).reshape(-1, 64)
    kind = np.tile(np.repeat(np.arange(len(planes)), per), rows * columns)
    dc = blocks[:, 0].copy()
    for c in range(len(planes)):
        own = kind == c
        dc[own] = np.diff(dc[own], prepend=0)
    t = np.minimum(kind, 1)
    # symbols: (block, place, turn), so that runs of zeros and ends of blocks fall in order
    where, k = np.nonzero(blocks[:, 1:])
    run = k - np.where(np.append(True, where[1:] != where[:-1]) if len(where) else True, 0, np.append(0, k[:-1] + 1)) if len(where) else k
    value = blocks[where, k + 1]
    long = np.repeat(np.arange(len(where)), run // 16)
    open_ = np.flatnonzero(blocks[:, 63] == 0)
    symbol = np.concatenate([_category(dc), np.full(len(long), 0xF0), (run % 16) * 16 + _category(value), np.zeros(len(open_), np.int64)])
    block = np.concatenate([np.arange(len(blocks)), where[long], where, open_])
    place = np.concatenate([np.zeros(len(blocks), np.int64), 2 * k[long] + 1, 2 * k + 2, np.full(len(open_), 200)])
    what = np.concatenate([dc, np.zeros(len(long), np.int64), value, np.zeros(len(open_), np.int64)])
    table = np.concatenate([t, 2 + t[where[long]], 2 + t[where], 2 + t[open_]])
    turn = np.lexsort((place, block))
    symbol, what, table = symbol[turn], what[turn], table[turn]
    size = symbol % 16 if len(symbol) else symbol
    extra = np.where(what < 0, what + (1 << size) - 1, what)
    used = sorted(set(table.tolist()))
    made = {n: _table(dict(zip(*(x.tolist() for x in np.unique(symbol[table == n], return_counts=True)), strict=True))) for n in used}
    out = [b"\xff\xd8"]
    for n in range(min(len(planes), 2)):
        out.append(_segment(QUANT, bytes([n]) + bytes(tables[n][ZIGZAG].tolist())))
    frame = b"".join(bytes([c + 1, (v * 1 + h * 16) if c == 0 else 0x11, min(c, 1)]) for c in range(len(planes)))
    out.append(_segment(BASELINE if deep == 8 else EXTENDED, struct.pack(">BHHB", deep, *a.shape[:2], len(planes)) + frame))
    for n, (bits, symbols) in made.items():
        out.append(_segment(HUFFMAN, bytes([(n // 2) * 16 + n % 2]) + bytes(bits) + bytes(symbols)))
    out.append(_segment(SCAN, bytes([len(planes)]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(len(planes))) + b"\0\x3f\0"))
    codes = [_codes(*made[n]) if n in made else {0: (0, 0)} for n in range(4)]
    return b"".join([*out, _entropy(symbol, table, codes, extra, size), b"\xff\xd9"])


def encode_lossless(a: np.ndarray, bits: int | None = None) -> bytes:
    """A frame of bytes or 16-bit numbers, each predicted from its left neighbour."""
    bits = bits or 8 * a.dtype.itemsize
    planes = a.reshape(*a.shape[:2], -1).astype(np.int64)
    guess = np.empty_like(planes)
    guess[:, 1:] = planes[:, :-1]
    guess[1:, 0] = planes[:-1, 0]
    guess[0, 0] = 1 << (bits - 1)
    d = ((planes - guess + 32768) % 65536 - 32768).reshape(-1)
    size = _category(d)
    size[d == -32768] = 16
    table = _table(dict(zip(*(x.tolist() for x in np.unique(size, return_counts=True)), strict=True)))
    extra = np.where(d < 0, d + (1 << size) - 1, d)
    n = planes.shape[2]
    out = [b"\xff\xd8", _segment(LOSSLESS, struct.pack(">BHHB", bits, *a.shape[:2], n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n)))]
    out.append(_segment(HUFFMAN, b"\0" + bytes(table[0]) + bytes(table[1])))
    out.append(_segment(SCAN, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\1\0\0"))
    kept = np.where(size == 16, 0, size)  # a difference of 32768 has no more bits
    return b"".join([*out, _entropy(size, np.zeros(len(size), np.int64), [_codes(*table)], np.where(size == 16, 0, extra), kept), b"\xff\xd9"])


class _Bits:
    """Symbols of an entropy-coded stretch; restart markers are steps in it."""

    def __init__(self, data: bytes) -> None:
        parts, at = [], 0
        while (n := data.find(b"\xff", at)) >= 0 and n + 1 < len(data):
            if 0xD0 <= data[n + 1] <= 0xD7:
                parts.append(data[:n])
                data, at = data[n + 2 :], 0
            elif data[n + 1] == 0:
                at = n + 2
            else:
                data = data[:n]
                break
        self.parts = [p.replace(b"\xff\0", b"\xff") for p in [*parts, data]]
        self.nth = -1
        self.restart()

    def restart(self) -> None:
        self.nth += 1
        self.data = self.parts[self.nth] + b"\xff" * 8 if self.nth < len(self.parts) else b"\xff" * 8
        self.at = self.held = self.n = 0

    def _fill(self) -> None:
        chunk = self.data[self.at : self.at + 6] or b"\xff" * 6
        self.held = (self.held & ((1 << self.n) - 1)) << (8 * len(chunk)) | int.from_bytes(chunk, "big")
        self.n += 8 * len(chunk)
        self.at += 6

    def symbol(self, table: list) -> int:
        if self.n < 16:
            self._fill()
        length, s = table[self.held >> (self.n - 16) & 0xFFFF]
        self.n -= length
        return s

    def value(self, size: int) -> int:
        if not size:
            return 0
        if self.n < size:
            self._fill()
        self.n -= size
        v = self.held >> self.n & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _lookup(bits: list[int], symbols: list[int]) -> list:
    """(length, symbol) by the next 16 bits."""
    out = [(16, 0)] * 65536
    for s, (code, n) in _codes(bits, symbols).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = [(n, s)] * (1 << (16 - n))
    return out


def decode(data: bytes, rgb: bool = True) -> np.ndarray:
    """The frame, (rows, columns) or (rows, columns, 3). rgb: three samples of a baseline frame become RGB unless it says that they are."""
    at, quant, huff, interval, frame, adobe = 2, {}, {}, 0, None, None
    if data[:2] != b"\xff\xd8":
        raise Unsupported("not a JPEG frame")
    while True:
        if data[at] != 0xFF:
            raise Unsupported("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == QUANT:
            while body:
                wide, n = divmod(body[0], 16)
                size = 128 if wide else 64
                quant[n] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif marker == HUFFMAN:
            while body:
                bits = list(body[1:17])
                huff[body[0]] = _lookup(bits, list(body[17 : 17 + sum(bits)]))
                body = body[17 + sum(bits) :]
        elif marker == RESTART:
            interval = struct.unpack(">H", body)[0]
        elif marker in (BASELINE, EXTENDED, LOSSLESS):
            bits, rows, columns, n = struct.unpack(">BHHB", body[:6])
            frame = (marker, bits, rows, columns, [tuple(body[6 + 3 * c : 9 + 3 * c]) for c in range(n)])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Unsupported(f"JPEG process {marker - 0xC0}")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == SCAN:
            break
    if frame is None:
        raise Unsupported("a scan without a frame")
    kind, bits, rows, columns, parts = frame
    if body[0] != len(parts):
        raise Unsupported("samples in scans of their own")
    tables = [body[2 + 2 * c] for c in range(body[0])]
    stream = _Bits(data[at:])
    if kind == LOSSLESS:
        return _lossless(stream, bits, rows, columns, [huff[t >> 4] for t in tables], body[1 + 2 * len(parts)], body[3 + 2 * len(parts)] & 15, interval)
    if bits != 8 and (bits != 12 or len(parts) > 1):
        raise Unsupported(f"{bits} bits in a lossy frame")
    h, v = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
    if len(parts) == 1:
        parts, h, v = [(parts[0][0], 0x11, parts[0][2])], 1, 1
    across, down = -(-columns // (8 * h)), -(-rows // (8 * v))
    coefficients = [np.zeros((down * (p[1] & 15), across * (p[1] >> 4), 64), np.int64) for p in parts]
    last = [0] * len(parts)
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            stream.restart()
            last = [0] * len(parts)
        my, mx = divmod(unit, across)
        for c, (_, sampling, _) in enumerate(parts):
            dh, dv = sampling >> 4, sampling & 15
            dc, ac = huff[tables[c] >> 4], huff[16 + (tables[c] & 15)]
            for i in range(dh * dv):
                block = coefficients[c][my * dv + i // dh, mx * dh + i % dh]
                last[c] += stream.value(stream.symbol(dc))
                block[0] = last[c]
                k = 1
                while k < 64:
                    s = stream.symbol(ac)
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15 and k < 64:
                        block[k] = stream.value(s & 15)
                    k += 1
    planes = []
    for (_, sampling, q), co in zip(parts, coefficients, strict=True):
        b = np.zeros(co.shape)
        b[..., ZIGZAG] = co * quant[q]
        p = _COS.T @ b.reshape(*co.shape[:2], 8, 8) @ _COS + (1 << (bits - 1))
        p = p.transpose(0, 2, 1, 3).reshape(co.shape[0] * 8, co.shape[1] * 8)
        p = np.clip(np.round(p), 0, (1 << bits) - 1)
        planes.append(np.repeat(np.repeat(p, v // (sampling & 15), axis=0), h // (sampling >> 4), axis=1)[:rows, :columns])
    if len(planes) == 1:
        return planes[0].astype(np.uint8 if bits == 8 else np.uint16)
    out = np.stack(planes, axis=-1)
    ids = bytes(p[0] for p in parts)
    if rgb and adobe != 0 and ids != b"RGB":
        out = to_rgb(out)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def _lossless(stream: _Bits, bits: int, rows: int, columns: int, tables: list, predictor: int, shift: int, interval: int) -> np.ndarray:
    n = len(tables)
    out = [[[0] * columns for _ in range(rows)] for _ in range(n)]
    start = 1 << (bits - shift - 1)
    fresh = 0  # the row that begins after a restart is predicted like the first
    for y in range(rows):
        if interval and y and y * columns % interval == 0:
            stream.restart()
            fresh = y
        for x in range(columns):
            for c in range(n):
                own = out[c]
                if y == fresh:
                    guess = own[y][x - 1] if x else start
                elif x == 0:
                    guess = own[y - 1][0]
                else:
                    a, b, d = own[y][x - 1], own[y - 1][x], own[y - 1][x - 1]
                    guess = (a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor - 1]
                size = stream.symbol(tables[c])
                own[y][x] = (guess + (32768 if size == 16 else stream.value(size))) & 0xFFFF
    image = np.moveaxis(np.array(out, np.uint16), 0, -1) << shift
    image = image.astype(np.uint8) if bits <= 8 else image
    return image[..., 0] if n == 1 else image
